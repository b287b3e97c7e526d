"""Phrase collocation mining over a prefix-free parse.

Each text becomes a stream of words and piece breaks.  Where the hash of ``MOST`` - 1 consecutive
tokens is a multiple of ``EVERY``, a new chunk begins; the chunk before it runs on over those
tokens, so that neighbours overlap by them.  Borders depend on content alone: equal passages give
equal chunks, in whichever texts they stand.  The distinct chunks of a language, with the times
each occurs in the parse, are the dictionary, and everything is counted there: an n-gram inside a
chunk counts as often as the chunk occurs.  One that begins in a chunk's overlap belongs to the
next chunk, which holds it whole, so every occurrence counts once.

Phrases are counted level by level.  A phrase can reach the threshold only if both its shorter
parts (all but the last word, all but the first) reach it; a bitmap of the frequent phrases one
word shorter is sent to the tasks.  It holds hashes, so it may let a phrase through for nothing
but never keeps one back, and all counts are of the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import grouped, rows, stage_table
from vulnlake.operators.windows import top_k_per_group

MOST = 4
EVERY = 48
BREAK = b"."
#: A-Z to lower case, tab to blank, every character that ends a piece to ``BREAK``.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
#: Bits of the bitmap for each frequent phrase, and its largest size (32 MB).
SPACE, MOST_BITS = 16, 1 << 28
SEGMENT = 1 << 20
#: Bytes of chunks that a task counts at once.
TOGETHER = 8 << 20

CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.binary()), ("last", pa.bool_()), ("times", pa.int64())])
CHUNKS_SQL = "lang string, chunk binary, last boolean, times long"
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])
COUNTS_SQL = "lang string, phrase binary, f long"
STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Words and ``BREAK`` for each end of a piece, in order."""
    return text.translate(CLEAN).replace(BREAK, b" . ").split()


def numbered(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Tokens, one blank apart, of all lines side by side: number and byte length of each, the
    tokens a line, and the distinct tokens in the order of their numbers."""
    split = pc.split_pattern(pa.array(lines, pa.large_binary()), b" ")
    flat = split.flatten()
    coded = flat.dictionary_encode()
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    return coded.indices.to_numpy().astype(np.int64), length, pc.list_value_length(split).to_numpy().astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


def mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several words side by side."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * STEP
        out ^= out >> np.uint64(29)
    return out


def chunk_starts(hashes: np.ndarray, size: np.ndarray, every: int, width: int) -> np.ndarray:
    """Where chunks begin among the tokens of texts of ``size`` tokens each: at the first token of a
    text and at every trigger of ``width`` tokens of one text."""
    ends = np.cumsum(size)
    begin = np.zeros(len(hashes), bool)
    n = len(hashes) - width + 1
    if n > 0:
        begin[:n] = mixed([hashes[i:i + n] for i in range(width)]) % np.uint64(every) == 0
        begin &= np.arange(len(hashes)) + width <= np.repeat(ends, size)
    begin[(ends - size)[size > 0]] = True
    return np.flatnonzero(begin)


def cut(group: list[tuple[str, bytes]], every: int, most: int) -> dict[tuple[str, bytes, bool], int]:
    """(lang, chunk, last) of some texts, whose tokens are one blank apart, with the times each occurs."""
    ids, length, size, words = numbered([text for _, text in group])
    at = chunk_starts(word_hashes(words)[ids], size, every, most - 1)
    whole = b" ".join(text for _, text in group)
    byte = np.concatenate([[0], np.cumsum(length + 1)])
    ends = np.cumsum(size)
    row = np.searchsorted(ends, at, side="right")
    last = np.append(row[1:] != row[:-1], True)
    stop = np.where(last, ends[row], np.append(at[1:], 0) + most - 1)
    out: dict[tuple[str, bytes, bool], int] = {}
    for r, a, b, end in zip(row.tolist(), byte[at].tolist(), (byte[stop] - 1).tolist(), last.tolist(), strict=True):
        key = group[r][0], whole[a:b], end
        out[key] = out.get(key, 0) + 1
    return out


def parse(docs: DataFrame, every: int = EVERY, most: int = MOST) -> DataFrame:
    """The dictionary of ``docs`` (lang, text): (lang, chunk, last, times), in the shared folder.
    ``last``: the chunk ends its text, so nothing in it is the next one's."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = ((lang, text) for lang, text in ((lang, b" ".join(tokens(text))) for lang, text in rows(batches)) if text)
        for group in grouped(clean, lambda r: len(r[1]) + 64, TOGETHER):
            times = cut(group, every, most)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*times, strict=True), list(times.values())], CHUNKS.types, strict=True)], schema=CHUNKS)
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    found = docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(work, CHUNKS_SQL)
    return stage_table(found.groupBy("lang", "chunk", "last").agg(F.sum("times").alias("times")), "chunks")


def lang_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1))


class Bitmap:
    """Hashes of frequent phrases; without bits everything is in it."""

    def __init__(self, bits: int, data: bytes | None):
        self.bits, self.data = bits, None if data is None else np.frombuffer(data, "u1")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.data is None:
            return np.ones(len(hashes), bool)
        at = hashes % np.uint64(self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(frequent: DataFrame) -> Bitmap:
    """Bitmap of the phrases of ``frequent`` (lang, phrase), in at most ``MOST_BITS`` bits: made in
    segments by the executors; the driver gets bytes of that size, whatever the number of phrases."""
    count = frequent.count()
    bits = int(min(MOST_BITS, max(SEGMENT, 1 << (SPACE * max(1, count) - 1).bit_length())))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(phrase_hashes(list(rows([b]))) % np.uint64(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array(at % SEGMENT)], names=["segment", "bit"])

    def segments(key: tuple, table: pa.Table) -> pa.Table:
        on = np.zeros(SEGMENT, bool)
        on[table.column("bit").to_numpy()] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bytes": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})
    marked = frequent.select("lang", "phrase").mapInArrow(positions, "segment long, bit long").distinct()
    data = bytearray(bits // 8)
    for r in marked.groupBy("segment").applyInArrow(segments, "segment long, bytes binary").toLocalIterator():
        data[r["segment"] * SEGMENT // 8:(r["segment"] + 1) * SEGMENT // 8] = r["bytes"]
    return Bitmap(bits, bytes(data))


def phrase_hashes(phrases: list[tuple[str, bytes]]) -> np.ndarray:
    """Hashes of (lang, phrase), all of as many words."""
    if not phrases:
        return np.zeros(0, np.uint64)
    ids, _, size, words = numbered([p for _, p in phrases])
    at, seeds = word_hashes(words)[ids].reshape(len(phrases), int(size[0])), {}
    seed = np.array([seeds.get(lang) or seeds.setdefault(lang, lang_seed(lang)) for lang, _ in phrases], np.uint64)
    return mixed([at[:, i] for i in range(at.shape[1])]) ^ seed


def count_level(lang: str, group: list[tuple], n: int, shorter: Bitmap, most: int) -> tuple[pa.Array, np.ndarray]:
    """Phrases and counts of the n-grams of some dictionary rows of one language, both of whose
    shorter parts are in ``shorter``."""
    flat, _, size, words = numbered([chunk for _, chunk, _, _ in group])
    ends = np.cumsum(size)
    own = ends - np.where([last for _, _, last, _ in group], 0, np.minimum(size, most - 1))  # n-grams from here on are the next chunk's
    at = np.arange(len(flat))
    ok = (at < np.repeat(own, size)) & (at + n <= np.repeat(ends, size))
    word = flat != words.index(BREAK).as_py()
    for i in range(n):
        ok[:len(flat) - i] &= word[i:]
        ok[len(flat) - i:] = False
    at = at[ok]
    weight = np.repeat(np.array([t for *_, t in group], np.int64), size)
    if n == 1:
        total = np.bincount(flat[at], weight[at], len(words)).astype(np.int64)  # exact: sums of whole numbers below 2**53
        some = np.flatnonzero(total)
        return words.take(pa.array(some)), total[some]
    hashes, seed = word_hashes(words), lang_seed(lang)
    for shift in (0, 1):
        at = at[shorter.has(mixed([hashes[flat[at + shift + i]] for i in range(n - 1)]) ^ seed)]
    key = flat[at]
    for i in range(1, n):  # numbers of ever longer phrases, so that no product passes 64 bits
        if i > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(words) + flat[at + i]
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(number, weight[at], len(first)).astype(np.int64)
    parts = [words.take(pa.array(flat[at[first] + i])) for i in range(n)]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type)), total


def counts(dictionary: DataFrame, n: int, least: int, shorter: Bitmap, most: int = MOST) -> DataFrame:
    """(lang, phrase, f) of the n-grams that occur ``least`` times or more, and for n = 1 a row with
    a null phrase: all word occurrences of the language."""
    spark = dictionary.sparkSession
    sent = spark.sparkContext.broadcast((shorter.bits, None if shorter.data is None else shorter.data.tobytes()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Bitmap(*sent.value)
        for group in grouped(rows(batches), lambda r: len(r[1]), TOGETHER):
            by_lang: dict[str, list[tuple]] = {}
            for r in group:
                by_lang.setdefault(r[0], []).append(r)
            for lang, mine in by_lang.items():
                phrases, total = count_level(lang, mine, n, filter_, most)
                if n == 1:
                    phrases = pa.concat_arrays([phrases, pa.array([None], phrases.type)])
                    total = np.append(total, total.sum())
                if len(total):
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(total)), phrases.cast(pa.binary()), pa.array(total)], schema=COUNTS)
    found = dictionary.select("lang", "chunk", "last", "times").mapInArrow(work, COUNTS_SQL)
    out = stage_table(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
                      .where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{n}")
    sent.unpersist()
    return out


def score_of(scale: int) -> Column:
    """floor(scale * a / (l + r)), in decimals: the product may pass 64 bits."""
    return F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")


def sub_phrases(words: Column, least_words: int) -> Column:
    """Column of all proper contiguous parts of ``words`` of ``least_words`` words or more."""
    size = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(least_words), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    return F.when(size > least_words, spans)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, most: int = MOST, scale: int = 2_000_000,
                 cover: int = 80, every: int = EVERY) -> DataFrame:
    """The ``top`` phrases of 2 to ``most`` words of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are split into pieces at ``[.,;:!?]`` and line ends, pieces into words
    at blanks and tabs.  ``a``: occurrences of the phrase inside pieces, ``least`` or more, overlaps
    included.  Cut after k words, its parts occur l and r times; score is floor(scale * a / (l + r))
    at the cut that makes it least (ties: smallest k).  A phrase inside a longer one of
    ``least`` or more occurrences that occurs at least ``cover`` percent as often is dropped.  Best first by score, a, then the phrase's
    bytes.  n: all word occurrences of the language.  All counts are exact.

    A null text is empty, a null lang ``und``; repeated rows count again; languages without a
    phrase, and empty tables, return no rows; other columns are ignored.  A text of any length is parsed whole."""
    dictionary = parse(docs, every, most)
    levels = [counts(dictionary, 1, least, Bitmap(8, None), most)]
    total = levels[0].where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    levels[0] = levels[0].where(F.col("phrase").isNotNull())
    for n in range(2, most + 1):
        levels.append(counts(dictionary, n, least, bitmap(levels[-1]), most))
    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    long = levels[1]
    for level in levels[2:]:
        long = long.unionByName(level)
    parts = parts.select("lang", F.col("phrase").cast("string").alias("part"), "f")
    found = long.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a")).withColumn("words", F.split("phrase", " "))
    # counts of both parts of every cut
    size = F.size("words")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("one"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("rest"))
    cuts = (cuts.join(parts.select("lang", F.col("part").alias("one"), F.col("f").alias("l")), ["lang", "one"])
            .join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", score_of(scale))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), least_cut)
    # the most frequent longer phrase around each
    around = (found.withColumn("phrase", F.explode(sub_phrases(F.col("words"), 2)))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (scored.join(around, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = top_k_per_group(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
