"""Language-model scoring from a log-frequency Bloom filter.

N-grams of the training texts are counted over the whole corpus: every task sorts the
64-bit hashes of its n-grams and sends (hash, count) arrays to buckets by hash, so that a
very frequent n-gram is one entry a task.  Each bucket merges its arrays and builds its own
part of the filter: an n-gram of count c enters with each level 1 .. q, where q is the
logarithm of c.  Every entry has ``ENTRY_BITS`` bits at every size.  The filter is broadcast in
slices of about ``slice_bytes``, each some buckets of one order; a task holds one slice at a time
and probes a group of texts slice by slice.  A count is read back by probing level after level
until one misses.  Probabilities are smoothed by mixing each order with
the next lower one; the lower order's share depends on the level of the history, and is the
one that makes all training texts likeliest when each n-gram is counted without itself.

The base score is exact.  Counts of the most frequent words (``HEAD``, a fixed number) are
in the task; all other words of a document go through a join with the table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import LOWER, batch, grouped, raw_text, rows, stage_table

ORDER = 2
BASE = 1.5  # of the logarithm that quantises counts
ENTRY_BITS = 10
PROBES = 4
SLICE_BYTES = 64 << 20  # of the filter in a task at once
HEAD = 1 << 17
BUCKET_BYTES = 8 << 20
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995, 1.0)  # tried for the lower order
END = b"\n"  # no word holds white space
CHUNK = 3 << 20  # bytes of text worked on at once
SLICED = 4 << 20  # of a filter in several slices, which are read once for each such group

BLOCK = 1 << 15

_ONE, _SIX = np.uint64(1), np.uint64(63)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Numbers(dict):
    """The next free number for each new word."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Vocabulary:
    """Numbers of the words that a task has met, with their 64-bit hashes; emptied beyond a bound."""

    def __init__(self, most: int = 1 << 17):
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.number = Numbers()
        self.hashes = np.zeros(0, np.uint64)  # of 1-grams

    @property
    def full(self) -> bool:
        return len(self.number) > self.most

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all tokens end to end, first token of each text, tokens of each text).
        Tokens are the words of a text (A-Z lower-cased, split at white space) and its end."""
        number, out = self.number, []
        for text in texts:
            words = text.translate(LOWER).split()
            words.append(END)
            out.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        have = len(self.hashes)
        if have < len(number):
            new = [xxhash.xxh3_64_intdigest(w) for w in islice(number, have, None)]
            self.hashes = np.concatenate([self.hashes, words_of(np.array(new, np.uint64))])
        size = np.array([len(x) for x in out])
        return np.concatenate(out), np.concatenate([[0], np.cumsum(size)[:-1]]), size


def words_of(hashes: np.ndarray) -> np.ndarray:
    """1-gram hashes: what the table of word counts is keyed by."""
    return mix(hashes + np.uint64(1))


def longer(grams: np.ndarray, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each token, from those of order n-1 (``grams``) and the
    1-grams (``words``).  At a text's start the history is empty."""
    before = np.zeros(len(grams), np.uint64)
    before[1:] = grams[:-1]
    before[starts] = 0
    return mix(before * _M1 + words + np.uint64(n))


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log_BASE(count))."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


#: Mean whole count of each level (level 0: 0).
_LEVEL_OF = levels(np.arange(1, 200_001))
COUNT_OF = np.array([0.0, *[float(np.flatnonzero(_LEVEL_OF == q).mean() + 1) if (_LEVEL_OF == q).any() else BASE ** (q - 0.5) for q in range(1, 90)]])
#: What a level adds to a hash.
SALTS = [np.uint64(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for q in range(len(COUNT_OF))]


def place(h: np.ndarray, level: int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit word, bits set in it) of an entry (hash, level): one memory access answers all
    probes of the entry."""
    a = mix(h + SALTS[level])
    bits = _ONE << (a & _SIX)
    for i in range(1, PROBES):
        bits |= _ONE << ((a >> np.uint64(6 * i)) & _SIX)
    return ((a >> np.uint64(32)) * words >> np.uint64(32)).astype(np.int64), bits


def spare(n: int, least: int) -> int:
    """Levels that no stored n-gram of this order lacks, and that are therefore not stored."""
    return int(levels(np.array([least]))[0]) - 1 if n > 1 else 0


def build(h: np.ndarray, q: np.ndarray) -> bytes:
    """One bucket's part of the filter, from hashes and levels."""
    words = max(1, -(-int(q.sum()) * ENTRY_BITS // 64))
    if words >= 1 << 32:
        raise ValueError("a bucket of the filter has over 2**32 words")
    out = np.zeros(words, np.uint64)
    for level in range(1, int(q.max(initial=0)) + 1):
        np.bitwise_or.at(out, *place(h[q >= level], level, np.uint64(words)))
    return out.astype("<u8").tobytes()


@dataclass
class Model:
    """What a task needs: where the filter's parts are, and the counts of the head words."""

    order: int
    least: int
    buckets: int
    slice: np.ndarray  # that holds each bucket's part
    offset: np.ndarray  # of each bucket's part in its slice, in 64-bit words
    words: np.ndarray  # of each bucket's part
    head: np.ndarray  # sorted word hashes
    head_counts: np.ndarray
    total: int
    distinct: int


class Filter:
    """The filter in one task, one slice in memory at a time."""

    def __init__(self, model: Model, slices: list[Broadcast]):
        self.model, self.slices = model, slices
        self.number, self.bits = -1, np.zeros(0, np.uint64)

    def hold(self, number: int) -> None:
        if number != self.number:
            sent, self.number, self.bits = self.slices[number], number, np.zeros(0, np.uint64)
            # not ``value``, which would keep every slice
            self.bits = sent.load_from_path(sent._path) if sent._path else sent.value

    def level(self, h: np.ndarray, n: int) -> np.ndarray:
        """The level that each n-gram of order ``n`` was stored with (0: never seen)."""
        m, out = self.model, np.zeros(len(h), np.int64)
        bucket = (n - 1) * m.buckets + (h >> np.uint64(40)).astype(np.int64) % m.buckets
        number = np.where(m.words[bucket] > 0, m.slice[bucket], -1)
        have = np.unique(number[number >= 0]).tolist()
        have.sort(key=lambda x: x != self.number)  # the one at hand first
        for k in have:
            self.hold(k)
            mine = np.flatnonzero(number == k)
            for at in range(0, len(mine), BLOCK):  # blocks that stay in the processor's cache
                some = mine[at:at + BLOCK]
                out[some] = self._level(h[some], n, bucket[some])
        return out

    def _level(self, h: np.ndarray, n: int, bucket: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(h), np.int64), np.arange(len(h))
        offset, words = self.model.offset[bucket], self.model.words[bucket].astype(np.uint64)
        above = spare(n, self.model.least)
        for level in range(1, len(COUNT_OF) - above):
            if not len(live):
                break
            at, bits = place(h, level, words)
            hit = np.flatnonzero(self.bits[offset + at] & bits == bits)
            live, h, offset, words = live[hit], h[hit], offset[hit], words[hit]
            out[live] = level + above
        return out


class Reader:
    """Probabilities of texts under a model, in one task; what single words need is kept."""

    def __init__(self, model: Model, slices: list[Broadcast], lower: list):
        self.filter, self.group = Filter(model, slices), CHUNK // 2 if len(slices) <= model.order else SLICED
        self.model, self.lower = model, lower  # share of the next lower order, by order and the history's level
        self.words = Vocabulary()
        self.level = np.zeros(0, np.int64)
        self.base = np.zeros(0)  # log10 of the base probability; nan: not among the head words

    def read(self, texts: list[bytes]):
        """(numbers, starts, sizes, levels of the 1-grams) of texts."""
        m = self.model
        if self.words.full:
            self.words.reset()
            self.level, self.base = self.level[:0], self.base[:0]
        tokens, starts, size = self.words.read(texts)
        new = self.words.hashes[len(self.level):]
        self.level = np.concatenate([self.level, self.filter.level(new, 1)])
        base = np.full(len(new), np.nan)
        if len(m.head):
            at = np.minimum(np.searchsorted(m.head, new), len(m.head) - 1)
            ok = m.head[at] == new
            base[ok] = np.log10((m.head_counts[at[ok]] + 0.5) / (m.total + 0.5 * (m.distinct + 1)))
        self.base = np.concatenate([self.base, base])
        return tokens, starts, size, self.level[tokens]

    def probabilities(self, tokens: np.ndarray, starts: np.ndarray, level: np.ndarray, upto: int):
        """(smoothed probability of each token after its history of order ``upto``; that order's
        n-gram levels; their histories' levels)."""
        m = self.model
        p = ((np.minimum(COUNT_OF, m.total) + 0.5) / (m.total + 0.5 * (m.distinct + 1)))[level]
        words = self.words.hashes[tokens]
        grams, of_gram, of_history = words, level, level
        for n in range(2, upto + 1):
            of_history = np.zeros(len(tokens), np.int64)
            of_history[1:] = of_gram[:-1]
            of_history[starts] = 0  # at a text's start only lower orders speak
            grams = longer(grams, words, starts, n)
            of_gram = self.filter.level(grams, n)
            if n < upto or len(self.lower) > n:
                share = self.lower[n][of_history]
                p = (1 - share) * ratio(COUNT_OF[of_gram], COUNT_OF[of_history]) + share * p
        return p, of_gram, of_history


def ratio(c: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.minimum(c, of) / np.maximum(of, 1)


def bucket_count(docs: DataFrame) -> int:
    """Buckets so that one holds the n-grams of about ``BUCKET_BYTES`` of text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 2)).first()[0] or 0
    return max(16, -(-total // BUCKET_BYTES))


def count_ngrams(docs: DataFrame, order: int, buckets: int, least: int) -> DataFrame:
    """(n, bucket, part, hashes, counts, total, distinct): one row per order and bucket.

    Order 1 carries its exact counts; every row carries its part of the filter.  N-grams of two
    words and more enter the filter from ``least`` occurrences."""
    schema = pa.schema([("n", pa.int32()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def send(n: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        where = (h >> np.uint64(40)).astype(np.int64) % buckets
        by = np.argsort(where, kind="stable")
        h, c = h[by], c[by].astype("<u4")
        edges = np.searchsorted(where[by], np.arange(buckets + 1))
        full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        return batch(schema, [n] * len(full), full, [h[edges[b]:edges[b + 1]].tobytes() for b in full],
                     [c[edges[b]:edges[b + 1]].tobytes() for b in full])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Vocabulary(), np.zeros(0, np.int64)
        for group in grouped((t for (t,) in rows(batches)), lambda t: len(t) + 8, CHUNK):
            tokens, starts, _ = words.read(group)
            seen = np.bincount(tokens, minlength=len(words.hashes)) + np.pad(seen, (0, len(words.hashes) - len(seen)))
            single = grams = words.hashes[tokens]
            for n in range(2, order + 1):
                grams = longer(grams, single, starts, n)
                yield send(n, *np.unique(grams, return_counts=True))
            if words.full:
                yield send(1, words.hashes, seen)
                words.reset()
                seen = seen[:0]
        if len(seen):
            yield send(1, words.hashes, seen)

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, bucket = key
        h = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["hashes"]])
        c = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
        by = np.argsort(h, kind="stable")
        h, c = h[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, c = h[first], np.add.reduceat(c, first)
        keep = c >= (1 if n == 1 else least)
        exact = n == 1
        return pd.DataFrame({"n": [n], "bucket": [bucket], "part": [build(h[keep], levels(c[keep]) - spare(n, least))],
                             "hashes": [h.tobytes() if exact else b""], "counts": [c.astype("<i8").tobytes() if exact else b""],
                             "total": [int(c.sum())], "distinct": [len(h)]})
    return (docs.select(raw_text().alias("text")).mapInArrow(local, "n int, bucket long, hashes binary, counts binary")
            .groupBy("n", "bucket").applyInPandas(merge, "n int, bucket long, part binary, hashes binary, counts binary, total long, distinct long"))


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("count", pa.int64())])
    for h, c in rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, "<i8")), pa.array(np.frombuffer(c, "<i8"))], schema=schema)


@dataclass
class Fitted:
    sent: Broadcast  # of the Model
    slices: list[Broadcast]  # of its filter
    lower: list
    words: DataFrame  # (word hash, count) of all words
    total: int
    distinct: int


def fit(docs: DataFrame, order: int = ORDER, slice_bytes: int = SLICE_BYTES, head: int = HEAD, least: int = 1) -> Fitted:
    """Model of ``docs`` (``text``).

    Counts cover all rows; a null text counts as an empty one, which is one end token."""
    buckets = bucket_count(docs)
    parts = stage_table(count_ngrams(docs, order, buckets, least), "ngrams")
    words = parts.where(F.col("n") == 1).select("hashes", "counts").mapInArrow(unpack, "word long, count long")
    sums = parts.where(F.col("n") == 1).agg(F.sum("total"), F.sum("distinct")).first()
    top = words.orderBy(F.desc("count"), "word").limit(head).select("word", "count").toPandas()
    h, c = top["word"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    by = np.argsort(h)
    # order n's part of a bucket is number (n - 1) * buckets + bucket
    part, offset, size = (np.zeros(order * buckets, np.int64) for _ in range(3))
    context, slices = docs.sparkSession.sparkContext, []
    open_: dict[int, list[tuple[int, bytes]]] = {n: [] for n in range(1, order + 1)}

    def close(n: int) -> None:
        at = 0
        for k, b in open_[n]:
            part[k], offset[k], size[k] = len(slices), at, len(b) // 8
            at += len(b) // 8
        if open_[n]:
            slices.append(context.broadcast(np.frombuffer(b"".join(b for _, b in open_[n]), "<u8")))
        open_[n] = []
    for r in parts.select("n", "bucket", "part").toLocalIterator():  # one partition in the driver at a time
        n = r["n"]
        if open_[n] and sum(len(b) for _, b in open_[n]) + len(r["part"]) > slice_bytes:
            close(n)
        open_[n].append(((n - 1) * buckets + r["bucket"], bytes(r["part"])))
    for n in open_:
        close(n)
    model = Model(order, least, buckets, part, offset, size, h[by], c[by], int(sums[0] or 0), int(sums[1] or 0))
    sent = context.broadcast(model)
    lower: list = [None, None]
    for n in range(2, order + 1):
        lower.append(shares(docs, sent, slices, lower, n, least))
    return Fitted(sent, slices, lower, words, model.total, model.distinct)


def shares(docs: DataFrame, sent: Broadcast, slices: list[Broadcast], lower: list, n: int, least: int) -> np.ndarray:
    """Best share of order n-1 by level of the history, over all training texts."""
    width = len(COUNT_OF)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(sent.value, slices, lower), np.zeros((len(SHARES), width))
        for group in grouped((t for (t,) in rows(batches)), lambda t: len(t) + 8, reader.group):
            tokens, starts, _, level = reader.read(group)
            below, of_gram, of_history = reader.probabilities(tokens, starts, level, n)
            c = COUNT_OF[of_gram] - 1
            own = ratio(np.where(c >= least, c, 0), np.maximum(COUNT_OF[of_history] - 1, 0))
            # where the order has seen nothing, the share is a plain factor of the lower order
            none = own == 0
            alone = np.bincount(of_history[none], np.log(below[none]), width)
            times = np.bincount(of_history[none], minlength=width)
            own, below, at = own[~none], below[~none], of_history[~none]
            for k, s in enumerate(SHARES):
                sums[k] += alone + times * np.log(s) + np.bincount(at, np.log((1 - s) * own + s * below), width)
        k, q = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(q), pa.array(sums[k, q])], names=["k", "q", "s"])
    found = (docs.select(raw_text().alias("text")).mapInArrow(work, "k long, q long, s double")
             .groupBy("k", "q").agg(F.sum("s").alias("s")).collect())
    table = np.full((len(SHARES), width), -np.inf)
    for r in found:
        table[r["k"], r["q"]] = r["s"]
    best = np.array(SHARES)[table.argmax(0)]
    best[np.isinf(table).all(0)] = 1.0
    best[0] = 1.0
    return best


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())])))])
SCORED_SQL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: long, times: long>>"


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of
    ``docs`` (doc_id, text, held_out).

    ``score`` is the model's log10 probability of the whole text with its end.  A null or empty
    text is its end alone; texts of any length are read whole.  With no training rows, every count is
    0; without documents there are no rows.  Repeated rows are each scored; ids may be null;
    other columns are ignored."""
    sent, slices, lower, words = fitted.sent, fitted.slices, fitted.lower, fitted.words
    divisor = fitted.total + 0.5 * (fitted.distinct + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part, at = Reader(sent.value, slices, lower), TaskContext.get().partitionId() << 40, 0
        for group in grouped(rows(batches), lambda r: len(r[1]) + 8, reader.group):
            ids, texts, held = zip(*group, strict=True)
            tokens, starts, size, level = reader.read(list(texts))
            p, _, _ = reader.probabilities(tokens, starts, level, reader.model.order)
            base = reader.base[tokens]
            unknown = np.isnan(base)
            known = np.add.reduceat((~unknown).astype(np.int64), starts)
            rest = []
            for s, n, k in zip(starts.tolist(), size.tolist(), known.tolist(), strict=True):
                if k == n:
                    rest.append([])
                    continue
                w, t = np.unique(reader.words.hashes[tokens[s:s + n][unknown[s:s + n]]].view(np.int64), return_counts=True)
                rest.append([{"word": x, "times": y} for x, y in zip(w.tolist(), t.tolist(), strict=True)])
            yield batch(SCORED, [part + at + i for i in range(len(group))], ids, held, size.tolist(), known.tolist(),
                        np.add.reduceat(np.where(unknown, 0, base), starts).tolist(), np.add.reduceat(np.log10(p), starts).tolist(), rest)
            at += len(group)
    scored = stage_table(docs.select(F.col("doc_id").cast("long"), raw_text().alias("text"), "held_out").mapInArrow(work, SCORED_SQL), "scored")
    for b in (sent, *slices):
        b.unpersist()
    rest = scored.select("row", F.inline("rest")).join(words, "word", "left")
    c = F.coalesce(F.col("count"), F.lit(0))
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(divisor))).alias("more"),
                                   F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.drop("rest").join(rest, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(fitted.total).cast("long").alias("train_tokens"),
                      (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
