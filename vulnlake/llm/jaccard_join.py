"""Exact Jaccard self-join of documents on word shingles, by signature trees.

1. A sketch counts how many shingle sets hold each shingle, in cells whose number follows the
   size of the texts up to ``MOST_CELLS``.  It only orders shingles (rare first), so its errors
   cost time, never links.
2. Equal sets are one class.  Two sets of the wanted similarity share a shingle among the first
   ``size - ceil(similarity * size) + 1`` of that order, so classes that share such a shingle
   form a candidate list; equal lists count once.
3. A list that is longer than ``BLOCK`` is split into blocks, each pair of blocks a work item;
   no list is gathered whole.  First every class is compared in its largest item only, which
   connects most groups; then all items that still hold several components are.
4. In a work item a signature tree holds the classes: every node has the OR of its classes'
   shingle bitmaps and their size range.  A dual traversal drops node pairs whose largest
   possible overlap or size ratio is too small.  It runs twice: over bitmaps alone, which
   leaves the classes that may have a partner, and over those with their shingles, where node
   pairs whose classes are all connected already are dropped too and what is left at the
   leaves is compared exactly.  Before the items that hold several components are compared, the
   bitmaps, and then bitmaps ``FINE`` times as wide, rule out the classes that can have no partner in
   another component; of items with equal classes left one is compared.
5. Links form components (smallest class key, label propagation over the links alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import LOWER, batch, grouped, raw_text, rows, small_batches, stage_table

#: Cells (bytes) of the sketch: one for ``CELL_TEXT`` bytes of text, between these bounds.
LEAST_CELLS, MOST_CELLS, CELL_TEXT = 1 << 20, 1 << 24, 16
CELL_BLOCK = 1 << 13
BLOCK = 1024
LEAF = 8
FINE = 4
CHUNK = 2 << 20
#: Bits of the filter of shared prefix shingles: ``TOKEN_SPACE`` a shingle, up to 64 MB.
TOKEN_SPACE, LEAST_TOKEN_CELLS, MOST_TOKEN_CELLS, TOKEN_BLOCKS = 8, 1 << 22, 1 << 29, 1 << 10
MARKS = 1 << 22
#: Words that a task remembers.
WORDS = 1 << 17
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered for one task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: Iterator[tuple], words: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(row, 64-bit hashes of the runs of ``words`` words in order) of each row, whose last
    item is the text (A-Z lower-cased, split at white space).  A shorter text is one run; no word,
    no run.  Hashes of about ``CHUNK`` bytes of text are combined at once."""
    known = WordHashes()
    for group in grouped(texts, lambda r: len(r[-1]) + 64, CHUNK):
        split = [r[-1].translate(LOWER).split() for r in group]
        size = [len(w) for w in split]
        h = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, sum(size))
        del split
        runs, out = h, [h]
        for k in range(1, words):
            runs = mix(runs[:-1] * _M1 + h[k:]) if len(h) > k else runs[:0]
            out.append(runs)
        at = 0
        for row, n in zip(group, size, strict=True):
            run = min(words, n)
            yield row, out[run - 1][at:at + n - run + 1] + np.uint64(run) if n else np.zeros(0, np.uint64)
            at += n


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a plain sort, which for one text is faster than ``np.unique``."""
    s = np.sort(values)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def shingle_sets(texts: Iterator[tuple], words: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(row, sorted distinct hashes of its runs) of each row."""
    for row, s in shingles(texts, words):
        yield row, distinct(s)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a shingle set, as two signed numbers."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def cells_of(s: np.ndarray, cells: int) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) & (cells - 1)


def power_between(n: int, least: int, most: int) -> int:
    """The power of two at or above ``n``, within bounds."""
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Level (about four a doubling) of how many sets fall on each cell; a task counts up to 255 a cell."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells = power_between(size // CELL_TEXT, LEAST_CELLS, MOST_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
        total, seen = np.zeros(cells, np.uint8), set()
        for _, s in shingles(rows(batches), words):
            if not len(s) or (key := set_key(s)) in seen:
                continue  # a copy, word by word, that this task has counted
            if len(seen) > 1 << 17:
                seen.clear()
            seen.add(key)
            at = cells_of(s, cells)
            total[at] += total[at] < 255  # once a text, however often it has the shingle
        for first in range(0, cells, CELL_BLOCK << 8):  # 2 MB a batch
            some = [i for i in range(first, min(cells, first + (CELL_BLOCK << 8)), CELL_BLOCK) if total[i:i + CELL_BLOCK].any()]
            if some:
                yield batch(schema, [i // CELL_BLOCK for i in some], [pa.compress(total[i:i + CELL_BLOCK].tobytes(), "zstd", asbytes=True) for i in some])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELL_BLOCK, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(pa.decompress(x, CELL_BLOCK, "zstd"), np.uint8)
        level = np.minimum(np.round(4 * np.log2(total + 1)), 255).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "level": [level.tobytes()]})
    out = np.zeros(cells, np.uint8)
    found = docs.mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, level binary")
    for r in found.toLocalIterator():  # at most MOST_CELLS bytes in all
        out[r["block"] * CELL_BLOCK:][:CELL_BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out


def prefix(s: np.ndarray, level: np.ndarray, least: Fraction) -> np.ndarray:
    """The shingles of ``s`` of which a similar set must share one: the first by (level, hash)."""
    n = len(s)
    size = n - -(-least.numerator * n // least.denominator) + 1
    return s[np.argsort(level[cells_of(s, len(level))], kind="stable")[:size]]


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: a power of two, at least ``n``, within bounds."""
    return 1 << min(max((n - 1).bit_length(), 8), 16)


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """Bytes with a bit for each shingle's hash modulo ``width``."""
    out = np.zeros(width, bool)
    out[((s >> np.uint64(7)) % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


class Tree:
    """Signature tree over classes sorted by size; level 0 are the classes, each node above
    covers up to ``LEAF`` of the level below."""

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        maps = np.ascontiguousarray(maps).view(np.uint64)
        spare = size - np.bitwise_count(maps).sum(1, dtype=np.int64)  # shingles beyond one a bit
        self.levels = [(maps, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, more = self.levels[-1]
            cut = np.arange(0, len(m), LEAF)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(more, cut)))

    def below(self, level: int, i: int, j: int, least: float, side: np.ndarray | None,
              known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of two nodes that may hold a similar pair (i = j: each pair once), of
        different numbers in ``known``."""
        n = len(self.levels[level - 1][0])
        a, b = np.arange(i * LEAF, min((i + 1) * LEAF, n)), np.arange(j * LEAF, min((j + 1) * LEAF, n))
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        if i == j:
            x, y = x[x <= y], y[x <= y]
        if level == 1:
            keep = x != y
            if side is not None:
                keep &= side[x] != side[y]
            if known is not None:
                keep &= known[x] != known[y]
            x, y = x[keep], y[keep]
        ok = self.possible(level - 1, x, y, least)
        return x[ok], y[ok]

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Can a class under node i and one under node j be similar?  An overlap has at most the
        common bits plus the smaller surplus, and at most the smaller set."""
        m, lo, hi, more = self.levels[level]
        most = np.bitwise_count(m[i] & m[j]).sum(1, dtype=np.int64) + np.minimum(more[i], more[j])
        most = np.minimum(most, np.minimum(hi[i], hi[j]))
        need = least / (1 + least) * (lo[i] + lo[j])
        near = (hi[i] >= least * lo[j] - 1e-6) & (hi[j] >= least * lo[i] - 1e-6)
        return near & (most >= need - 1e-6)


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return least.denominator * both >= least.numerator * (len(a) + len(b) - both)


def connected(label: np.ndarray, level: int, i: int, j: int) -> bool:
    """Do all classes under two nodes have one label?"""
    w = LEAF**level
    a, b = label[i * w:(i + 1) * w], label[j * w:(j + 1) * w]
    return a[0] == b[0] and bool((a == a[0]).all()) and bool((b == a[0]).all())


def candidates(maps: list[bytes], size: np.ndarray, least: Fraction, side: np.ndarray | None = None,
               known: np.ndarray | None = None) -> np.ndarray:
    """Which classes may have a similar one, by bitmaps alone; with ``known`` one of another number there.

    Bitmaps are as wide as sets are large; similar sets have equal widths or neighbouring ones, so
    a tree holds the classes of one width and, folded to it, those of the next that are near
    enough in size."""
    out, width = np.zeros(len(size), bool), np.array([len(m) for m in maps])
    for w in np.unique(width).tolist():
        own = width == w
        near = np.flatnonzero(own | (width == 2 * w) & (size * float(least) <= size[own].max() + 1e-6))
        data = np.array([np.frombuffer(maps[i][:w], np.uint8) | np.frombuffer(maps[i][-w:], np.uint8) for i in near])
        some = [None if x is None else x[near] for x in (side, known)]
        out[near[possible_partners(data, size[near], float(least), *some)]] = True
    return out


def possible_partners(maps: np.ndarray, size: np.ndarray, least: float, side: np.ndarray | None,
                      known: np.ndarray | None = None) -> np.ndarray:
    """Dual traversal over one tree.  Node pairs whose classes are all known to have a possible
    partner, or are all of one number in ``known``, are not opened."""
    order = np.argsort(size, kind="stable")
    side, known = (None if x is None else x[order] for x in (side, known))
    tree, may = Tree(maps[order], size[order]), np.zeros(len(size), bool)
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        w = LEAF**level
        if level == 0 or (may[i * w:(i + 1) * w].all() and may[j * w:(j + 1) * w].all()) or known is not None and connected(known, level, i, j):
            continue
        x, y = tree.below(level, i, j, least, side, known)
        if level == 1:
            may[x] = may[y] = True
        else:
            by = np.argsort(x == y, kind="stable")
            stack.extend((level - 1, p, q) for p, q in zip(x[by].tolist(), y[by].tolist(), strict=True))
    return order[may]


def link(sets: list[np.ndarray], least: Fraction, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs (positions in ``sets``); with ``side`` (0/1) only pairs
    across the sides are looked at, with ``known`` only pairs of different numbers there."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable").tolist()
    sets = [sets[i] for i in order]
    side = None if side is None else side[order]
    width = width_of(int(size.max()))
    tree = Tree(np.array([bitmap(s, width) for s in sets]), size[order])
    label, out = np.arange(len(sets)) if known is None else known[order].copy(), []
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            if label[i] != label[j] and similar(sets[i], sets[j], least):
                out.append((order[i], order[j]))
                label[label == label[j]] = label[i]
            continue
        if connected(label, level, i, j):
            continue
        x, y = tree.below(level, i, j, float(least), side)
        # pairs of a node with itself go last on the stack and come first: what they connect spares the others
        by = np.argsort(x == y, kind="stable")
        stack.extend((level - 1, p, q) for p, q in zip(x[by].tolist(), y[by].tolist(), strict=True))
    return out


ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("prefix", pa.list_(pa.int64())),
                  ("bits", pa.binary())])
ROWS_SQL = "doc_id long, n long, a long, b long, prefix array<long>, bits binary"


def classes(docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """(doc_id, n, a, b, prefix, bits) of every row; a task gives a class's prefix and bitmap once.  Without words
    n is 0 and the key null."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs.select("text"), words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        def one(found):
            (doc, _), s = found
            if not len(s):
                return doc, 0, None, None, [], None
            key = set_key(s)
            if key in seen:
                return doc, len(s), *key, [], None
            if len(seen) > 1 << 17:
                seen.clear()
            seen.add(key)
            return doc, len(s), *key, prefix(s, sent.value, least).view(np.int64), bitmap(s, width_of(len(s))).tobytes()
        for group in grouped(map(one, shingle_sets(rows(batches), words)), lambda r: len(r[4]) + 40, 1 << 18):
            yield batch(ROWS, *zip(*group, strict=True))
    return docs.select("doc_id", "text").mapInArrow(work, ROWS_SQL)


def fine_bitmaps(sets: DataFrame) -> DataFrame:
    """(a, b, n, fine): bitmaps ``FINE`` times as wide of classes (a, b, shingles), a fraction of the
    shingles' bytes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("fine", pa.binary())])
        for b in batches:
            found = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column(2)]
            yield batch(schema, b.column(0), b.column(1), [len(s) for s in found], [bitmap(s, FINE * width_of(len(s))).tobytes() for s in found])
    return sets.select("a", "b", "shingles").mapInArrow(work, "a long, b long, n long, fine binary")


def unequal(items: DataFrame) -> DataFrame:
    """The rows of one of all work items that hold the same classes on the same sides."""
    mark = F.xxhash64("a", "b", "side")
    once = (items.groupBy("list", "i", "j").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(mark).alias("x"), F.sum(mark % (1 << 40)).alias("y"))
            .groupBy("m", "x", "y").agg(F.min(F.struct("list", "i", "j")).alias("w")).select("w.list", "w.i", "w.j"))
    return items.join(once, ["list", "i", "j"], "left_semi")


class Marks:
    """Bitmap of cells; a value's cell is its bits from the 20th on, modulo their number."""

    def __init__(self, count: int):
        self.count, self.bytes = count, np.zeros(count // 8, np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = cell_of(values, self.count)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def marked(cells: DataFrame, count: int, blocks: int, least: int) -> Marks:
    """The cells, of ``count``, in which some value of ``cells`` (values array<long>) occurs ``least``
    times or more.  Tasks send distinct values with counts as arrays, by block of cells; what
    reaches the driver is the bitmap."""
    schema = pa.schema([("block", pa.int32()), ("values", pa.binary()), ("times", pa.binary())])
    width = count // blocks

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, t = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            where = cell_of(v, count) // width
            by = np.argsort(where, kind="stable")
            v, t = v[by], np.minimum(t[by], 65535).astype("<u2")
            edges = np.searchsorted(where[by], np.arange(blocks + 1))
            full = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
            yield batch(schema, full, [v[edges[k]:edges[k + 1]].tobytes() for k in full], [t[edges[k]:edges[k + 1]].tobytes() for k in full])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["values"]])
        t = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["times"]])
        v, back = np.unique(v, return_inverse=True)
        on = np.zeros(width, bool)
        on[cell_of(v[np.bincount(back, t) >= least], count) % width] = True
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})
    out = Marks(count)
    found = cells.mapInArrow(local, "block int, values binary, times binary").groupBy("block").applyInPandas(merge, "block int, bits binary")
    for r in found.toLocalIterator():
        out.bytes[r["block"] * width // 8:(r["block"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def cell_of(values: np.ndarray, count: int) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (count - 1)


def sets_of(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(a, b, shingles) once for each class in ``keys`` (a, b, each once), with what else ``keys`` has.  A bitmap of
    fixed size drops most other documents before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(marked(keys.select(F.array("a").alias("v")), MARKS, 256, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shingles", pa.binary())])
        seen = set()
        def some():
            for _, s in shingle_sets(rows(batches), words):
                if not len(s):
                    continue
                key = set_key(s)
                if key not in seen and sent.value.has(np.array(key[:1], np.int64))[0]:
                    if len(seen) > 1 << 17:
                        seen.clear()
                    seen.add(key)
                    yield *key, s.tobytes()
        for group in grouped(some(), lambda r: len(r[-1]), 1 << 21):
            yield batch(schema, *zip(*group, strict=True))
    found = docs.select("text").mapInArrow(work, "a long, b long, shingles binary")
    return found.join(keys, ["a", "b"]).dropDuplicates(["a", "b"])


def sets_among(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, shingles) of the classes in ``keys``, and of a few more: a bitmap of fixed size drops most others."""
    sent = sets.sparkSession.sparkContext.broadcast(marked(keys.select(F.array("a").alias("v")), MARKS, 256, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.has(b.column(0).to_numpy())))
    return sets.select("a", "b", "shingles").mapInArrow(work, "a long, b long, shingles binary")


def shared_tokens(prefixes: DataFrame) -> DataFrame:
    """(a, b, token) of prefix shingles, almost only of those that several classes have; a
    bitmap drops most others before the shuffle."""
    size = prefixes.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    cells = power_between(TOKEN_SPACE * size, LEAST_TOKEN_CELLS, MOST_TOKEN_CELLS)
    sent = prefixes.sparkSession.sparkContext.broadcast(marked(prefixes.select("prefix"), cells, TOKEN_BLOCKS, 2))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64())])
        for b in batches:
            size = np.asarray(b.column(2).value_lengths())
            token = b.column(2).flatten().to_numpy(zero_copy_only=False)
            on = sent.value.has(token)
            columns = [np.repeat(b.column(k).to_numpy(), size)[on] for k in (0, 1)] + [token[on]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
    return prefixes.select("a", "b", "prefix").mapInArrow(work, "a long, b long, token long")


def work_items(prefixes: DataFrame, block: int) -> DataFrame:
    """(list, i, j, side, a, b): the classes of every work item.  ``i``, ``j``: the two blocks of the list."""
    tokens = stage_table(shared_tokens(prefixes), "tokens")
    many = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = stage_table(tokens.join(many, "token"), "shared")
    mark = F.xxhash64("a", "b")
    once = (shared.groupBy("token", "m").agg(F.bit_xor(mark).alias("x"), F.sum(mark % (1 << 40)).alias("y"))
            .groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token"))
    parts = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("b", "a"), F.col("parts")).cast("int")
    every = shared.join(once, "token", "left_semi").withColumn("parts", parts).withColumn("own", own)
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return every.select(F.col("token").alias("list"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "a", "b")


def sides(key, table) -> np.ndarray | None:
    """The block of each class, where a work item has two."""
    return np.array(table["side"].to_pylist()) if key[1].as_py() != key[2].as_py() else None


def links(docs: DataFrame, found: DataFrame, words: int, least: Fraction, block: int) -> DataFrame:
    """(a1, b1, a2, b2): similar classes, enough of them to connect all that are connected."""
    one = stage_table(found.where(F.size("prefix") > 0).select("a", "b", "n", "prefix", "bits").dropDuplicates(["a", "b"]), "one")
    items = work_items(one.select("a", "b", "prefix"), block)

    def prune(key, table):
        may = candidates(table["bits"].to_pylist(), table["n"].to_numpy(), least, sides(key, table))
        return table.filter(pa.array(may)).select(["list", "i", "j", "side", "a", "b"])

    def prune_known(key, table):
        known = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        may = candidates(table.column(table.num_columns - 1).to_pylist(), table["n"].to_numpy(), least, sides(key, table), known)
        return table.filter(pa.array(may)).select([*columns, "component"])

    def compare(key, table):
        a, b = table["a"].to_pylist(), table["b"].to_pylist()
        known = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        pairs = link([np.frombuffer(x, "<u8") for x in table["shingles"].to_pylist()], least, sides(key, table), known)
        ends = [[a[i] for i, _ in pairs], [b[i] for i, _ in pairs], [a[j] for _, j in pairs], [b[j] for _, j in pairs]]
        return pa.table([pa.array(x, pa.int64()) for x in ends], names=["a1", "b1", "a2", "b2"])
    columns, columns_sql = ["list", "i", "j", "side", "a", "b"], "list long, i int, j int, side int, a long, b long"
    bits = one.select("a", "b", "n", "bits")
    items = items.join(bits, ["a", "b"]).select(*columns, "n", "bits")
    items = stage_table(items.groupBy("list", "i", "j").applyInArrow(prune, columns_sql), "items")
    # first each class in its largest list only; then the lists that still hold several components
    where = F.struct("list", "i", "j")
    size = items.groupBy("list", "i", "j").agg(F.count(F.lit(1)).alias("size"))
    largest = items.join(size, ["list", "i", "j"]).groupBy("a", "b").agg(F.max_by(F.struct("list", "i", "j", "side"), F.struct("size", where)).alias("w"))
    sets = stage_table(sets_of(docs, largest.select("a", "b", "w.list", "w.i", "w.j", "w.side"), words), "sets")

    def linked(rows_: DataFrame) -> DataFrame:
        return stage_table(rows_.select(*columns, "component", "shingles").groupBy("list", "i", "j")
                           .applyInArrow(compare, "a1 long, b1 long, a2 long, b2 long").distinct(), "edges")
    first = linked(sets.withColumn("component", F.xxhash64("a", "b")))
    label = components(first).select("a", "b", F.xxhash64("ra", "rb").alias("component"))
    rest = stage_table(items.join(label, ["a", "b"], "left").withColumn("component", F.coalesce("component", F.xxhash64("a", "b"))), "rest")
    mixed = rest.groupBy("list", "i", "j").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    rest = rest.join(mixed, ["list", "i", "j"], "left_semi").join(bits, ["a", "b"]).select(*columns, "component", "n", "bits")
    rest = stage_table(rest.groupBy("list", "i", "j").applyInArrow(prune_known, f"{columns_sql}, component long"), "mixed")
    rest = unequal(rest).join(fine_bitmaps(sets), ["a", "b"]).select(*columns, "component", "n", "fine")
    rest = unequal(stage_table(rest.groupBy("list", "i", "j").applyInArrow(prune_known, f"{columns_sql}, component long"), "near"))
    rest = stage_table(rest, "last")
    return first.unionByName(linked(rest.join(sets_among(sets, rest.select("a", "b").distinct()), ["a", "b"])))


def components(edges: DataFrame) -> DataFrame:
    """(a, b, ra, rb): the smallest class key that each linked class reaches.

    Alternating steps over the links: every class takes the smallest label around it, then the
    label of its label; ends when nothing changes.  Only linked classes take part."""
    one, two = F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b"))
    both = stage_table(edges.select(one.alias("u"), two.alias("v")).unionByName(edges.select(two.alias("u"), one.alias("v"))), "links")
    label = stage_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("r")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("r").alias("m"))
        step = label.join(near, "u").select("u", "r", F.least("r", "m").alias("m"))
        jump = label.select(F.col("u").alias("m"), F.col("r").alias("far"))
        new = stage_table(step.join(jump, "m", "left").select("u", "r", F.least("m", F.coalesce("far", "m")).alias("new")), "labels")
        changed = new.where(F.col("r") != F.col("new")).limit(1).count()
        label = new.select("u", F.col("new").alias("r"))
        if not changed:
            return label.select("u.a", "u.b", F.col("r.a").alias("ra"), F.col("r.b").alias("rb"))


def jaccard_join(docs: DataFrame, words: int = 5, least: Fraction = Fraction(4, 5), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``least``; ``component_id`` is the smallest doc_id that links reach, the row's own
    included.  A text with fewer words is one shingle; null or wordless texts have none and are
    linked with nothing.  Rows with a null id count as texts: they get the smallest id of their
    component, null if it has none.  Repeated rows are copies of each other.  Texts of any length
    are read whole, in memory in proportion to the longest.  Other columns are ignored; an empty
    table gives an empty result."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), raw_text().alias("text"))
    found = stage_table(classes(docs, words, least), "classes")
    label = components(links(docs, found, words, least, block))
    by_class = (found.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least_id"))
                .join(label, ["a", "b"], "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}))
    by_component = by_class.groupBy("ra", "rb").agg(F.min("least_id").alias("component"))
    by_class = by_class.join(by_component, ["ra", "rb"]).select("a", "b", "component")
    out = found.select("doc_id", "n", "a", "b").join(by_class, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
