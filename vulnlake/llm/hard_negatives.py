"""Hard-negative mining by angular triangle filtering.

Every vector stores its angles to a few reference directions (centroids of a bounded sample).
For an anchor and a row, the triangle inequality on the sphere puts their angle between the
largest difference and the smallest sum of two such angles.  The cosines of both ends, times the
two norms and widened by the rounding of the stored angles, bound the inner product from below
and above.  A row whose bounds miss every window still open for the anchor is never scored; first
whole tiles of rows are dismissed by their ranges of angles and norms, then single rows.  What is
left is scored in exact integers.

Rows are cut once into chunks of ``CHUNK`` rows, sorted so that a tile's rows lie close together.
Anchors are dealt to groups of about ``GROUP``.  One join pairs every group with every chunk (a
stated query set against all rows, in blocks); a pair is one row of a Python task, which returns
at most the wanted number of rows per anchor, and Spark keeps the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import batch, stage_table

REFERENCES = 32
SAMPLE = 4096
CHUNK = 32_768
TILE = 512
GROUP = 2048
#: Radians by which a stored (32-bit) angle may be off, with room.
SLACK = 1e-6

CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("dims", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()),
                          ("anchor", pa.binary()), ("norms", pa.binary()), ("angles", pa.binary()), ("vectors", pa.binary())])
CHUNK_SQL = "chunk long, kind string, dims long, ids binary, labels binary, anchor binary, norms binary, angles binary, vectors binary"
CHUNK_FIELDS = CHUNK_SCHEMA.names[1:]


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(label: Column, vector: Column) -> Column:
    """True for rows with a label and a vector whose components are all there and finite."""
    finite = lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def padded(vectors: list, least: int = 0) -> np.ndarray:
    """Vectors as one array of whole numbers, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), max([least, *map(len, vectors)])), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def directions(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids of a sample: spread out first, then a few rounds of spherical k-means."""
    x = unit(sample.astype(float))
    x = x[(x != 0).any(1)]
    if not len(x):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(count, len(x)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, nearest, x)
        moved = unit(total)
        centre = np.where((moved != 0).any(1, keepdims=True), moved, centre)
    return centre


def angles_to(vectors: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angle of each vector to each reference; 0 for a vector of zeros, whose norm bounds it anyway."""
    both = max(vectors.shape[1], refs.shape[1])
    v, r = (np.pad(a, ((0, 0), (0, both - a.shape[1]))) for a in (vectors.astype(float), refs))
    cos = np.divide(v @ r.T, norms[:, None], out=np.ones((len(v), len(r))), where=norms[:, None] > 0)
    return np.arccos(np.clip(cos, -1, 1)).astype("<f4")


def chunk_of(number: int, ids: list, labels: list, anchor: list, vectors: list, refs: np.ndarray) -> tuple:
    """One chunk, its rows ordered by nearest reference, then by the angle to it."""
    x = padded(vectors)
    norms = np.sqrt((x.astype(float) ** 2).sum(1))
    angles = angles_to(x, norms, refs)
    order = np.lexsort((angles.min(1), angles.argmin(1))) if len(refs) else np.arange(len(x))
    top = int(np.abs(x).max(initial=0))
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    parts = (np.array(ids, "<i8"), np.array(labels, "<i8"), np.array(anchor, "u1"), norms, angles, x.astype(kind))
    return number, kind, x.shape[1], *(p[order].tobytes() for p in parts)


class Rows:
    """A chunk, or a group of anchors, unpacked."""

    def __init__(self, kind: str, dims: int, ids: bytes, labels: bytes, anchor: bytes, norms: bytes, angles: bytes, vectors: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        n = len(self.ids)
        self.anchor = np.frombuffer(anchor, "u1").astype(bool)
        self.norms = np.frombuffer(norms, "<f8")
        self.angles = np.frombuffer(angles, "<f4").reshape(n, -1)
        self.vectors = np.frombuffer(vectors, kind).reshape(n, dims).astype(np.int64)

    def tiles(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for at in range(0, len(self.ids), TILE):
            s = slice(at, at + TILE)
            yield s, self.angles[s].min(0, initial=4), self.angles[s].max(0, initial=0)


def bounds(norm_a: np.ndarray, norm_x: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products from norms and the range of the angle, widened for rounding."""
    size = norm_a[:, None] * norm_x[None, :]
    room = 1 + 1e-9 * size
    return (size * np.cos(np.minimum(most + 2 * SLACK, np.pi)) - room, size * np.cos(np.maximum(least - 2 * SLACK, 0)) + room)


def angle_range(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest angle between rows of ``a`` and ``x`` by their angles to the references."""
    least, most = np.zeros((len(a), len(x)), np.float32), np.full((len(a), len(x)), np.pi, np.float32)
    for r in range(a.shape[1]):
        one, other = a[:, r, None], x[None, :, r]
        np.maximum(least, np.abs(one - other), out=least)
        both = one + other
        np.minimum(most, np.minimum(both, 2 * np.float32(np.pi) - both), out=most)
    return least, most


def products(x: np.ndarray, a: np.ndarray, size: float) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``a``; ``size``: the largest product of norms."""
    dims = min(x.shape[1], len(a))
    x, a = x[:, :dims], a[:dims]
    if size < 2**52:
        return (x.astype(float) @ a.astype(float)).astype(np.int64)
    if size < 2**62:
        return x @ a
    exact = x.astype(object) @ a.astype(object) if dims else np.zeros(len(x), object)
    return np.array([int(v) for v in exact], np.int64)  # raises beyond 64 bits


class Best:
    """The best ``most`` (score, id) of a window, by score, ties by smaller id."""

    def __init__(self, least: float, top: float, most: int):
        self.least, self.top, self.most = least, top, most
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.least) & (scores <= self.top)
        if not fit.any():
            return
        scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
        keep = np.lexsort((ids, -scores))[:self.most]
        self.scores, self.ids = scores[keep], ids[keep]
        if len(keep) == self.most:
            self.least = max(self.least, int(self.scores[-1]))


def search(rows: Rows, anchors: Rows, windows: list[list[Best]], same: bool) -> int:
    """Fill the windows of every anchor from the rows of its own label (``same``, itself left
    out) or of all others.  Returns the number of rows scored."""
    scored = 0
    open_ = np.array([bool(w) for w in windows], bool)
    for s, low, high in rows.tiles():
        least = np.array([min((w.least for w in ws), default=np.inf) for ws in windows])
        top = np.array([max((w.top for w in ws), default=-np.inf) for ws in windows])
        norms = rows.norms[s]
        gap = np.maximum(np.maximum(low - anchors.angles, anchors.angles - high), 0).max(1, initial=0)
        ends = np.array([norms.min(), norms.max()])
        _, most = bounds(anchors.norms, ends, gap[:, None], np.full((len(gap), 1), np.pi))
        live = np.flatnonzero(open_ & (most.max(1) >= least))
        if not len(live):
            continue
        low_s, high_s = bounds(anchors.norms[live], norms, *angle_range(anchors.angles[live], rows.angles[s]))
        fit = (high_s >= least[live, None]) & (low_s <= top[live, None])
        alike = anchors.labels[live, None] == rows.labels[None, s]
        fit &= alike if same else ~alike
        if same:
            fit &= anchors.ids[live, None] != rows.ids[None, s]
        ids, vectors, widest = rows.ids[s], rows.vectors[s], float(norms.max())
        for j in np.flatnonzero(fit.any(1)):
            a, at = live[j], np.flatnonzero(fit[j])
            if len(windows[a]) > 1:  # rows between two windows are in neither
                at = at[np.any([(high_s[j, at] >= w.least) & (low_s[j, at] <= w.top) for w in windows[a]], axis=0)]
            scores = products(vectors[at], anchors.vectors[a], anchors.norms[a] * widest)
            scored += len(at)
            for w in windows[a]:
                w.add(scores, ids[at])
    return scored


def chunks(rows: DataFrame, refs: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, label, anchor, vector of whole numbers) as chunks, in the shared folder."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, ([], [], [], [])
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                for column, got in zip(held, part.columns[:3], strict=False):
                    column.extend(got.to_pylist())
                held[3].extend(np.array(v.as_py(), np.int64) for v in part.column(3))
                while len(held[0]) >= chunk:
                    yield batch(CHUNK_SCHEMA, *zip(chunk_of(number, *(c[:chunk] for c in held), refs), strict=True))
                    number, held = number + 1, tuple(c[chunk:] for c in held)
        if held[0]:
            yield batch(CHUNK_SCHEMA, *zip(chunk_of(number, *held, refs), strict=True))
    return stage_table(rows.select("vec_id", "label", "anchor", "vector").mapInArrow(work, CHUNK_SQL), "vectors")


ANCHOR = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("norm", pa.float64()), ("angles", pa.binary()), ("vector", pa.binary())])
ANCHOR_SQL = "vec_id long, label long, norm double, angles binary, vector binary"


def anchors_of(stored: DataFrame) -> DataFrame:
    """The anchors among the chunks; one row an id (of repeated ones that with the smallest label, then bytes of its vector)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                r = Rows(**row)
                at = np.flatnonzero(r.anchor)
                if len(at):
                    yield batch(ANCHOR, r.ids[at], r.labels[at], r.norms[at], [r.angles[i].tobytes() for i in at], [r.vectors[i].astype("<i8").tobytes() for i in at])
    found = stored.select(*CHUNK_FIELDS).mapInArrow(work, ANCHOR_SQL)
    one = F.min(F.struct("label", "vector", "norm", "angles")).alias("a")
    return found.groupBy("vec_id").agg(one).select("vec_id", "a.label", "a.norm", "a.angles", "a.vector")


FOUND = pa.schema([("anchor_id", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor_id long, window long, vec_id long, score long"


def best_rows(stored: DataFrame, count: int, anchors: DataFrame, groups: int, same: bool, most: int) -> DataFrame:
    """The ``most`` best rows (anchor_id, window, vec_id, score, rank) in every window of every
    anchor.  ``anchors`` has a column ``windows``: [(least, top)], null ends being open."""
    fields = ["vec_id", "label", "norm", "angles", "vector", "windows"]
    dealt = (anchors.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
             .groupBy("g").agg(F.collect_list(F.struct(*fields)).alias("anchors"))  # ids are unique: about GROUP a group
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(F.col("k").cast("long").alias("k"), "anchors"))
    pairs = stored.withColumn("k", F.pmod(F.xxhash64("chunk"), F.lit(count)).cast("long")).join(dealt, "k").select(*CHUNK_FIELDS, "anchors")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                mine = row.column(len(CHUNK_FIELDS)).flatten().to_pylist()
                rows = Rows(*(row.column(j)[0].as_py() for j in range(len(CHUNK_FIELDS))))
                vectors = padded([np.frombuffer(a["vector"], "<i8") for a in mine])
                parts = (np.array([a[f] for a in mine], t).tobytes() for f, t in (("vec_id", "<i8"), ("label", "<i8")))
                group = Rows("<i8", vectors.shape[1], *parts, bytes(len(mine)), np.array([a["norm"] for a in mine]).tobytes(),
                             b"".join(a["angles"] for a in mine), vectors.tobytes())
                windows = [[Best(-np.inf if w["least"] is None else w["least"], np.inf if w["top"] is None else w["top"], most) for w in a["windows"]] for a in mine]
                search(rows, group, windows, same)
                out = [(a["vec_id"], n, w.ids, w.scores) for a, ws in zip(mine, windows, strict=True) for n, w in enumerate(ws, 1) if len(w.ids)]
                if out:
                    size = [len(o[2]) for o in out]
                    yield batch(FOUND, np.repeat([o[0] for o in out], size), np.repeat([o[1] for o in out], size),
                                np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out]))
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return pairs.mapInArrow(work, FOUND_SQL).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   references: int = REFERENCES, sample: int = SAMPLE, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, vector (whole numbers), anchor (boolean).  An anchor's positives are its best
    ``positives`` other rows of its label by inner product; a positive's negatives are the best
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.
    Ties go to the smaller vec_id.  Other columns are ignored.

    Rows without vec_id, label or vector take no part.  Repeated rows are each a candidate, but an
    id is one anchor (that with the smallest label, then the smallest little-endian bytes), and its
    own rows are never its positives.  Vectors may differ in length: the
    shorter one counts as filled with zeros; one of zeros scores 0 with all.  Anchors with no
    positive, and windows with no row, return nothing; an empty table returns no rows.  A
    score beyond 64 bits raises.

    The references are fitted to at most ``sample`` rows (smallest hash of the id), which steers
    speed alone: every row is stored and every bound is safe for any references."""
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"), F.col("vector").cast("array<long>").alias("vector"))
    some = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).collect()
    refs = directions(padded([r["vector"] for r in some]), references)
    stored = chunks(rows, refs, chunk)
    count = max(1, stored.count())
    anchors = stage_table(anchors_of(stored), "anchors")
    groups = max(1, -(-anchors.count() // group))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("top")))
    near = stage_table(best_rows(stored, count, anchors.withColumn("windows", whole), groups, True, positives)
                       .select("anchor_id", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"),
                               F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score").cast("decimal(38,0)")
    least = F.ceil(p * low / F.lit(100).cast("decimal(3,0)")).cast("long")
    top = F.floor(p * high / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = (near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", least.alias("least"), top.alias("top")))).alias("w"))
               .select(F.col("anchor_id").alias("vec_id"), F.transform("w", lambda w: F.struct(w["least"].alias("least"), w["top"].alias("top"))).alias("windows")))
    far = best_rows(stored, count, anchors.join(windows, "vec_id"), groups, False, negatives)
    return (far.join(near, ["anchor_id", "window"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
