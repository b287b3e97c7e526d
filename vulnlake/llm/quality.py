"""Quality by compression: two zstandard dictionaries, one built from good and one from
bad labelled text.  A text is compressed with both; the normalised difference of the sizes
says which dictionary knows it better, and a logistic regression turns it into a score.

A dictionary helps only at the start of a frame, so a text is compressed in blocks of
``BLOCK`` bytes, each on its own; all blocks of the whole text count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import batch, grouped, logistic, raw_text, rows, sample_per_class, sigmoid

BLOCK = 1024
DICTIONARY = 64 * 1024
SAMPLE_DOCS = 6_000
SAMPLE_BLOCKS = 6_000
LEVEL = 1

OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("difference", pa.float64())])
OUT_SQL = "doc_id long, held_out boolean, score double, difference double"


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


class Compressor:
    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        def of(d: bytes):
            data = zstandard.ZstdCompressionDict(d)
            data.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=data, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.both = of(good), of(bad)

    def features(self, text: bytes, block: int = BLOCK) -> list[float]:
        """Normalised size difference (positive: the good dictionary fits better) of the whole text
        and of its worst block, the share of blocks that fit the bad one, and the log ratios of
        the two sizes to the text."""
        if not text:
            return [0.0] * 5
        parts = [text[i:i + block] for i in range(0, len(text), block)]
        if len(parts) > 1 and len(parts[-1]) < block // 2:
            parts[-2:] = [parts[-2] + parts[-1]]
        g, b = (np.array([len(c.compress(p)) for p in parts], float) for c in self.both)
        each = (b - g) / np.maximum(b, g)
        return [float((b.sum() - g.sum()) / max(b.sum(), g.sum())), float(each.min()), float((each < 0).mean()),
                float(np.log(g.sum() / len(text))), float(np.log(b.sum() / len(text)))]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(expand(features) @ self.weights)


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products with the difference, and a constant."""
    x = np.asarray(x, float).reshape(-1, 5)
    return np.hstack([x, x**2, x[:, :1] * x[:, 1:], np.ones((len(x), 1))])


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = SAMPLE_DOCS, blocks_per_class: int = SAMPLE_BLOCKS) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0/1), all training rows.

    Of each label at most ``docs_per_class`` documents are used (smallest id hash): half of them
    give the dictionaries (``blocks_per_class`` blocks at most), half the calibration, weighted to
    the labels' own shares.  Without documents of both labels every score is the share of good
    ones (0.5 without any)."""
    shares = {int(r["label"]): r["count"] for r in labels.where(F.col("label").isNotNull()).groupBy("label").count().collect()}
    pick = sample_per_class(labels, docs_per_class)
    use = docs.select("doc_id", raw_text().alias("text")).join(F.broadcast(pick), "doc_id")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int64()), ("block", pa.binary())])
        blocks = ((label, text[i:i + BLOCK]) for text, label in rows(batches) for i in range(0, len(text), BLOCK))
        for group in grouped(blocks, lambda r: 1, 4096):
            yield batch(schema, *zip(*group, strict=True))
    blocks = use.where(half == 0).select("text", F.col("label").cast("long")).mapInArrow(cut, "label long, block binary")
    samples = {}
    for label in (1, 0):
        few = blocks.where(F.col("label") == label).orderBy(F.xxhash64("block"), "block").limit(blocks_per_class)
        samples[label] = [bytes(r["block"]) for r in few.collect()]
    good, bad = (dictionary(samples[k], DICTIONARY) for k in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int64()), ("x", pa.list_(pa.float64()))])
        c = Compressor(good, bad)
        for group in grouped(rows(batches), lambda r: len(r[0]), 1 << 22):
            yield batch(schema, [r[1] for r in group], [c.features(r[0]) for r in group])
    found = use.where(half == 1).select("text", F.col("label").cast("long")).mapInArrow(measure, "label long, x array<double>").collect()
    y = np.array([r["label"] for r in found], float)
    has = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, shares.get(1, 1) / has[1], shares.get(0, 1) / has[0])
    if len(set(y.tolist())) < 2 or not good or not bad:
        share = float(np.average(y, weights=weight)) if len(y) else 0.5
        w = np.zeros(15)
        w[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(good or b" ", bad or b" ", w)
    x = expand(np.array([r["x"] for r in found]))[:, :-1]
    return Model(good, bad, logistic(x, y, decay=1e-2, weight=weight / weight.mean()))


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better), difference of every row of ``docs``
    (doc_id, text, held_out).

    A null or empty text has all features 0 and the score that the regression gives them.  Texts
    count whole, block by block.  Repeated rows are each scored; ids may be null; an empty table
    gives an empty result; other columns are ignored.  The model in each task is two dictionaries of 64 KB."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        c = Compressor(m.good, m.bad)
        for group in grouped(rows(batches), lambda r: len(r[1]) + 100, 1 << 22):
            x = np.array([c.features(r[1]) for r in group])
            yield batch(OUT, [r[0] for r in group], [r[2] for r in group], m.score(x).tolist(), x[:, 0].tolist())
    return docs.select(F.col("doc_id").cast("long"), raw_text().alias("text"), "held_out").mapInArrow(work, OUT_SQL)
