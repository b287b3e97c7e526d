"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.session import checkpoint_dir

#: A-Z to a-z, everything else untouched.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """True for rows no model may learn from; a null id is never held out."""
    return F.coalesce(fold(id_col, parts) == part, F.lit(False))


def raw_text(col: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty; Python tasks then need no decoding."""
    return F.coalesce(F.col(col).cast("binary"), F.lit("").cast("binary"))


#: Writer options for rows of many MB: a row group for each few of them (by default a row group and
#: its pages are looked at after 100 rows), so that neither writer nor reader holds a file at once.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
              "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


def stage_table(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files) and keeps expensive
    Python passes from running twice."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Arrow batches of at most ``records`` rows for this session, unless it asks for fewer: whole
    texts in the default 10,000 fill tens of MB on both sides of every Python task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = int(spark.conf.get(key))
    if not 0 < asked <= records:
        spark.conf.set(key, str(records))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """All rows of Arrow batches as tuples, one batch in memory at a time, sliced so that a
    batch of very long texts is not turned into Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` through ``work``, which keeps its columns, whatever their names hold (``mapInArrow``
    reads a dot in a name as a field)."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in work(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, df.schema)


def grouped(items: Iterator, size, most: int) -> Iterator[list]:
    """Lists of consecutive items whose sizes sum to about ``most``; one larger item stands alone."""
    out, total = [], 0
    for x in items:
        n = size(x)
        if out and total + n > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += n
    if out:
        yield out


def sample_per_class(labelled: DataFrame, most: int, salts: int = 16) -> DataFrame:
    """At most ``most`` (doc_id, label) rows of each label, those with the smallest id hash.

    Nulls in either column are left out; an id with several labels counts once, with the
    largest.  Ranked in (label, salt) first, so that a task of the second ranking gets at most
    ``most`` * ``salts`` rows of a label, however many there are."""
    one = (labelled.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    h = F.xxhash64("doc_id")
    first = Window.partitionBy("label", "_s").orderBy(h, "doc_id")
    last = Window.partitionBy("label").orderBy(h, "doc_id")
    few = one.withColumn("_s", F.pmod(h, F.lit(salts))).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    return few.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= most).select("doc_id", "label")


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, steps: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (last one: the constant) of a ridge logistic regression, by Newton steps;
    ``weight``: of each row."""
    weight = np.ones(len(x)) if weight is None else weight
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], decay)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        w -= np.linalg.solve(h, g)
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
