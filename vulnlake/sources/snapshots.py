"""Versioned tables: data folders that are never changed, and a manifest written last.

A table's folder holds data folders and ``_manifest``, a small JSON line for each version: which
data folders are the table.  A writer first writes new folders and then adds its line; a reader takes
the line with the largest version.  A writer lost on the way leaves folders that no manifest
names, so readers keep the old rows, whole.

A bucketed table has one data folder for each hash bucket of a key.  A batch of changes
rewrites the buckets of its own keys; the new manifest names the old folders for all others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest"
BUCKETS = 256
#: Most buckets of a table: their folders are a list in the driver.
MOST_BUCKETS = 4096


@dataclass
class Version:
    """One version of a table: ``folders`` by bucket ("" for a table without)."""

    number: int
    fmt: str
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    buckets: int = 0
    key: str = ""
    id: str = ""


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All published versions of a table, oldest first; none if nothing was published."""
    try:
        lines = spark.read.schema("value string").text(f"{path}/{MANIFEST}").collect()  # a line a version
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted((Version(**json.loads(r["value"])) for r in lines), key=lambda v: (v.number, v.id))


def current(spark: SparkSession, path: str) -> Version | None:
    found = versions(spark, path)
    return found[-1] if found else None


def publish(spark: SparkSession, path: str, version: Version) -> Version:
    """Make a version the table's current one: one line in one new manifest file."""
    version.id = uuid.uuid4().hex[:12]
    line = json.dumps(version.__dict__, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/{MANIFEST}")
    return version


def stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> Version:
    """Write ``df`` into a new data folder of the table; it is not part of it until published."""
    old = current(df.sparkSession, path)
    number = old.number + 1 if old else 1
    folder = f"data-{number:08d}-{uuid.uuid4().hex[:12]}"
    w = df.write.format(fmt)
    (w.partitionBy(partition_by) if partition_by else w).save(f"{path}/{folder}")
    return Version(number, fmt, df.schema.json(), {"": folder})


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> Version:
    """Replace the table's rows by ``df``, which may read the table itself."""
    return publish(df.sparkSession, path, stage(df, path, fmt, partition_by))


def read_snapshot(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The table's current rows, or those of an earlier version."""
    version = version or current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of a table is published in {path}")
    schema = T.StructType.fromJson(json.loads(version.schema))
    if not version.folders:
        return spark.createDataFrame([], schema)
    # no basePath: partition columns of a data folder come from its own sub-folders
    return spark.read.schema(schema).format(version.fmt).load([f"{path}/{f}" for f in sorted(version.folders.values())])


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def touched(changes: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of a batch's keys; at most ``buckets`` numbers."""
    return sorted(r["b"] for r in changes.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect())


def read_buckets(spark: SparkSession, path: str, which: list[int], version: Version | None = None) -> DataFrame | None:
    """The current rows of some buckets of a bucketed table; None if none of them has rows."""
    version = version or current(spark, path)
    folders = {str(b): version.folders[str(b)] for b in which if str(b) in version.folders} if version else {}
    if not folders:
        return None
    return read_snapshot(spark, path, Version(version.number, version.fmt, version.schema, folders))


def update_buckets(changes: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
                   buckets: int = BUCKETS) -> Version:
    """Merge a batch into a bucketed table, whose rows all have the columns of ``changes``.

    ``merge(old, changes)`` gives the new rows of the touched buckets; only those buckets are
    read and written.  The table's own number of buckets, chosen at its first write, wins."""
    spark = changes.sparkSession
    old = current(spark, path)
    buckets = old.buckets if old else buckets
    if not 0 < buckets <= MOST_BUCKETS or old and old.key != key:
        raise ValueError(f"{buckets} buckets by {old.key if old else key}: 1 to {MOST_BUCKETS} are allowed, always by one key")
    which = touched(changes, key, buckets)
    before = read_buckets(spark, path, which, old)
    if before is None:
        before = spark.createDataFrame([], changes.schema)
    new = merge(before, changes).select(*changes.columns)
    number = old.number + 1 if old else 1
    folder = f"data-{number:08d}-{uuid.uuid4().hex[:12]}"
    by = "_bucket"
    # one task a bucket writes one file; AQE splits none of them, a bucket being small by choice of ``buckets``
    (new.withColumn(by, bucket_of(F.col(key), buckets)).repartition(len(which) or 1, by)
     .write.partitionBy(by).parquet(f"{path}/{folder}"))
    full = {r["_bucket"] for r in spark.read.schema(f"{by} int").parquet(f"{path}/{folder}").select(by).distinct().collect()} if which else set()
    folders = dict(old.folders) if old else {}
    for b in which:
        folders.pop(str(b), None)
        if b in full:
            folders[str(b)] = f"{folder}/{by}={b}"
    return publish(spark, path, Version(number, "parquet", changes.schema.json(), folders, buckets, key))
