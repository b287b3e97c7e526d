"""Incremental loads as Structured Streaming.

The reference's state file + skip-if-seen becomes a file-source stream with a
checkpoint: every new CVE file is read exactly once, across restarts and lost
executors, and ``trigger(availableNow=True)`` processes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.sources import snapshots as sn


def stream_cves(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a CVE directory as a stream (explicit schema)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


BUCKET = "_bucket"


def stored_keys(spark: SparkSession, sink: str, key: T.StructField, which: list[int]) -> DataFrame:
    """The keys in some buckets of a ``run_dedupe`` table; other buckets' files are not opened."""
    schema = T.StructType([key, T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(schema).parquet(sink).where(F.col(BUCKET).isin(which))


def run_dedupe(df: DataFrame, sink: str, checkpoint: str, key: str = "cve_id", buckets: int = 256, bucket: Column | None = None) -> None:
    """Append the rows of a stream whose ``key`` the parquet table ``sink`` lacks (J03),
    once a key, and wait.

    The stored table is the memory, so a row of any date counts.  It is laid out by ``bucket`` (a
    number of 0 to ``buckets`` - 1 that depends on the key alone; by default its hash), and
    a batch reads the keys of its own buckets only.  Of a key's rows in a batch the first by their
    JSON text is kept.  Null is a key like any other.  A batch that runs again after a failure,
    even one whose files were partly written, adds nothing twice."""
    spark = df.sparkSession
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)) if bucket is None else bucket
    rest = [c for c in df.columns if c != key]
    stored = df.schema[key]
    spark.createDataFrame([], T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())])).write.mode("append").parquet(sink)

    def add(batch: DataFrame, _id: int) -> None:
        one = F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_r") if rest else F.count(F.lit(1)).alias("_r")
        first = batch.groupBy(key).agg(one).select(key, *([F.col(f"_r.{c}").alias(c) for c in rest])).withColumn(BUCKET, place.cast("int"))
        first = first.persist()
        try:
            which = [r[BUCKET] for r in first.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
            seen = stored_keys(batch.sparkSession, sink, stored, which).select(F.col(key).alias("_k"), F.col(BUCKET).alias("_kb"))
            new = first.join(seen, (F.col(BUCKET) == F.col("_kb")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti")
            new.select(*df.columns, BUCKET).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(sink)
        finally:
            first.unpersist()
    df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start().awaitTermination()


def read_deduped(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The rows of a ``run_dedupe`` table."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(sink).drop(BUCKET)


def week_of(ts: str) -> Column:
    """Monday-start weeks, as ``date_trunc('week')`` has them."""
    return F.window(F.col(ts), "7 days", "7 days", "4 days")


COVERAGE = {"n_all": lambda has: F.count(F.lit(1)), "n_with": lambda has: F.count_if(F.col(has))}


def stream_weekly(df: DataFrame, ts: str = "published_date", has: str = "has_commit", delay: str = "30 days") -> DataFrame:
    """Weekly coverage (A16) on a stream.  State holds the weeks of the last ``delay``; rows
    later than that are not counted (``route_late`` sets them aside first)."""
    return (df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(week_of(ts).alias("w"))
            .agg(*[f(has).alias(n) for n, f in COVERAGE.items()]))


def route_late(df: DataFrame, on_time: str, late: str, checkpoint: str, ts: str = "published_date", delay: str = "30 days") -> None:
    """Deal the rows of a stream to the parquet tables ``on_time`` and ``late`` (one folder a batch), and wait.

    A row is late if its week ended ``delay`` or more before the newest row of all earlier
    batches: then a ``stream_weekly`` over ``on_time`` with the same ``delay`` may have dropped that week's
    state.  That stream has to run after this one and take whole batches (no limit on files).  A batch
    writes its own folder of either table and last the newest time it has seen, so that one that runs
    again gives the same rows.  Rows without a time are on time; no week counts them."""
    spark = df.sparkSession
    marks = f"{checkpoint.rstrip('/')}-marks"
    spark.createDataFrame([], "batch long, newest timestamp").coalesce(1).write.mode("append").parquet(f"{marks}/none")
    at = F.col(ts).cast("timestamp")

    def deal(batch: DataFrame, n: int) -> None:
        known = spark.read.schema("batch long, newest timestamp").parquet(f"{marks}/*")
        if known.where(F.col("batch") == n).limit(1).count():
            return  # the mark is written last: this batch is all there
        seen = known.agg(F.max("newest")).first()[0]
        week_end = F.date_trunc("week", "_ts") + F.expr("interval 7 days")
        is_late = F.lit(False) if seen is None else F.coalesce(week_end <= F.lit(seen) - F.expr(f"interval {delay}"), F.lit(False))
        rows = batch.withColumn("_ts", at).withColumn("_late", is_late).persist()
        try:
            for path, part in ((on_time, ~F.col("_late")), (late, F.col("_late"))):
                rows.where(part).drop("_ts", "_late").write.mode("overwrite").parquet(f"{path}/batch={n}")
            newest = rows.agg(F.max("_ts").alias("newest")).select(F.lit(n).cast("long").alias("batch"), "newest")
            newest.coalesce(1).write.mode("overwrite").parquet(f"{marks}/of-{n}")
        finally:
            rows.unpersist()
    df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deal).trigger(availableNow=True).start().awaitTermination()


def run_weekly(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Keep the weeks of a ``stream_weekly`` in the bucketed table ``sink``: each batch replaces the
    weeks that it changed, and a week whose state is gone keeps its last numbers."""
    def put(batch: DataFrame, _id: int) -> None:
        weeks = batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), *COVERAGE)
        sn.update_buckets(weeks, sink, "week", lambda old, new: old.join(new, "week", "left_anti").unionByName(new), buckets=16)
    df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def fold_late(weekly: DataFrame, late: DataFrame, ts: str = "published_date", has: str = "has_commit") -> DataFrame:
    """(week, n_all, n_with): streamed weeks with the late rows counted in (a batch job)."""
    rows = late.withColumn("_ts", F.col(ts).cast("timestamp")).where(F.col("_ts").isNotNull())
    more = rows.groupBy(F.date_format(F.date_trunc("week", "_ts"), "yyyy-MM-dd").alias("week")).agg(*[f(has).alias(n) for n, f in COVERAGE.items()])
    return weekly.select("week", *COVERAGE).unionByName(more).groupBy("week").agg(*[F.sum(n).alias(n) for n in COVERAGE])


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available now into a parquet table and wait.
    ``complete`` mode rewrites the table each micro-batch (``foreachBatch``)."""
    if mode == "complete":
        q = (df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
             .foreachBatch(lambda b, _id: b.write.mode("overwrite").parquet(sink))
             .trigger(availableNow=True).start())
    else:
        q = (df.writeStream.format("parquet").outputMode("append").option("path", sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
