"""Readers.  All use explicit schemas; bad records are kept
as rejects (``_corrupt_record``) instead of failing the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import schemas as sc
from vulnlake.sources.snapshots import read_snapshot


def read_cve_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Feed pages ``{startIndex, vulnerabilities: [{cve}]}`` -> one row per CVE with
    its page and position (feed order, for J03 / F13)."""
    pages = spark.read.schema(sc.FEED_PAGE).option("multiLine", multi_line).json(path)
    return pages.select(F.col("startIndex").alias("page"),
                        F.posexplode("vulnerabilities").alias("pos", "v")).select("page", "pos", F.col("v.cve").alias("cve"))


def _cve_reader(spark: SparkSession, path: str, glob: str, multi_line: bool) -> DataFrame:
    return (spark.read.schema(sc.CVE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("multiLine", multi_line).option("pathGlobFilter", glob).json(path)
            .withColumn("_file", F.col("_metadata.file_path")))


def read_cves(spark: SparkSession, path: str, glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """Every ``glob`` file of a directory, one document a file however it is indented
    (``multi_line=False``: JSON lines).  Records that do not parse, have a field of the wrong
    type or lack ``cve_id`` are left out here and reported by ``read_cves_rejects``."""
    df = _cve_reader(spark, path, glob, multi_line)
    return df.filter(F.col("_corrupt_record").isNull() & F.col("cve_id").isNotNull()).drop("_corrupt_record")


def read_cve_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a CVE table written by W01."""
    return read_snapshot(spark, path)


def read_cves_rejects(spark: SparkSession, path: str, glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """Exactly the records ``read_cves`` leaves out, with their file: the text as found, or the
    fields that were read where only ``cve_id`` is missing."""
    df = _cve_reader(spark, path, glob, multi_line)
    fields = F.to_json(F.struct(*[c for c in df.columns if c not in ("_corrupt_record", "_file")]))
    return (df.filter(F.col("_corrupt_record").isNotNull() | F.col("cve_id").isNull())
            .select("_file", F.coalesce("_corrupt_record", fields).alias("_corrupt_record")))


def read_payloads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Stored API payloads of one kind (a missing payload is simply no row)."""
    return spark.read.schema(sc.PAYLOADS[kind]).json(path)


PACKED = "path string, length long, content binary"


def read_patches(spark: SparkSession, path: str, name_col: str = "file_name", packed: bool = False) -> DataFrame:
    """One row per patch file with its whole text; zero-byte files give no row.
    The name comes from a ``file_name=`` partition directory when present, else from the file.
    ``packed``: the files are rows of a table (``sinks.pack_files``), whose paths are the names."""
    if packed:
        b = spark.read.schema(PACKED).parquet(path)
        return b.select(F.col("path").alias(name_col), F.col("content").cast("string").alias("text")).filter(F.length("text") > 0)
    df = spark.read.text(path, wholetext=True)
    if name_col not in df.columns:
        df = df.withColumn(name_col, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1))
    return df.select(name_col, F.col("value").alias("text")).filter(F.length("text") > 0)


def read_findings(spark: SparkSession, path: str, cve_col: str = "cve_id", multi_line: bool = True) -> DataFrame:
    """Findings JSON, one document a file however it is indented (``multi_line=False``: JSON
    lines); ``cve_id`` from the document, a ``cve_id=`` directory or else the file stem; rows
    without ``repo_name_from_patch`` or without a snippet list are dropped."""
    df = spark.read.schema(sc.FINDING).option("multiLine", multi_line).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    df = df.withColumn(cve_col, F.coalesce(F.col("cve_id"), stem))
    return df.filter(F.col("repo_name_from_patch").isNotNull() & F.col("vulnerable_snippets").isNotNull())


def read_state(spark: SparkSession, path: str, fmt: str = "table", multi_line: bool = True) -> DataFrame:
    """``fmt='table'``: ``{key, status}`` JSON lines (what W08 writes); ``'buckets'``: the
    table that ``update_state`` keeps;
    ``'object'``: one JSON object ``key -> status`` per file; ``'names'``: a JSON array of
    done names (status ``done``).  Undecodable text gives no rows."""
    if fmt == "buckets":
        return read_snapshot(spark, path).select("key", "status").filter(F.col("key").isNotNull())
    if fmt == "table":
        return spark.read.schema(sc.STATE).json(path).filter(F.col("key").isNotNull())
    # one (pretty-printed) document per file by default; ``multi_line=False`` for JSON lines
    raw = spark.read.text(path, wholetext=multi_line)
    if fmt == "object":
        m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
        return raw.select(F.explode(m).alias("key", "status"))
    arr = F.from_json(F.col("value"), T.ArrayType(T.StringType()))
    return raw.select(F.explode(arr).alias("key")).withColumn("status", F.lit("done"))


def read_scrape_index(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``cve_id -> [{url, filename}]`` -> one row per (cve_id, url, filename).  One
    (pretty-printed) index document per file by default; ``multi_line=False`` reads JSON
    lines, one object per line."""
    raw = spark.read.text(path, wholetext=multi_line)
    t = T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("url", T.StringType()),
                                                            T.StructField("filename", T.StringType())])))
    e = raw.select(F.explode(F.from_json(F.col("value"), t)).alias("cve_id", "items"))
    return e.select("cve_id", F.explode("items").alias("it")).select("cve_id", "it.url", "it.filename")


def read_snapshots(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """File contents as UTF-8 text; not UTF-8 gives null content; ``\\r\\n`` -> ``\\n``.
    ``packed``: the files are rows of a table (``sinks.pack_files``)."""
    if packed:
        b = spark.read.schema(PACKED).parquet(path)
    else:
        b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ok = F.is_valid_utf8(F.col("content"))
    text = F.when(ok, F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "\r\n?", "\n"))
    return b.select(F.col("path").alias("file"), F.col("length"), text.alias("content"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (parquet)."""
    return spark.read.parquet(path)
