"""Writers.  Each is a distributed write of a DataFrame; none
gathers a table in the driver or in one task unless the output is, by its
nature, one small report (W03 / W04 take ``single_file`` for that)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.operators import chunks, joins
from vulnlake.sources.snapshots import BUCKETS, update_buckets, write_snapshot


def write_cves(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, versioned: bool = True) -> None:
    """CVEs with a truthy repository; parquet by default (JSON on request).

    Each write is a new version of the table (``sources.snapshots``), which may read the old one; a
    reader sees the old rows until the new ones are all there.  ``read_cve_table`` reads it.
    ``versioned=False``: the files themselves in ``path``, for use outside the library."""
    out = df.filter(F.col("github_data.repository").isNotNull() & (F.col("github_data.repository") != "")) \
        if "github_data" in df.columns else df
    if versioned:
        write_snapshot(out, path, fmt, partition_by)
        return
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    (w.json(path) if fmt == "json" else w.parquet(path))


def write_repos(df: DataFrame, path: str, repo: str = "repository") -> None:
    """One document per repository."""
    df.dropDuplicates([repo]).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header (grouped metrics are small: one file on request)."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_report(lines: DataFrame, path: str, order: str = "n", text: str = "line") -> None:
    """A text report from ordered ``(n, line)`` rows."""
    lines.orderBy(order).select(text).coalesce(1).write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str, key: str = "cve_id", value: str = "result") -> None:
    """JSON lines ``{cve_id: result}``, appended."""
    df.select(F.to_json(F.create_map(F.col(key), F.col(value))).alias("value")).write.mode("append").text(path)


def write_findings(df: DataFrame, path: str, key: str = "cve_id") -> None:
    """Only CVEs with at least one snippet; keeps the repository and the snippets.  One table
    with the CVE as a column, not one directory per CVE."""
    (df.filter(F.size("vulnerable_snippets") > 0)
       .select(key, "repo_name_from_patch", "vulnerable_snippets")
       .write.mode("overwrite").json(path))


def write_finding_rows(df: DataFrame, path: str, key: str = "cve_id", most: int = 1000) -> None:
    """W06 from one row a snippet (``key``, repo_name_from_patch, file_path, line_numbers,
    introducing_commits): documents of about ``most`` snippets, several for a CVE that has
    more, which ``read_findings`` reads like any others."""
    item = F.struct("file_path", "line_numbers", "introducing_commits")
    lists = chunks.list_chunks(df, [key, "repo_name_from_patch"], F.struct("file_path", F.to_json(F.struct("line_numbers"))), item, most)
    lists.select(key, "repo_name_from_patch", F.col("items").alias("vulnerable_snippets")).write.mode("overwrite").json(path)


def write_snippets(df: DataFrame, path: str) -> None:
    """Snippet text plus metadata, one row per (cve, full file path); the
    basename-collision behaviour of the reference is the F14 parity view."""
    df.select("cve_id", "file_path", "line_numbers", "introducing_commit", "label", "code") \
      .write.mode("overwrite").json(path)


def pack_files(df: DataFrame, path: str, name: str, text: str) -> None:
    """Text files as rows (path, length, content) of one table, which ``read_patches`` and
    ``read_snapshots`` read: a file per text takes a listing and a commit of as many names.

    Each text is written with a final newline, a null one as an empty line; texts of one name (null
    is a name) are one file, as ``partitionBy`` writes them."""
    line = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    one = df.repartition(F.col(name)).groupBy(F.col(name).alias("path")).agg(F.array_join(F.collect_list(line), "").alias("content"))
    (one.select("path", F.octet_length("content").cast("long").alias("length"), F.col("content").cast("binary").alias("content"))
     .write.mode("overwrite").option("compression", "zstd").parquet(path))


def write_state(df: DataFrame, path: str) -> None:
    """The (key, status) table, as JSON lines."""
    df.select("key", "status").write.mode("overwrite").json(path)


def update_state(new: DataFrame, path: str, overwrite: bool = True, buckets: int = BUCKETS) -> None:
    """Put (key, status) rows into the stored state table ``path``.

    The table is bucketed by key; only the buckets of the new keys are read and written, and
    readers keep the old state until all of them are.  ``overwrite``: a new status replaces the
    stored one, else it only fills absent keys.  A key that comes twice takes its largest status."""
    once = new.select("key", "status").groupBy("key").agg(F.max("status").alias("status"))
    update_buckets(once, path, "key", lambda old, one: joins.upsert_state(old, one, overwrite), buckets)
