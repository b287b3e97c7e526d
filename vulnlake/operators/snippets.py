"""Labelled code snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.text import basename, extension, is_valid_commit

LABEL = "vulnerable"


def first_commit(df: DataFrame, commits: str = "introducing_commits") -> DataFrame:
    """only the *first* (line, sha) entry is tested and used (ledger L10)."""
    first = F.get(F.col(commits), 0)["sha"]
    return df.withColumn("introducing_commit", first).filter(is_valid_commit(F.col("introducing_commit")))


def join_content(snippets: DataFrame, snapshots: DataFrame, repo: str = "repo_name", sha: str = "introducing_commit",
                 path: str = "file_path") -> DataFrame:
    """Each snippet with the file content at its introducing commit (re-aimed from a
    checkout: ``snapshots`` is (repo_name, sha, path, content))."""
    s = snapshots.select(F.col(repo).alias("_r"), F.col("sha").alias("_s"), F.col("path").alias("_p"), "content")
    return snippets.join(s, (snippets[repo] == s["_r"]) & (snippets[sha] == s["_s"]) & (snippets[path] == s["_p"]),
                         "left").drop("_r", "_s", "_p")


def snippet_rows(df: DataFrame, content: str = "content", lines: str = "line_numbers") -> DataFrame:
    """X14 + X15: cut the snippet; rows whose cut is empty (failure) are dropped; label added."""
    from vulnlake.functions.text import with_snippet
    return (with_snippet(df, content, lines, "code")
            .filter(F.col("code").isNotNull())
            .withColumn("label", F.lit(LABEL)))


def snippets_per_cve(snippets: DataFrame, cves: DataFrame, key: str = "cve_id") -> DataFrame:
    """Snippets per CVE; a CVE with none counts 0 (partial count, then a left join)."""
    n = snippets.groupBy(key).agg(F.count(F.lit(1)).alias("n_snippets"))
    return cves.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n_snippets", F.lit(0)).alias("n_snippets"))


def snippets_per_extension(snippets: DataFrame, path: str = "file_path", parity: bool = False) -> DataFrame:
    """By the source file's extension; ``parity=True`` reproduces the reference's
    always-``.txt`` count (ledger L8)."""
    ext = F.lit(".txt") if parity else extension(F.col(path))
    return snippets.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def list_snippets(snippets: DataFrame, key: str = "cve_id", path: str = "file_path",
                  prefix_chars: int = 2) -> DataFrame:
    """Per CVE its snippet files in name order, one row per (cve, file) with its rank
    (a long form: no per-CVE list is built in one row).  The rank is computed per
    (CVE, name prefix) and shifted by the counts of earlier prefixes, so a CVE with a
    huge number of snippets is not sorted in one task."""
    from vulnlake.operators.windows import rank_in_group
    d = snippets.select(key, F.concat(basename(F.col(path)), F.lit(".txt")).alias("file"), F.col(path).alias("_p"))
    r = rank_in_group(d, key, "file", "_p", bucket=F.substring(F.col("file"), 1, prefix_chars))
    return r.select(key, "file", "rank")
