"""Row filters.  All are plain ``filter`` calls, so Catalyst
pushes them into the parquet scan whenever the column is a stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _truthy_str(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def with_repository(df: DataFrame, col: str = "repository") -> DataFrame:
    """repository not null and not empty."""
    return df.filter(_truthy_str(F.col(col)))


def published_since(df: DataFrame, start, col: str = "published_date") -> DataFrame:
    """published on or after ``start`` (a date; midnight)."""
    return df.filter(F.col(col) >= F.to_timestamp(F.lit(str(start))))


def year_between(df: DataFrame, first: int = 2017, last: int = 2024, col: str = "published_date") -> DataFrame:
    """calendar year in [first, last], both ends inclusive.

    Written as a timestamp range (not ``year(col) between``) so the bound is a
    plain comparison on the stored column and reaches the parquet scan.
    """
    lo = F.to_timestamp(F.lit(f"{first:04d}-01-01 00:00:00"))
    hi = F.to_timestamp(F.lit(f"{last + 1:04d}-01-01 00:00:00"))
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def scored(df: DataFrame, policy: str, col: str = "cvss_score", require: list[str] | None = None) -> DataFrame:
    """The three score policies (ledger L1, L2).  ``policy`` is required.

    * ``"truthy"``   : null *and* 0.0 dropped (F04)
    * ``"not_null"`` : null dropped, 0.0 kept; ``require`` columns must be non-null too (F05)
    * ``"zero"``     : null becomes 0.0, every row kept (F06)
    """
    s = F.col(col)
    if policy == "truthy":
        return df.filter(s.isNotNull() & (s != 0))
    if policy == "not_null":
        cond = s.isNotNull()
        for r in require or []:
            cond = cond & F.col(r).isNotNull()
        return df.filter(cond)
    if policy == "zero":
        return df.withColumn(col, F.coalesce(s, F.lit(0.0)))
    raise ValueError(f"unknown score policy {policy!r}")


def has_commit(df: DataFrame, details: str = "fix_commit_details", need_date: bool = False,
               date_col: str = "commit_date") -> DataFrame:
    """commit details present; with ``need_date`` also a commit date."""
    cond = F.col(details).isNotNull()
    if need_date:
        cond = cond & F.col(date_col).isNotNull()
    return df.filter(cond)


def needs_enrichment(df: DataFrame, details: str = "fix_commit_details", context: str = "repository_context",
                     done: DataFrame | None = None, key: str = "cve_id") -> DataFrame:
    """commit details or repository context missing; rows already done are skipped."""
    out = df.filter(F.col(details).isNull() | F.col(context).isNull())
    if done is not None:
        out = out.join(done.select(key).distinct(), key, "left_anti")
    return out


def complete_snippets(df: DataFrame, path: str = "file_path", lines: str = "line_numbers",
                      commits: str = "introducing_commits") -> DataFrame:
    """file path, line numbers and introducing commits all non-empty."""
    return df.filter(_truthy_str(F.col(path)) & (F.coalesce(F.size(lines), F.lit(0)) > 0)
                     & (F.coalesce(F.size(commits), F.lit(0)) > 0))


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """keep rows whose columns are all finite numbers."""
    cond = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        cond = cond & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.filter(cond)


def urls_of(refs: DataFrame, cve: str = "cve_id", url: str = "url") -> DataFrame:
    """reference rows with a URL and a CVE id."""
    return refs.filter(_truthy_str(F.col(url)) & _truthy_str(F.col(cve)))
