"""Commit-data coverage over time and its linear trend.

Coverage is one pass: ``count`` and ``count_if`` in the same aggregate (the
reference builds two frames and divides them, J16).  The regressions run on
the *bucketed* rows (one per month or week), never on raw CVEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.features import safe_corr

from vulnlake.functions.cve import ordinal_day

BUCKETS = ("year", "month", "week")


def bucket(ts: Column, by: str) -> Column:
    if by == "year":
        return F.year(ts).cast("bigint")
    if by == "month":
        return F.to_date(F.date_trunc("month", ts))
    if by == "week":
        return F.to_date(F.date_trunc("week", ts))  # Monday start
    raise ValueError(by)


def coverage(df: DataFrame, has: str = "has_commit") -> DataFrame:
    """A14 total: all CVEs, with commit data, percent (0 when there are none)."""
    n = F.count(F.lit(1))
    w = F.count_if(F.col(has))
    return df.agg(n.alias("n_all"), w.alias("n_with"),
                  F.coalesce(F.try_divide(w * 100.0, n), F.lit(0.0)).alias("pct"))


def coverage_by(df: DataFrame, by: str, date: str = "published_date", has: str = "has_commit") -> DataFrame:
    """A14 by year, A15 by month, A16 by week.  Buckets with no CVE are absent."""
    n = F.count(F.lit(1))
    w = F.count_if(F.col(has))
    return (df.groupBy(bucket(F.col(date), by).alias("bucket"))
            .agg(n.alias("n_all"), w.alias("n_with"),
                 F.coalesce(F.try_divide(w * 100.0, n), F.lit(0.0)).alias("pct"))
            .orderBy("bucket"))


def time_regression(cov: DataFrame, y: str) -> DataFrame:
    """A17 (``y='n_with'``: only buckets with at least one) and A18 (``y='pct'``:
    all buckets).  x = ordinal day of the bucket start.  Ledger L6."""
    src = cov.filter(F.col("n_with") > 0) if y == "n_with" else cov
    x = ordinal_day(F.col("bucket")).cast("double")
    yy = F.col(y).cast("double")
    src = src.select(x.alias("x"), yy.alias("y"))
    r2 = F.regr_r2("y", "x")
    se = F.try_divide(F.sqrt(F.try_divide((F.lit(1.0) - r2) * F.regr_syy("y", "x"), F.regr_count("y", "x") - 2)),
                      F.sqrt(F.regr_sxx("y", "x")))
    return src.agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        safe_corr("y", "x").alias("r"),
        r2.alias("r2"),
        se.alias("std_err"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    )


def regression_line(fit: DataFrame) -> DataFrame:
    """Fitted value at the smallest and largest x."""
    return fit.select(
        "slope", "intercept",
        (F.col("slope") * F.col("x_min") + F.col("intercept")).alias("y_at_min"),
        (F.col("slope") * F.col("x_max") + F.col("intercept")).alias("y_at_max"),
    )
