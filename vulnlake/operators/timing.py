"""Commit-timing analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.cve import is_working_hours, weekday_index, weekday_name


def timing_coverage(df: DataFrame, has: str = "has_commit") -> DataFrame:
    """All rows count in the total; percent with a commit date (null for 0 rows)."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(has)).alias("with_date"),
        F.try_divide(F.count_if(F.col(has)) * 100.0, F.count(F.lit(1))).alias("pct"),
    )


def weekday_hour(df: DataFrame, ts: str = "commit_ts") -> DataFrame:
    """A10: rows Monday..Sunday, one count column per hour (explicit 0..23: one
    aggregate, stable schema), ordered by weekday."""
    t = F.col(ts)
    return (df.groupBy(weekday_index(t).alias("weekday_idx"), weekday_name(t).alias("weekday"))
            .agg(*[F.count_if(F.hour(t) == h).alias(f"h{h:02d}") for h in range(24)])
            .orderBy("weekday_idx"))


def top_days(df: DataFrame, n: int = 5, ts: str = "commit_ts") -> DataFrame:
    """The ``n`` most common weekdays; ties by name."""
    return (df.groupBy(weekday_name(F.col(ts)).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "weekday").limit(n))


def top_hours(df: DataFrame, n: int = 5, ts: str = "commit_ts") -> DataFrame:
    """The ``n`` most common hours; ties by hour."""
    return (df.groupBy(F.hour(F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "hour").limit(n))


def working_share(df: DataFrame, ts: str = "commit_ts") -> DataFrame:
    """Percent of commits in working hours (P25) and its complement."""
    w = F.avg(F.when(is_working_hours(F.col(ts)), 1.0).otherwise(0.0)) * 100
    return df.agg(w.alias("pct_working"), (F.lit(100.0) - w).alias("pct_off"))
