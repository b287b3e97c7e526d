"""Work-state bookkeeping as tables: the reference
keeps JSON state files; here a state is a ``(key, status)`` DataFrame and every
step is a join or an aggregate over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_summary(state: DataFrame) -> DataFrame:
    """success = status exactly ``success``; every other status counts as failed."""
    return state.agg(F.count_if(F.col("status") == "success").alias("success"),
                     F.count_if(F.col("status") != "success").alias("failed"))


def run_counts(named: dict[str, DataFrame]) -> DataFrame:
    """One ``(name, n)`` row per work list (a union of one-row aggregates)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def latest_result(results: DataFrame, key: str = "key", seq: str = "seq", value: str = "result") -> DataFrame:
    """Per key the value with the highest sequence number (last write wins)."""
    return results.groupBy(key).agg(F.max_by(F.col(value), F.col(seq)).alias(value))


def distinct_repos(df: DataFrame, repo: str = "repository") -> DataFrame:
    """Distinct non-empty repositories."""
    return df.select(repo).filter(F.col(repo).isNotNull() & (F.col(repo) != "")).distinct()


def union_done(*sets: DataFrame) -> DataFrame:
    """Union of done sets, duplicates removed."""
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()
