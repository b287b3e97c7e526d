"""Long-form (exploded) versions of the commit / repository features
(SURVEY P27-P31, A40): one row per changed file or per week, folded with
``groupBy`` + partial aggregation.  They give the same numbers as the array
forms in ``functions.features`` but never hold a commit's files or an
author's weeks in one row, so a huge commit or a hot author does not
concentrate in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.features import (
    CONFIG_PATTERNS, DEPENDENCY_PATTERNS, SECURITY_PATTERNS, TEST_PATTERNS, WEEKS_PER_YEAR,
    contains_any, parent_dir, path_depth,
)


def pattern_aggs(filename: str = "filename") -> list:
    """The P27 + P28 aggregate expressions (for use inside a caller's ``agg``)."""
    n = F.lower(F.col(filename))
    return [
        F.count_if(contains_any(n, SECURITY_PATTERNS)).alias("security_files"),
        F.count_if(contains_any(n, CONFIG_PATTERNS)).alias("config_files"),
        F.count_if(contains_any(n, DEPENDENCY_PATTERNS)).alias("dependency_files"),
        F.count_if(contains_any(n, TEST_PATTERNS)).alias("test_files"),
        F.count_distinct(parent_dir(F.col(filename))).alias("unique_directories"),
        F.coalesce(F.max(path_depth(F.col(filename))), F.lit(0)).alias("max_directory_depth"),
    ]


def file_pattern_counts_long(files: DataFrame, key: str = "sha", filename: str = "filename") -> DataFrame:
    """P27 + P28 per commit over one row per changed file."""
    return files.groupBy(key).agg(*pattern_aggs(filename))


def author_stats_long(weeks: DataFrame, key: str = "login", c: str = "c", a: str = "a", d: str = "d") -> DataFrame:
    """P30 / A40 per author over one row per week ``{c, a, d}``."""
    return weeks.groupBy(key).agg(
        F.sum(F.coalesce(F.col(c), F.lit(0))).alias("total_commits"),
        (F.sum(F.coalesce(F.col(c), F.lit(0))) / F.count(F.lit(1))).alias("average_weekly_commits"),
        F.sum(F.coalesce(F.col(a), F.lit(0))).alias("total_additions"),
        F.sum(F.coalesce(F.col(d), F.lit(0))).alias("total_deletions"),
        F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0).alias("weeks_active"),
    )


def commit_activity_long(days: DataFrame, key: str = "repository", n: str = "c") -> DataFrame:
    """P31 / A40 per repository over one row per day: total, total / 52, days with commits."""
    total = F.sum(F.coalesce(F.col(n), F.lit(0)))
    return days.groupBy(key).agg(
        total.alias("total_commits_last_year"),
        (total / F.lit(float(WEEKS_PER_YEAR))).alias("avg_commits_per_week"),
        F.count_if(F.coalesce(F.col(n), F.lit(0)) > 0).alias("days_active_last_year"),
    )


def weekly_totals(days: DataFrame, key: str, day: str = "day", c: str = "c", a: str = "a", d: str = "d") -> DataFrame:
    """Per key and Monday-start week: commits, additions, deletions, active days."""
    return days.groupBy(F.col(key), F.to_date(F.date_trunc("week", F.col(day))).alias("week")).agg(
        F.sum(c).alias("c"), F.sum(a).alias("a"), F.sum(d).alias("d"), F.count_if(F.col(c) > 0).alias("days_active"))
