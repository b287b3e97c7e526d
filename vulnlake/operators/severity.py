"""Severity analyses.  Each is one ``groupBy`` with
partial (map-side) aggregation: the shuffle carries one row per group and
partition, whatever the number of CVEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.functions.cve import SEVERITY_LEVELS, severity, year_text


def overview(df: DataFrame, score: str = "cvss_score", repo: str = "repository") -> DataFrame:
    """Total CVEs, distinct repositories, sum of truthy scores / *all* CVEs."""
    s = F.col(score)
    return df.agg(
        F.count(F.lit(1)).alias("total_vulnerabilities"),
        F.count_distinct(F.col(repo)).alias("unique_repositories"),
        F.try_divide(F.sum(F.when(s.isNotNull() & (s != 0), s).otherwise(F.lit(0.0))),
                     F.count(F.lit(1)).cast("double")).alias("avg_cvss_score"),
    )


def count_by_year(df: DataFrame, date: str = "published_date") -> DataFrame:
    """Count by the first four characters of the published date, ordered."""
    return (df.groupBy(year_text(F.col(date).cast("string")).alias("year"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("year"))


def severity_summary(df: DataFrame, score: str = "cvss_score") -> DataFrame:
    """Rows, mean score, percent Critical (apply F04 + F03 first)."""
    sev = severity(F.col(score))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        (F.avg(F.when(sev == "Critical", 1.0).otherwise(0.0)) * 100).alias("pct_critical"),
    )


def severity_distribution(df: DataFrame, score: str = "cvss_score") -> DataFrame:
    """A04 + F17: count and share of each severity, by count descending.

    The share uses ``sum() over ()`` on the *grouped* rows (four of them), so
    the unpartitioned window never sees more than four rows.
    """
    g = df.groupBy(severity(F.col(score)).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return (g.withColumn("pct", g.n * 100.0 / F.sum("n").over(Window.partitionBy()))
            .orderBy(F.desc("n"), "severity"))


def yearly_trend(df: DataFrame, score: str = "cvss_score", date: str = "published_date") -> DataFrame:
    """Per year mean score, count, percent Critical."""
    sev = severity(F.col(score))
    return (df.groupBy(F.year(date).alias("year"))
            .agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"),
                 (F.avg(F.when(sev == "Critical", 1.0).otherwise(0.0)) * 100).alias("pct_critical"))
            .orderBy("year"))


def _month(date: str):
    return F.to_date(F.date_trunc("month", F.col(date))).alias("month")


def monthly_severity(df: DataFrame, score: str = "cvss_score", date: str = "published_date") -> DataFrame:
    """Month x severity counts, wide; absent cells 0; only months that occur.

    The four severity values are given explicitly (stable schema, no extra
    job to discover pivot values), as conditional counts in one aggregate.
    """
    sev = severity(F.col(score))
    return df.groupBy(_month(date)).agg(
        *[F.count_if(sev == lvl).alias(lvl.lower()) for lvl in SEVERITY_LEVELS])


def monthly_total(df: DataFrame, date: str = "published_date") -> DataFrame:
    """A07."""
    return df.groupBy(_month(date)).agg(F.count(F.lit(1)).alias("total"))


def monthly_severity_pct(df: DataFrame, score: str = "cvss_score", date: str = "published_date") -> DataFrame:
    """A06 / A07 * 100, computed in the same single aggregate."""
    sev = severity(F.col(score))
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [(F.count_if(sev == lvl) * 100.0 / F.count(F.lit(1))).alias(f"pct_{lvl.lower()}")
             for lvl in SEVERITY_LEVELS]
    return df.groupBy(_month(date)).agg(*aggs)
