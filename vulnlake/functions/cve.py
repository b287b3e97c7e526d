"""CVE-record functions: flatten, CWE pick, references, GitHub summary,
metadata, severity, timestamps and time parts (SURVEY P17-P25, P36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions import urls

# Severity cut points (CVSS v3 qualitative scale as used by the analyses).
SEVERITY_LEVELS = ["Critical", "High", "Medium", "Low"]
CRITICAL_MIN, HIGH_MIN, MEDIUM_MIN = 9.0, 7.0, 4.0
# Weekday names, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Day number of 1970-01-01 when 0001-01-01 is day 1 (proleptic Gregorian ordinal).
EPOCH_ORDINAL = 719163


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flatten_cve(raw: DataFrame, cve_col: str = "cve") -> DataFrame:
    """One raw NVD ``cve`` struct -> flat vulnerability fields.

    Score, vector, attack vector and complexity come from the *first*
    ``cvssMetricV31`` entry; description from the first ``descriptions`` entry.
    """
    c = F.col(cve_col)
    m = F.get(c["metrics"]["cvssMetricV31"], 0)["cvssData"]
    return raw.select(
        "*",
        c["id"].alias("cve_id"),
        m["baseScore"].cast("double").alias("cvss_score"),
        m["vectorString"].alias("cvss_vector"),
        m["attackVector"].alias("attack_vector"),
        m["attackComplexity"].alias("attack_complexity"),
        first_cwe(c["weaknesses"]).alias("cwe_id"),
        F.get(c["descriptions"], 0)["value"].alias("description"),
        c["published"].alias("published_date"),
        c["lastModified"].alias("last_modified"),
        norm_refs(c["references"]).alias("references"),
    )


def first_cwe(weaknesses) -> Column:
    """In the first weakness only, the first description value starting ``CWE-``."""
    desc = F.get(_c(weaknesses), 0)["description"]
    vals = F.transform(desc, lambda d: d["value"])
    return F.get(F.filter(vals, lambda v: v.startswith("CWE-")), 0)


def norm_refs(refs) -> Column:
    """Keep url, source, tags (tags default to an empty list)."""
    return F.transform(F.coalesce(_c(refs), F.array()), lambda r: F.struct(
        r["url"].alias("url"), r["source"].alias("source"),
        F.coalesce(r["tags"], F.array().cast("array<string>")).alias("tags")))


def github_summary(refs) -> Column:
    """P20 over an ordered array of reference structs.

    repository = last GitHub match with 3+ path parts; fix_commit = first
    non-empty commit; related_commits = every commit in order; patch_url = last
    GitHub ``.patch`` URL.
    """
    urls_ = F.transform(F.coalesce(_c(refs), F.array()), lambda r: F.coalesce(r["url"], F.lit("")))
    gh = F.filter(urls_, lambda u: urls.is_github(u))
    repos = F.filter(F.transform(gh, lambda u: urls.github_repo(u)), lambda x: x.isNotNull())
    commits = F.filter(F.transform(gh, lambda u: urls.github_commit(u)), lambda x: x.isNotNull())
    patches = F.filter(gh, lambda u: u.endswith(".patch"))
    return F.struct(
        F.try_element_at(repos, F.lit(-1)).alias("repository"),
        F.get(F.filter(commits, lambda x: x != ""), 0).alias("fix_commit"),
        commits.alias("related_commits"),
        F.try_element_at(patches, F.lit(-1)).alias("patch_url"),
    )


def with_metadata(df: DataFrame, status: str, now: str | None = None) -> DataFrame:
    """``collection_metadata`` = (collected_at, processing_status)."""
    at = F.lit(now) if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumn("collection_metadata", F.struct(at.alias("collected_at"), F.lit(status).alias("processing_status")))


def severity(score, unknown: str | None = None) -> Column:
    """>=9 Critical, >=7 High, >=4 Medium, else Low; null -> ``unknown``."""
    s = _c(score)
    out = (F.when(s >= CRITICAL_MIN, F.lit("Critical")).when(s >= HIGH_MIN, F.lit("High"))
           .when(s >= MEDIUM_MIN, F.lit("Medium")).when(s.isNotNull(), F.lit("Low")))
    return out if unknown is None else F.coalesce(out, F.lit(unknown))


def parse_ts(s, strict: bool = False) -> Column:
    """ISO-8601 text -> timestamp (UTC session).  ``Z`` / offsets honoured;
    bad text gives null.  ``strict`` needs a fractional second (``%Y-%m-%dT%H:%M:%S.%f``)."""
    c = _c(s)
    if isinstance(c, Column) and strict:
        ok = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}$")
        return F.when(ok, F.try_to_timestamp(c))
    return F.try_to_timestamp(c)


def weekday_index(ts) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(_c(ts))


def weekday_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def time_parts(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """Year, month, first of month, Monday of week, weekday name, hour."""
    t = F.col(ts)
    return df.select(
        "*",
        F.year(t).alias(prefix + "year"),
        F.month(t).alias(prefix + "month"),
        F.to_date(F.date_trunc("month", t)).alias(prefix + "month_start"),
        F.to_date(F.date_trunc("week", t)).alias(prefix + "week_start"),
        weekday_name(t).alias(prefix + "weekday"),
        F.hour(t).alias(prefix + "hour"),
    )


def year_text(s) -> Column:
    """Year as the first four characters of the raw text."""
    return F.substring(_c(s).cast("string"), 1, 4)


def is_working_hours(ts) -> Column:
    """P25: hour 9..17 inclusive and Monday-Friday."""
    t = _c(ts)
    return F.hour(t).between(9, 17) & (F.weekday(t) < 5)


def ordinal_day(d) -> Column:
    """Day number with 0001-01-01 = 1."""
    return (F.unix_date(F.to_date(_c(d))) + F.lit(EPOCH_ORDINAL)).cast("bigint")
