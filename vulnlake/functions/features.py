"""Commit and repository features.

Array arguments are processed with Spark's higher-order functions so a
commit's files stay inside the row; the ``*_long`` forms in
``operators.features`` do the same work on exploded rows for commits too
large for one array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case substrings tested against changed file names.
SECURITY_PATTERNS = ["security", "auth", "crypto", "password", "secret", "key"]
CONFIG_PATTERNS = ["config", "settings", ".env", ".ini", ".yml", ".json"]
DEPENDENCY_PATTERNS = ["requirements.txt", "package.json", "gemfile", "cargo.toml"]
TEST_PATTERNS = ["test"]
# Substrings of a lower-cased commit message that mark an issue reference.
ISSUE_WORDS = ["fix", "close", "resolve", "issue", "#"]
WEEKS_PER_YEAR = 52


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(s: Column, patterns: list[str]) -> Column:
    out = None
    for p in patterns:
        t = F.contains(s, F.lit(p))
        out = t if out is None else (out | t)
    return out


def message_features(msg) -> Column:
    """Title (first line), length, has_description (more than one line), references_issue."""
    m = _c(msg)
    lines = F.split(m, "\n")
    return F.struct(
        F.get(lines, 0).alias("title"),
        F.length(m).alias("length"),
        (F.size(lines) > 1).alias("has_description"),
        contains_any(F.lower(m), ISSUE_WORDS).alias("references_issue"),
    )


def _count(names: Column, patterns: list[str]) -> Column:
    return F.size(F.filter(names, lambda n: contains_any(F.lower(n), patterns)))


def parent_dir(path) -> Column:
    """Parent directory of a relative path; ``.`` for a file at the root."""
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def path_depth(path) -> Column:
    """Number of path parts minus one."""
    return F.size(F.filter(F.split(_c(path), "/"), lambda x: x != "")) - 1


def file_pattern_counts(filenames) -> Column:
    """P27 + P28 over an array of file names."""
    names = F.coalesce(_c(filenames), F.array().cast("array<string>"))
    return F.struct(
        _count(names, SECURITY_PATTERNS).alias("security_files"),
        _count(names, CONFIG_PATTERNS).alias("config_files"),
        _count(names, DEPENDENCY_PATTERNS).alias("dependency_files"),
        _count(names, TEST_PATTERNS).alias("test_files"),
        F.size(F.array_distinct(F.transform(names, parent_dir))).alias("unique_directories"),
        F.coalesce(F.array_max(F.transform(names, path_depth)), F.lit(0)).alias("max_directory_depth"),
    )


def changed_files(files) -> Column:
    """Project each changed file to filename, status, additions, deletions, patch."""
    return F.transform(F.coalesce(_c(files), F.array()), lambda f: F.struct(
        f["filename"].alias("filename"), f["status"].alias("status"),
        f["additions"].alias("additions"), f["deletions"].alias("deletions"), f["patch"].alias("patch")))


def author_stats(weeks) -> Column:
    """P30 over the matched contributor's ``weeks`` array of ``{c, a, d}``."""
    w = _c(weeks)
    total = F.aggregate(w, F.lit(0).cast("double"), lambda acc, x: acc + F.coalesce(x["c"], F.lit(0)).cast("double"))
    n = F.size(w)
    return F.when(w.isNotNull(), F.struct(
        total.alias("total_commits"),
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("average_weekly_commits"),
        F.aggregate(w, F.lit(0).cast("double"), lambda acc, x: acc + F.coalesce(x["a"], F.lit(0)).cast("double")).alias("total_additions"),
        F.aggregate(w, F.lit(0).cast("double"), lambda acc, x: acc + F.coalesce(x["d"], F.lit(0)).cast("double")).alias("total_deletions"),
        F.size(F.filter(w, lambda x: F.coalesce(x["c"], F.lit(0)) > 0)).alias("weeks_active"),
    ))


def commit_activity(weeks) -> Column:
    """P31 over ``[{total, days[7]}]``: sum of totals, total / 52, days with commits."""
    w = F.coalesce(_c(weeks), F.array())
    total = F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["total"], F.lit(0)).cast("bigint"))
    days = F.flatten(F.transform(w, lambda x: F.coalesce(x["days"], F.array().cast("array<bigint>"))))
    return F.struct(
        total.alias("total_commits_last_year"),
        F.when(F.size(w) > 0, total / F.lit(float(WEEKS_PER_YEAR))).otherwise(F.lit(0.0)).alias("avg_commits_per_week"),
        F.size(F.filter(days, lambda d: d > 0)).alias("days_active_last_year"),
    )


def vuln_density(count, size) -> Column:
    """Count / size in KB; a zero size gives null (not inf)."""
    return F.try_divide(_c(count).cast("double"), _c(size).cast("double"))


def log10_col(c) -> Column:
    """log10, null at <= 0 (numpy would give -inf)."""
    x = _c(c).cast("double")
    return F.when(x > 0, F.log10(x))


def safe_corr(x, y) -> Column:
    """Pearson correlation over the rows where both are present; null (not an ANSI
    divide-by-zero error) when either side has no variance."""
    xc, yc = _c(x).cast("double"), _c(y).cast("double")
    xm = F.when(yc.isNotNull(), xc)
    ym = F.when(xc.isNotNull(), yc)
    return F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))
