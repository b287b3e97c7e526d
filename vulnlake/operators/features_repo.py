"""Repository and commit feature assembly from the stored payload tables
(``schemas.PAYLOADS``).  Every payload is reduced to one row per repository or author before
it is joined; a commit's files stay inside their payload row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.features import WEEKS_PER_YEAR, changed_files, file_pattern_counts, message_features

REPO_KEYS = ["owner", "repo"]
SURROUNDING = 5


def _or(c: str, default: bool) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _left(left: DataFrame, right: DataFrame | None, keys: list[str], missing: dict[str, str]) -> DataFrame:
    """Left join; without a right side its columns are null."""
    if right is None:
        return left.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()})
    return left.join(right, keys, "left")


def repo_features(repos: DataFrame, policy: DataFrame | None = None, branches: DataFrame | None = None,
                  languages: DataFrame | None = None, activity: DataFrame | None = None) -> DataFrame:
    """One row per repository payload, with its policy, branch, language and activity payloads.

    ``has_security_policy``: a policy payload that is not empty.  Protected branches are their
    names, in name order.  Absent flags are false, an absent ``allow_forking`` true.  Without
    activity rows its three numbers are 0; without a language payload ``languages`` is null."""
    pol = None if policy is None else policy.groupBy(*REPO_KEYS).agg(
        F.max(F.coalesce(F.size("policy") > 0, F.lit(False))).alias("_policy"))
    prot = None if branches is None else branches.where(_or("protected", False)).groupBy(*REPO_KEYS).agg(
        F.sort_array(F.collect_list("name")).alias("_protected"))
    lang = None if languages is None else languages.groupBy(*REPO_KEYS).agg(
        F.first("languages", ignorenulls=True).alias("_languages"))
    act = None if activity is None else activity.groupBy(*REPO_KEYS).agg(
        F.sum(F.coalesce("total", F.lit(0))).alias("_total"),
        F.sum(F.coalesce(F.size(F.filter("days", lambda d: d > 0)), F.lit(0))).alias("_days"))
    r = _left(repos, pol, REPO_KEYS, {"_policy": "boolean"})
    r = _left(r, prot, REPO_KEYS, {"_protected": "array<string>"})
    r = _left(r, lang, REPO_KEYS, {"_languages": "map<string,bigint>"})
    r = _left(r, act, REPO_KEYS, {"_total": "bigint", "_days": "bigint"})
    names = F.coalesce(F.col("_protected"), F.array().cast("array<string>"))
    total = F.coalesce(F.col("_total"), F.lit(0))
    return r.select(
        F.concat_ws("/", "owner", "repo").alias("repository"),
        "name", "owner", "created_at", "updated_at", "pushed_at", "size",
        F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"),
        F.col("open_issues_count").alias("open_issues"), F.col("watchers_count").alias("watchers"),
        _or("_policy", False).alias("has_security_policy"), "default_branch",
        names.alias("protected_branches"), F.col("_languages").alias("languages"),
        F.struct(total.alias("total_commits_last_year"),
                 (total / F.lit(float(WEEKS_PER_YEAR))).alias("avg_commits_per_week"),
                 F.coalesce(F.col("_days"), F.lit(0)).alias("days_active_last_year")).alias("commit_activity"),
        F.struct(_or("_policy", False).alias("has_security_policy"), (F.size(names) > 0).alias("has_protected_branches"),
                 _or("has_wiki", False).alias("has_wiki"), _or("has_issues", False).alias("has_issues"),
                 _or("allow_forking", True).alias("allow_forking"), _or("is_template", False).alias("is_template"),
                 F.col("license.key").alias("license")).alias("security_features"),
    )


def commit_features(commits: DataFrame, author_stats: DataFrame | None = None, stats_keys: list[str] | None = None,
                    surrounding: DataFrame | None = None, files_as: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per commit payload: author, message, stats, files (P29), file patterns
    and the first five surrounding commits (F15).

    ``author_stats``: (``stats_keys``, login, and P30's columns), one row per author, attached by
    ``stats_keys`` (default owner, repo) and login.  ``surrounding``: (owner, repo, sha, and an array
    ``surrounding_commits``).  Without them those parts are null and an empty list.

    Everything that a payload row gives by itself is made before the joins.  ``files_as``: what to keep of the
    files array, if not all of it; then the files themselves are in no shuffle of the joins."""
    keys = [*(REPO_KEYS if stats_keys is None else stats_keys), "login"]
    files = changed_files(F.col("files"))
    c = commits.select(
        *[k for k in dict.fromkeys([*REPO_KEYS, "sha", *keys]) if k != "login"], F.col("author.login").alias("login"), F.col("author.type").alias("type"),
        F.col("commit.author.date").alias("commit_date"), F.col("commit.message").alias("_message"), "stats",
        (files if files_as is None else files_as(files)).alias("files"), file_pattern_counts(F.col("files.filename")).alias("file_patterns"))
    if author_stats is not None:
        cols = [x for x in author_stats.columns if x not in keys]
        c = c.join(author_stats.select(*keys, F.struct(*cols).alias("_stats")), keys, "left")
    who = [F.col("login"), F.col("type")]
    who += [F.col("_stats").alias("stats")] if author_stats is not None else []
    if surrounding is not None:
        c = c.join(surrounding.select(*REPO_KEYS, "sha", F.slice("surrounding_commits", 1, SURROUNDING).alias("_near")),
                   [*REPO_KEYS, "sha"], "left")
        near = F.col("_near")
    else:
        near = F.lit(None).cast("array<string>")
    return c.select(
        F.concat_ws("/", "owner", "repo").alias("repository"), "sha",
        "commit_date",
        F.struct(*who).alias("author"),
        message_features(F.col("_message")).alias("commit_message"),
        "stats",
        "files",
        "file_patterns",
        F.coalesce(near, F.array()).alias("surrounding_commits"),
    )
