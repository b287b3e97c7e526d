"""Joins.

No join here hand-picks a physical strategy: AQE broadcasts a side when its
*runtime* size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and
otherwise sort-merges on the key, splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.operators import chunks


def join_repo(cves: DataFrame, repos: DataFrame, how: str = "left", key: str = "repository") -> DataFrame:
    """CVE with its repository features by ``owner/repo``.

    ``how='inner'`` is the collector's main path (a CVE without repository data is
    not updated); ``'left'`` is the enhancer (row kept)."""
    return cves.join(repos, key, how)


def join_commit(cves: DataFrame, commits: DataFrame, repo: str = "repository", sha: str = "fix_commit",
                commit_sha: str = "sha", commit_date: str = "commit_date") -> DataFrame:
    """CVE with its fix commit by (repository, sha); sets details and ``fix_date``."""
    c = commits.withColumnRenamed(commit_sha, "_sha")
    details_cols = [x for x in c.columns if x not in (repo, "_sha")]
    c = c.select(F.col(repo).alias("_repo"), "_sha", F.struct(*details_cols).alias("fix_commit_details"))
    j = cves.join(c, (cves[repo] == c["_repo"]) & (cves[sha] == c["_sha"]), "left").drop("_repo", "_sha")
    return j.withColumn("fix_date", F.coalesce(F.col(f"fix_commit_details.{commit_date}"), F.col("fix_date"))
                        if "fix_date" in cves.columns else F.col(f"fix_commit_details.{commit_date}"))


def new_only(batch: DataFrame, existing: DataFrame, key: str = "cve_id") -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet."""
    return batch.join(existing.select(key), key, "left_anti")


def store_keys(keys: DataFrame, name: str, path: str, key: str = "cve_id", buckets: int = 64) -> None:
    """Append the distinct keys to the table ``name``, bucketed and sorted by ``key``, in the shared
    folder ``path``: the stored side of ``new_only_stored``."""
    (keys.select(key).distinct().write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", path)
     .format("parquet").saveAsTable(name))


def new_only_stored(new: DataFrame, name: str, key: str = "cve_id") -> DataFrame:
    """J03 / E02 against the large stored set of ``store_keys``: the stored side is read in its
    buckets and not exchanged; only the new rows are dealt to them."""
    return new.join(new.sparkSession.table(name).select(key), key, "left_anti")


def patch_worklist(cves: DataFrame, clone_state: DataFrame, repo: str = "repository",
                   patch_url: str = "patch_url") -> DataFrame:
    """CVEs whose repository's clone state is exactly ``success`` and whose patch URL is truthy."""
    ok = clone_state.filter(F.col("status") == "success").select(F.col("key").alias(repo))
    return cves.filter(F.col(patch_url).isNotNull() & (F.col(patch_url) != "")).join(ok, repo, "left_semi")


def pending(work: DataFrame, state: DataFrame, key: str = "cve_id",
            done: tuple[str, ...] = ("success", "failed")) -> DataFrame:
    """Drop work whose state is exactly one of ``done``.  ``failed: ...`` and
    ``started`` are *not* equal to those, so they are retried (ledger L11)."""
    d = state.filter(F.col("status").isin(*done)).select(F.col("key").alias(key))
    return work.join(d, key, "left_anti")


def clone_worklist(cves: DataFrame, dirs: DataFrame, state: DataFrame, repo: str = "repository",
                   dir_col: str = "dir_name") -> DataFrame:
    """Distinct repositories with no directory yet and no state entry at all."""
    from vulnlake.functions.urls import repo_dir
    r = cves.select(repo).filter(F.col(repo).isNotNull() & (F.col(repo) != "")).distinct()
    r = r.join(dirs.select(F.col(dir_col).alias("_dir")), repo_dir(F.col(repo)) == F.col("_dir"), "left_anti")
    return r.join(state.select(F.col("key").alias(repo)), repo, "left_anti")


def unscraped(refs: DataFrame, index: DataFrame, keys: tuple[str, str] = ("cve_id", "url")) -> DataFrame:
    """(cve, url) pairs not in the scrape index (no de-duplication within the run)."""
    return refs.join(index.select(*keys), list(keys), "left_anti")


def join_author(commits: DataFrame, contributors: DataFrame, login: str = "login", pos: str = "pos") -> DataFrame:
    """The commit author's contributor row: the *first* (by ``pos``) on equal logins.

    The contributor side is reduced to one row per login with ``min_by`` (a
    partial aggregate, safe on a hot login) before the equi-join."""
    cols = [c for c in contributors.columns if c not in (login, pos)]
    first = contributors.groupBy(login).agg(F.min_by(F.struct(*cols), F.col(pos)).alias("author_row"))
    return commits.join(first, login, "left")


def join_scraped(refs: DataFrame, scraped: DataFrame, keys: tuple[str, str] = ("cve_id", "url")) -> DataFrame:
    """Each reference with any scraped text of its (cve, url)."""
    return refs.join(scraped, list(keys), "left")


def upsert_state(old: DataFrame, new: DataFrame, overwrite: bool = True) -> DataFrame:
    """State upsert by key.  ``overwrite``: the new status replaces the old; otherwise
    the new status only fills keys that are absent (the clone-directory scan).  One exchange:
    both sides as tagged rows, combined by key; a key holds one row a side."""
    both = old.select("key", "status", F.lit(0).alias("_side")).unionByName(new.select("key", "status", F.lit(1).alias("_side")))
    was, now = (F.max(F.when(F.col("_side") == i, F.col("status"))) for i in (0, 1))
    return both.groupBy("key").agg((F.coalesce(now, was) if overwrite else F.coalesce(was, now)).alias("status"))


def join_patch_cve(patches: DataFrame, cves: DataFrame, cve_col: str = "cve_id") -> DataFrame:
    """Patch with its CVE by the id parsed from the file name (missing CVE kept, null)."""
    return patches.join(cves, cve_col, "left")


def enhance(cves: DataFrame, repos: DataFrame, commits: DataFrame, repo: str = "repository",
            sha: str = "fix_commit") -> DataFrame:
    """Fill only the absent repository context and commit details; when details are
    newly found, ``fix_date`` becomes their ``commit_date``; the status becomes
    ``enhanced`` even when nothing was found."""
    r = repos.select(F.col(repo).alias("_r"), F.struct(*[c for c in repos.columns if c != repo]).alias("_ctx"))
    c = commits.select(F.col(repo).alias("_cr"), F.col("sha").alias("_cs"),
                       F.struct(*[x for x in commits.columns if x not in (repo, "sha")]).alias("_det"))
    j = (cves.join(r, cves[repo] == r["_r"], "left")
         .join(c, (cves[repo] == c["_cr"]) & (cves[sha] == c["_cs"]), "left"))
    newly = F.col("fix_commit_details").isNull() & F.col("_det").isNotNull()
    if "commit_date" in commits.columns and "fix_date" in cves.columns:
        j = j.withColumn("fix_date", F.when(newly, F.col("_det.commit_date")).otherwise(F.col("fix_date")))
    return (j.withColumn("repository_context", F.coalesce(F.col("repository_context"), F.col("_ctx")))
             .withColumn("fix_commit_details", F.coalesce(F.col("fix_commit_details"), F.col("_det")))
             .withColumn("processing_status", F.lit("enhanced"))
             .drop("_r", "_ctx", "_cr", "_cs", "_det"))


def github_summary_long(refs: DataFrame, key: str = "cve_id", pos: str = "pos", url: str = "url") -> DataFrame:
    """P20 in long form (one row per reference): repository = last GitHub match,
    fix_commit = first non-empty commit, related_commits = every commit in reference
    order (comma-joined), patch_url = last GitHub ``.patch`` URL.  ``max_by`` / ``min_by``
    skip rows whose ordering is null, which is how non-matching rows are left out.

    related_commits is folded from the chunks of ``related_commit_chunks``."""
    from vulnlake.functions import urls as fu
    u = F.coalesce(F.col(url), F.lit(""))
    gh = fu.is_github(u)
    repo = F.when(gh, fu.github_repo(u))
    commit = F.when(gh, fu.github_commit(u))
    patch = F.when(gh & u.endswith(".patch"), u)
    p = F.col(pos)
    one = refs.groupBy(key).agg(
        F.max_by(repo, F.when(repo.isNotNull(), p)).alias("repository"),
        F.min_by(commit, F.when(commit.isNotNull() & (commit != ""), p)).alias("fix_commit"),
        F.max_by(patch, F.when(patch.isNotNull(), p)).alias("patch_url"),
    )
    related = chunks.folded(related_commit_chunks(refs, key, pos, url), key).select(F.col(key).alias("_k"), F.expr("substr(text, 2)").alias("related_commits"))
    return one.join(related, one[key].eqNullSafe(related["_k"]), "left").select(
        key, "repository", "fix_commit", F.coalesce("related_commits", F.lit("")).alias("related_commits"), "patch_url")


def related_commit_chunks(refs: DataFrame, key: str = "cve_id", pos: str = "pos", url: str = "url", most: int = chunks.MOST) -> DataFrame:
    """P20's commits as (key, chunk, text): every commit in reference order, each after a comma, in
    chunks of about ``most`` bytes; a CVE's references never meet in one task."""
    from vulnlake.functions import urls as fu
    u = F.coalesce(F.col(url), F.lit(""))
    commit = F.when(fu.is_github(u), fu.github_commit(u))
    return chunks.text_chunks(refs.select(key, F.col(pos), F.concat(F.lit(","), commit).alias("text")), key, pos, "text", most)
