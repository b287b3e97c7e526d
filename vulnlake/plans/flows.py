"""The reference's four script chains as Spark jobs composed from
the operators.  Files between scripts become tables; thread pools become tasks.

* ``collect_and_enrich``: S01 -> P17-P21 -> F01 -> J03 (+F13) -> J01 / J02 -> J17 -> W01
* ``patch_to_snippets``: S05 -> P10 -> J14, X05 -> J13 -> J09 -> F09 / F10 -> J15 -> X14 -> W07
* ``analysis``: CVE table -> severity, timing, coverage, repository tables (A01-A33)
* ``malicious_intent``: F12 -> J07 -> J11 (+U01) -> X10 -> X11 or U02 -> X07 -> A39 -> W05
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vulnlake.functions import cve as fc
from vulnlake.functions import urls as fu
from vulnlake.operators import coverage, filters, findings, intent, joins, repos, severity, snippets, state, timing, windows
from vulnlake.sources import readers, sinks


def collect_and_enrich(spark: SparkSession, feed_path: str, existing: DataFrame | None,
                       repo_features: DataFrame, commit_features: DataFrame, now: str | None = None) -> DataFrame:
    """3.1: feed pages -> flat CVE rows with their GitHub summary -> only new CVEs with a
    repository -> repository context and fix-commit details filled in -> ``enhanced``.

    ``repo_features``: (repository, ...); ``commit_features``: (repository, sha, commit_date, ...)."""
    raw = readers.read_cve_feed(spark, feed_path)
    flat = fc.flatten_cve(raw).withColumn("gh", fc.github_summary(F.col("references")))
    flat = flat.select("page", "pos", "cve_id", "cvss_score", "cvss_vector", "cwe_id", "description",
                       "attack_vector", "attack_complexity", "published_date", "last_modified", "references",
                       F.col("gh.repository").alias("repository"), F.col("gh.fix_commit").alias("fix_commit"),
                       F.col("gh.related_commits").alias("related_commits"), F.col("gh.patch_url").alias("patch_url"))
    # the first copy of a CVE in feed order wins (F13), then only CVEs with a repository
    first = windows.first_per_key(flat, "cve_id", ["page", "pos"])
    new = filters.with_repository(first)
    if existing is not None:
        new = joins.new_only(new, existing.select("cve_id"))
    new = fc.with_metadata(new, "raw", now)
    date = commit_features.schema["commit_date"].dataType
    new = (new.withColumn("repository_context", F.lit(None).cast(record_type(repo_features, "repository")))
              .withColumn("fix_commit_details", F.lit(None).cast(record_type(commit_features, "repository", "sha")))
              .withColumn("fix_date", F.lit(None).cast(date)))
    out = joins.enhance(new, repo_features, commit_features)
    patch = fu.default_patch_url(F.col("patch_url"), F.col("repository"), F.col("fix_commit"),
                                 F.col("fix_commit_details").isNotNull())
    return out.withColumn("patch_url", patch)


def record_type(df: DataFrame, *keys: str) -> StructType:
    """The struct type of a feature table's columns without its keys, all nullable."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in keys])


def patch_to_snippets(patches: DataFrame, replies: DataFrame, snapshots: DataFrame, history: DataFrame,
                      cves: DataFrame, commits: DataFrame | None = None, corrections: DataFrame | None = None,
                      model: Callable | None = None, store: str | None = None) -> DataFrame:
    """3.2: patches named ``{cve}_{owner_repo}.patch`` + model replies + file snapshots ->
    labelled snippets.

    ``patches``: (file_name, text); ``replies``: (cve_id, reply); ``snapshots``:
    (repo_name, sha, path, content); ``history``: signed diff lines of earlier commits
    (repo, file, ts, text, sha, sign); ``cves``: (cve_id, ...).

    ``commits`` (repo_name, sha, commit_ts, branch), with ``published`` in ``cves``: a CVE is looked at in the
    state of the last commit before it was published (J08): its paths and lines are those of that
    commit's snapshot, and only earlier commits can have introduced a line.  A CVE without such a
    commit has no snippets.  Without ``commits`` the state is the snapshot with the largest sha.

    Findings whose path the state lacks take a correction (J13): from ``corrections``
    (cve_id, file_path, c_path, c_lines, c_status), or asked of ``model`` (U03, X09), replies
    being kept in ``store``."""
    from vulnlake.operators import asof, patches as pt
    p = patches.withColumn("_pn", fu.parse_patch_name(F.col("file_name"))).select(
        "file_name", "text", F.col("_pn.cve_id").alias("cve_id"), F.col("_pn.repo").alias("repo_name"))
    p = joins.join_patch_cve(p, cves.select("cve_id"))
    paths = pt.patch_paths(p.select("cve_id", "text"), "cve_id")
    parsed = findings.with_findings(replies, "reply")
    f = (parsed.filter(F.col("p.status") == "ok").join(p.select("cve_id", "repo_name"), "cve_id")
         .select("cve_id", "repo_name", F.explode("p.items").alias("it"))
         .select("cve_id", "repo_name", F.col("it.file_path").alias("file_path"), F.col("it.line_numbers").alias("line_numbers")))
    # the state of each CVE's repository, named by repository and commit
    state, never = F.concat_ws("@", "repo_name", "sha"), F.lit("9999-12-31 00:00:00").cast("timestamp")
    if commits is None:
        newest = snapshots.groupBy("repo_name", "path").agg(F.max_by("content", "sha").alias("content"))
        stored = newest.select(F.col("repo_name").alias("state"), "path", "content")
        f = f.withColumn("state", F.col("repo_name")).withColumn("until", never)
    else:
        asked = f.select("cve_id", "repo_name").distinct().join(cves.select("cve_id", F.col("published").cast("timestamp").alias("published")), "cve_id")
        before = asof.commit_before(asked, commits, repo="repo_name", published="published").where(F.col("commit_before").isNotNull())
        before = before.select("cve_id", "repo_name", F.concat_ws("@", "repo_name", "commit_before").alias("state"), F.col("published").alias("until"))
        stored = snapshots.select(state.alias("state"), "path", "content")
        f = f.join(before, ["cve_id", "repo_name"])
    if corrections is None:
        corrections = spark_empty_corrections(f) if model is None else findings.path_corrections(f, stored, model, store, repo="state")
    r = findings.resolve_path(f, corrections, paths, stored.select("state", "path").distinct(), repo="state")
    r = r.filter(F.col("resolved_path").isNotNull()).select(
        "cve_id", "state", F.col("resolved_path").alias("file_path"), F.col("resolved_lines").alias("line_numbers"))
    r = r.join(f.select("cve_id", "state", "repo_name", "until").distinct(), ["cve_id", "state"])
    # attribute every vulnerable line of that state to the last earlier commit that added its text
    lines = r.select("cve_id", "state", "repo_name", "until", "file_path", F.explode("line_numbers").alias("line"))
    content = stored.select(F.col("state").alias("_s"), F.col("path").alias("_p"), "content")
    txt = lines.join(content, (F.col("state") == F.col("_s")) & (F.col("file_path") == F.col("_p"))) \
        .withColumn("text", F.get(F.split("content", "\n"), F.col("line") - 1))
    probe = txt.select("cve_id", F.col("repo_name").alias("repo"), F.col("file_path").alias("file"), "line", "text", F.col("until").alias("ts"))
    att = asof.introducing_commits(probe, history.filter(F.col("sign") == "+").select("repo", "file", "ts", "text", "sha"))
    ic = att.groupBy("cve_id", "file").agg(F.array_sort(F.collect_list(F.struct("line", F.col("introducing_commit").alias("sha"))))
                                          .alias("introducing_commits"))
    s = r.drop("state", "until").join(ic.select(F.col("cve_id").alias("_c"), F.col("file").alias("_f"), "introducing_commits"),
                                      (F.col("cve_id") == F.col("_c")) & (F.col("file_path") == F.col("_f")), "left").drop("_c", "_f")
    s = snippets.first_commit(filters.complete_snippets(s))
    return snippets.snippet_rows(snippets.join_content(s, snapshots))


def spark_empty_corrections(like: DataFrame) -> DataFrame:
    """No correction round was run: an empty corrections table of the right shape."""
    return like.select("cve_id", "file_path", F.lit(None).cast("string").alias("c_path"),
                       F.lit(None).cast("array<int>").alias("c_lines"), F.lit(None).cast("string").alias("c_status")) \
               .filter(F.lit(False))


def analysis(cves: DataFrame, repo_sizes: DataFrame, commits: DataFrame, years=(2017, 2024)) -> dict[str, DataFrame]:
    """3.3: the analysis tables from one CVE table (published_date, cvss_score, repository,
    has_commit), repository sizes (repository, size) and fix commits (commit_ts)."""
    scored = filters.year_between(filters.scored(cves, "truthy"), *years)
    joined = joins.join_repo(cves, repo_sizes, "inner")
    m22 = repos.size_metrics(filters.scored(joined, "not_null", require=["repository", "size"]))
    m23 = repos.size_metrics_ext(joined)
    return {
        "overview": severity.overview(cves),
        "by_year": severity.count_by_year(cves),
        "severity_summary": severity.severity_summary(scored),
        "severity_distribution": severity.severity_distribution(scored),
        "monthly_severity_pct": severity.monthly_severity_pct(scored),
        "timing_coverage": timing.timing_coverage(cves),
        "weekday_hour": timing.weekday_hour(commits),
        "working_share": timing.working_share(commits),
        "coverage_by_month": coverage.coverage_by(cves, "month"),
        "trend_pct_week": coverage.time_regression(coverage.coverage_by(cves, "week"), "pct"),
        "repo_summary": repos.repo_summary(repos.repo_metrics(filters.scored(joined, "not_null", require=["size"]))),
        "size_report": repos.size_report(m23),
        "correlations": repos.correlation_matrix(m23),
        "deciles": repos.box_stats(m22),
    }


def malicious_intent(cves: DataFrame, refs: DataFrame, pages: DataFrame, done: DataFrame | None = None,
                     model: Callable | None = None) -> DataFrame:
    """3.4: references with a URL -> not yet scraped / analysed -> page text -> prompt ->
    the caller's model (U02) or the rule signals (X11) -> parsed result per CVE.

    ``cves``: (cve_id, description); ``refs``: (cve_id, pos, url, tags); ``pages``: (cve_id, url, html)."""
    r = filters.urls_of(refs)
    todo = cves if done is None else joins.new_only(cves, done)
    scraped = pages.select("cve_id", "url", intent.html_text(F.col("html")).alias("scraped_text"))
    if model is None:
        tags = r.groupBy("cve_id").agg(F.flatten(F.collect_list("tags")).alias("tags"))
        sig = intent.intent_signals(todo.join(tags, "cve_id", "left"))
        return sig.select("cve_id", F.struct("malicious_intent_likely", "reason").alias("result"))
    prompts = intent.intent_prompt(todo, r, scraped)
    scored = intent.with_intent(intent.score(prompts, "prompt", model), "reply", "result")
    return scored.select("cve_id", "result")


def write_intent_results(results: DataFrame, path: str) -> None:
    """W05 after A39: the latest result per CVE, appended as JSON lines."""
    latest = state.latest_result(results.withColumn("seq", F.monotonically_increasing_id()).withColumnRenamed(
        "cve_id", "key"), key="key", seq="seq", value="result").withColumnRenamed("key", "cve_id")
    sinks.append_results(latest, path)
