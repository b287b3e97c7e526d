"""Analyses the reference only plans in its notes.
Semantics are ours; each is one or two aggregates over the CVE, commit and
reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.features import safe_corr

from vulnlake.functions.cve import severity
from vulnlake.functions.text import extension
from vulnlake.functions.features import parent_dir
from vulnlake.functions.urls import url_host
from vulnlake.operators.quantiles import quantiles
from vulnlake.operators.windows import most_common, spread, top_k_per_group

CVE_FIELDS = ["repository", "cvss_score", "cwe_id", "attack_vector", "attack_complexity", "fix_date"]


def missing_pct(df: DataFrame, fields: list[str] = CVE_FIELDS, key: str = "cve_id") -> DataFrame:
    """Percent of the listed fields that are null, per CVE."""
    n_null = sum(F.col(f).isNull().cast("int") for f in fields)
    return df.select(key, (n_null * 100.0 / len(fields)).alias("pct_missing"))


def missing_report(df: DataFrame, fields: list[str] = CVE_FIELDS) -> DataFrame:
    """Per field, rows with it missing and their percent (one pass, then ``stack``)."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(f).isNull()).alias(f) for f in fields]
    wide = df.agg(*aggs)
    st = "stack({}, {}) as (field, n_missing)".format(len(fields), ", ".join(f"'{f}', `{f}`" for f in fields))
    return wide.selectExpr("_n", st).select("field", "n_missing", (F.col("n_missing") * 100.0 / F.col("_n")).alias("pct"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Count per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def vector_cube(df: DataFrame, a: str = "attack_vector", b: str = "attack_complexity") -> DataFrame:
    """Counts by attack vector, by complexity, by both and overall (``cube``)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def score_by(df: DataFrame, by: str, score: str = "cvss_score") -> DataFrame:
    """Mean, sample std and median score per group."""
    return df.groupBy(by).agg(F.count(score).alias("n"), F.avg(score).alias("mean_score"),
                              F.stddev_samp(score).alias("std_score"), F.median(score).alias("median_score"))


def time_to_fix(df: DataFrame, published: str = "published_date", fixed: str = "fix_date") -> DataFrame:
    """Days from publication to fix: count, mean, median (negative when the fix came first)."""
    d = F.datediff(F.col(fixed), F.col(published))
    return df.filter(F.col(fixed).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_days"),
                                                   F.median(d).alias("median_days"))


def hot_periods(df: DataFrame, key: str, ts: str, gap: str = "6 hours", min_count: int = 3,
                method: str = "ranked", bucket: str = "day") -> DataFrame:
    """Bursts: sessions of rows less than ``gap`` apart, per key, with at least
    ``min_count`` rows; a session ends ``gap`` after its last row (``session_window``).

    ``method='window'`` is ``session_window`` itself, which sorts each key in one task.
    ``'ranked'`` (default) stays spread out on a hot key: each row's predecessor comes
    from the bucketed rank join, a row starts a session when the gap to it is at least
    ``gap``, and each row's session start is found with the bucketed as-of join."""
    if method == "window":
        s = df.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return s.filter(F.col("n") >= min_count).select(key, F.col("w.start").alias("start"),
                                                        F.col("w.end").alias("end"), "n")
    from vulnlake.operators.asof import asof_last
    from vulnlake.operators.windows import rank_in_group
    step = F.expr(f"INTERVAL {gap}")
    d = df.select(F.col(key), F.col(ts).cast("timestamp").alias("_ts"))
    r = rank_in_group(d, key, "_ts", "_ts", bucket)
    prev = r.select(key, (F.col("rank") + 1).alias("rank"), F.col("_ts").alias("_prev"))
    r = r.join(prev, [key, "rank"], "left")
    starts = r.filter(F.col("_prev").isNull() | (F.col("_ts") >= F.col("_prev") + step)).select(key, "_ts")
    m = asof_last(r.select(key, "_ts"), starts.withColumn("_start", F.col("_ts")), [key], "_ts", "_ts", "_start",
                  inclusive=True, bucket=bucket, out="start")
    g = m.groupBy(key, "start").agg(F.max("_ts").alias("_last"), F.count(F.lit(1)).alias("n"))
    tt = df.schema[ts].dataType
    return g.filter(F.col("n") >= min_count).select(key, F.col("start").cast(tt).alias("start"),
                                                    (F.col("_last") + step).cast(tt).alias("end"), "n")


def by_language(cves: DataFrame, repos: DataFrame, repo: str = "repository", languages: str = "languages") -> DataFrame:
    """CVEs per language of their repository (``explode`` of the language map)."""
    j = cves.select(repo).join(repos.select(repo, languages), repo)
    return j.select(F.explode(languages).alias("language", "bytes")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def file_types(files: DataFrame, filename: str = "filename") -> DataFrame:
    """Changed files per extension."""
    return files.groupBy(extension(F.col(filename)).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def top_directories(files: DataFrame, k: int = 10, filename: str = "filename") -> DataFrame:
    """The ``k`` most often changed directories (ties by name)."""
    return most_common(files, parent_dir(F.col(filename)), k).withColumnRenamed("item", "directory")


def files_fix_vs_other(commits: DataFrame, is_fix: str = "is_fix", n_files: str = "n_files") -> DataFrame:
    """Mean files changed in fix commits against other commits."""
    return commits.groupBy(is_fix).agg(F.count(F.lit(1)).alias("n"), F.avg(n_files).alias("mean_files"))


def patch_size(commits: DataFrame, col: str = "additions", approx: bool = False) -> DataFrame:
    """Quartiles and 90th percentile of lines added per commit."""
    qs = [0.25, 0.5, 0.75, 0.9]
    found = commits.agg(F.percentile_approx(F.col(col), qs, 100000).alias("q")) if approx else quantiles(commits, F.col(col), qs)
    return found.select(*[F.get("q", i).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)])


def common_words(texts: DataFrame, text: str = "text", k: int = 20, min_len: int = 1) -> DataFrame:
    """The ``k`` most common words (letters / digits, lower-cased, ``min_len``+ chars)."""
    w = F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("word")
    words = spread(texts.select(text)).select(w).filter(F.length("word") >= min_len)
    return most_common(words, F.col("word"), k).withColumnRenamed("item", "word")


def commits_per_fix(refs: DataFrame, key: str, is_commit: Column) -> DataFrame:
    """Histogram of the number of commit references per CVE."""
    per = refs.groupBy(key).agg(F.count_if(is_commit).alias("n_commits"))
    return per.groupBy("n_commits").agg(F.count(F.lit(1)).alias("n_cves"))


def score_histogram(df: DataFrame, score: str = "cvss_score") -> DataFrame:
    """Scores per unit-wide bucket."""
    return (df.filter(F.col(score).isNotNull()).groupBy(F.floor(F.col(score)).cast("bigint").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def score_stats(df: DataFrame, score: str = "cvss_score") -> DataFrame:
    """Deciles and population skewness of scores."""
    s = F.col(score)
    q = quantiles(df, s, [0.1, 0.5, 0.9]).select("q").scalar()
    return (df.agg(F.skewness(s).alias("skewness")).withColumn("_q", q)
            .select(*[F.get("_q", i).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "skewness"))


def score_correlations(df: DataFrame, score: str, cols: list[str]) -> DataFrame:
    """Pearson correlation of the score with each column."""
    return df.agg(*[safe_corr(F.col(score), F.col(c).cast("double")).alias(f"corr_{c}") for c in cols])


def tag_distribution(refs: DataFrame, tags: str = "tags") -> DataFrame:
    """References per tag."""
    return refs.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def exploit_share(refs: DataFrame, key: str, tags: str = "tags", tag: str = "Exploit") -> DataFrame:
    """Percent of CVEs with at least one reference tagged ``tag``."""
    per = refs.groupBy(key).agg(F.max(F.array_contains(F.col(tags), tag).cast("int")).alias("_has"))
    return per.agg(F.count(F.lit(1)).alias("n_cves"), (F.avg("_has") * 100).alias("pct_exploit"))


def top_hosts(refs: DataFrame, url: str = "url", k: int = 10) -> DataFrame:
    """The ``k`` most common reference hosts."""
    return most_common(refs, url_host(F.col(url)), k).withColumnRenamed("item", "host")


def balanced_sample(df: DataFrame, per_stratum: int, strata: Column, key: str = "cve_id") -> DataFrame:
    """Up to ``per_stratum`` rows per stratum, chosen by a hash of the key (stable
    across runs).  Two-phase top-k so a dominant stratum is not sorted in one task."""
    d = df.withColumn("stratum", strata).withColumn("_h", F.md5(F.col(key)))
    return top_k_per_group(d, "stratum", [F.col("_h")], per_stratum).drop("_h", "rank")


def severity_strata(score: str = "cvss_score") -> Column:
    return severity(F.col(score), "Unknown")
