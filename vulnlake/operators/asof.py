"""As-of joins.

The DataFrame API has no as-of join, and a range join followed by
``max_by`` is quadratic in a repository's commits.  Both operators here are
the linear form: the two sides are unioned with a side flag and a running
``last(..., ignorenulls)`` over the time order hands each probe row the last
build row at or before it.

A key holding a third of all rows would be one window partition, so the
window runs per ``(key, time bucket)``; the last build row of all *earlier*
buckets is computed on the bucket-level aggregate (one row per key and
bucket) and fills probe rows whose own bucket has none yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bucket(ts: Column, unit: str | Callable[[Column], Column]) -> Column:
    """The bucket of a time (a ``date_trunc`` unit), or of any order through a monotone function."""
    return unit(ts) if callable(unit) else F.date_trunc(unit, ts)


def asof_last(probe: DataFrame, build: DataFrame, keys: list[str], probe_ts: str, build_ts: str,
              value: str, inclusive: bool = True, bucket: str | Callable[[Column], Column] = "month", out: str = "match") -> DataFrame:
    """For each probe row, ``value`` of the last build row with the same ``keys`` and
    ``build_ts <= probe_ts`` (``<`` when not ``inclusive``); ties on time go to the
    largest ``value``."""
    vtype = build.schema[value].dataType
    p = probe.select(*[F.col(k) for k in keys], F.col(probe_ts).alias("_t"), F.lit(True).alias("_probe"),
                     F.lit(None).cast(vtype).alias("_v"), F.struct(*[F.col(c) for c in probe.columns]).alias("_row"))
    b = build.select(*[F.col(k) for k in keys], F.col(build_ts).alias("_t"), F.lit(False).alias("_probe"),
                     F.col(value).alias("_v"), F.lit(None).cast(T.StructType(probe.schema.fields)).alias("_row"))
    return asof_tagged(p.unionByName(b), keys, inclusive, bucket, out)


def asof_tagged(u: DataFrame, keys: list[str], inclusive: bool = True, bucket: str | Callable[[Column], Column] = "month",
                out: str = "match") -> DataFrame:
    """The as-of core over one tagged frame: ``keys``, ``_t`` (time), ``_probe`` (bool),
    ``_v`` (build value, null on probe rows) and ``_row`` (probe payload struct).  One
    input means a caller whose probe and build rows come from the same source computes
    that source once."""
    # build rows sort before probe rows at equal time when inclusive, after them otherwise
    side = F.when(F.col("_probe"), F.lit(1 if inclusive else 0)).otherwise(F.lit(0 if inclusive else 1))
    u = u.withColumn("_side", side).withColumn("_b", _bucket(F.col("_t"), bucket))
    # 1. inside each (key, bucket): running last build value
    w = (Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_v")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = u.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).filter(F.col("_probe"))
    # 2. last build value of every earlier bucket, on the bucket-level table
    per_b = (u.filter(~F.col("_probe")).groupBy(*keys, "_b")
             .agg(F.max_by("_v", F.struct("_t", "_v")).alias("_bl"), F.lit(1).alias("_s")))
    pbk = (u.filter(F.col("_probe")).select(*keys, "_b").distinct()
           .withColumn("_bl", F.lit(None).cast(u.schema["_v"].dataType)).withColumn("_s", F.lit(0)))
    wb = Window.partitionBy(*keys).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = (pbk.unionByName(per_b).withColumn("_prev", F.last("_bl", ignorenulls=True).over(wb))
             .filter(F.col("_s") == 0).select(*keys, "_b", "_prev"))
    j = hits.join(carry, [*keys, "_b"], "left")
    return j.select("_row.*", F.coalesce("_in", "_prev").alias(out))


def commit_before(cves: DataFrame, commits: DataFrame, repo: str = "repository", published: str = "published",
                  commit_ts: str = "commit_ts", sha: str = "sha", branch: str | None = "branch",
                  bucket: str = "month") -> DataFrame:
    """Per CVE, the last commit of the repository's default branch not after the
    CVE's published time (inclusive).  Default branch: ``main`` when the repository has
    commits on it, else ``master``."""
    c = commits
    if branch and branch in commits.columns:
        has_main = commits.filter(F.col(branch) == "main").select(repo).distinct().withColumn("_main", F.lit(True))
        c = (commits.join(has_main, repo, "left")
             .filter(F.when(F.col("_main"), F.col(branch) == "main").otherwise(F.col(branch) == "master"))
             .drop("_main"))
    return asof_last(cves, c, [repo], published, commit_ts, sha, inclusive=True, bucket=bucket, out="commit_before")


def introducing_commits_from_lines(lines: DataFrame, payload: list[str], repo: str = "repo", path: str = "file",
                                   ts: str = "ts", text: str = "text", sha: str = "sha", sign: str = "sign",
                                   min_word_chars: int = 0, bucket: str = "month",
                                   materialize: bool = True, prefilter: bool = False, method: str = "content") -> DataFrame:
    """J09 over one table of signed diff lines (``-`` removed, ``+`` added): the same
    result as ``introducing_commits`` with the line table computed once.

    The line table feeds four branches (in-bucket matches, the bucket table, the probe
    buckets and the unmatched short lines), each of which Spark would otherwise rebuild
    from the patch text.  ``materialize`` writes it once with a reliable ``checkpoint()``
    into the shared checkpoint folder (it also cuts the lineage).  ``prefilter`` settles
    lines whose text never occurs on the other side with key semi / anti joins before the
    as-of; it pays off when matches are rare and the line table is large (at sf0.1 it
    costs more than it saves, so it is off by default).

    ``method="position"``: by line numbers instead of text (``operators.lines``; the table
    then needs pos, old_no and new_no)."""
    if method == "position":
        from vulnlake.operators.lines import introducing_commits_by_line
        return introducing_commits_by_line(lines, payload, repo, path, ts, sha, sign=sign)
    ok = F.length(F.regexp_replace(F.col(text), r"\W", "")) >= min_word_chars
    d = lines.filter(F.col(sign).isin("-", "+")).withColumn("_ok", ok)
    if materialize:
        from vulnlake.session import checkpoint_dir
        checkpoint_dir(d.sparkSession)
        d = d.select(*payload, *[c for c in (repo, path, sha, sign) if c not in payload], "_ok",
                     *([ts] if ts not in payload else []), *([text] if text not in payload else [])).checkpoint()
    probe = F.col(sign) == "-"
    if prefilter:
        # lines whose (repo, path, text) never occurs on the other side cannot match: settle
        # them with semi / anti joins on the key, so the as-of only sees matchable lines
        k = [repo, path, text]
        rem_k = d.filter(probe & F.col("_ok")).select(*k).distinct()
        add_k = d.filter(~probe & F.col("_ok")).select(*k).distinct()
        both = rem_k.join(add_k, k, "left_semi")
        d_ok = d.filter(F.col("_ok")).join(both, k, "left_semi")
        unmatched = (d.filter(probe & F.col("_ok")).join(both, k, "left_anti").select(*payload)
                     .withColumn("introducing_commit", F.lit("blame_error")))
    else:
        d_ok = d.filter(F.col("_ok"))
        unmatched = None
    tagged = d_ok.select(
        F.col(repo), F.col(path), F.col(text), F.col(ts).alias("_t"), probe.alias("_probe"),
        F.when(~probe, F.col(sha)).alias("_v"),
        F.when(probe, F.struct(*[F.col(c) for c in payload])).alias("_row"))
    m = asof_tagged(tagged, [repo, path, text], inclusive=False, bucket=bucket, out="_m")
    hit = m.withColumn("introducing_commit", F.coalesce("_m", F.lit("blame_error"))).drop("_m")
    miss = d.filter(probe & ~F.col("_ok")).select(*payload).withColumn("introducing_commit", F.lit("blame_error"))
    out = hit.unionByName(miss)
    return out if unmatched is None else out.unionByName(unmatched)


def introducing_commits(removed: DataFrame, added: DataFrame, repo: str = "repo", path: str = "file",
                        ts: str = "ts", text: str = "text", sha: str = "sha", min_word_chars: int = 0,
                        bucket: str = "month") -> DataFrame:
    """J09 (re-aimed from per-line blame): for each removed line of a fix, the latest
    *earlier* commit in the same repository and file that added the same text.

    This is the SZZ idea (Sliwerski, Zimmermann, Zeller 2005) matched by content, not
    ``git blame``: moved or repeated lines can attribute differently.  Every line is matched; one
    with no earlier match gets ``blame_error``, as do lines with fewer than ``min_word_chars``
    word characters where the caller sets that.  The match is an as-of
    on (repo, path, text): linear, no pair explosion on often-repeated lines."""
    words = F.length(F.regexp_replace(F.col(text), r"\W", ""))
    r = removed.withColumn("_ok", words >= min_word_chars)
    a = added.filter(F.length(F.regexp_replace(F.col(text), r"\W", "")) >= min_word_chars)
    m = asof_last(r.filter("_ok").drop("_ok"), a, [repo, path, text], ts, ts, sha, inclusive=False,
                  bucket=bucket, out="_m")
    hit = m.withColumn("introducing_commit", F.coalesce("_m", F.lit("blame_error"))).drop("_m")
    miss = r.filter(~F.col("_ok")).drop("_ok").withColumn("introducing_commit", F.lit("blame_error"))
    return hit.unionByName(miss)


def attribution_share(attributed: DataFrame, col: str = "introducing_commit") -> DataFrame:
    """J09's quality report: lines attributed, lines left as
    ``blame_error`` and the unmatched share in percent."""
    miss = F.col(col) == "blame_error"
    return attributed.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~miss).alias("n_matched"),
                          F.try_divide(F.count_if(miss) * 100.0, F.count(F.lit(1))).alias("pct_unmatched"))
