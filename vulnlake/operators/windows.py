"""Order-dependent steps.

First / last per key use ``min_by`` / ``max_by`` aggregates rather than a
``row_number`` window: they aggregate map-side, so a key holding a third of
all rows is folded in every task before the shuffle instead of being sorted
in one.  Top-k per group is two-phase for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.session import checkpoint_dir


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """the first row of each key in ``order`` (ascending, total tie-break expected)."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    o = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), o).alias("_r")).select(*keys, "_r.*")


def last_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """the last row of each key in ``order`` (a later write replaces an earlier one)."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    o = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), o).alias("_r")).select(*keys, "_r.*")


def top_k_per_group(df: DataFrame, key: str, order: list, k: int, salt_buckets: int = 32) -> DataFrame:
    """Top ``k`` rows per ``key`` by ``order`` (Columns, descending first).

    Phase 1 keeps the top ``k`` inside (key, salt) sub-groups, so a hot key is
    spread over ``salt_buckets`` tasks; phase 2 ranks at most
    ``k * salt_buckets`` survivors per key."""
    salt = F.abs(F.xxhash64(*[F.col(c) for c in df.columns])) % salt_buckets
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= k)
    w2 = Window.partitionBy(key).orderBy(*order)
    return d.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).drop("_salt", "_rn")


#: Largest number of occurrences of an untracked item, as a share of all rows times the tracked
#: items: twice the a-priori error of the frequent-items sketch (3.5 over its map's size).
SKETCH_ERROR = 7


def most_common(df: DataFrame, item: Column, k: int, tracked: int = 4096) -> DataFrame:
    """(item, n): the ``k`` most common items of ``df``, ties in item order, exactly.

    Each task keeps a summary of at most about ``tracked`` items (``approx_top_k``); the merged one
    names the candidates, which alone are counted exactly in a second pass, so that no more
    than tasks x ``tracked`` rows are shuffled.  An item that the summary does not name
    occurs at most ``SKETCH_ERROR`` / ``tracked`` of all rows; only if the k-th candidate is not
    above that (many items about as common, or fewer than k of them) are all items counted.
    Null is an item."""
    checkpoint_dir(df.sparkSession)
    rows = df.select(item.cast("string").alias("item"))
    coded = rows.withColumn("_x", F.coalesce(F.concat(F.lit("="), "item"), F.lit("")))  # the summary leaves nulls out
    summary = coded.agg(F.expr(f"approx_top_k(_x, {tracked}, {tracked})").alias("t"), F.count(F.lit(1)).alias("w")).checkpoint()  # a row
    named = summary.select(F.explode("t.item").alias("_x"))
    top = (coded.join(F.broadcast(named), "_x").groupBy("item").agg(F.count(F.lit(1)).alias("n"))  # at most ``tracked`` rows
           .orderBy(F.desc("n"), "item").limit(k).checkpoint())
    bound = summary.select(F.col("w") * SKETCH_ERROR / tracked).scalar()
    decided = top.agg((F.count(F.lit(1)) == k) & (F.min("n") > bound)).scalar()
    every = rows.where(~F.coalesce(decided, F.lit(False))).groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(k)
    return top.where(decided).unionByName(every)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt over all cores if its files make fewer tasks than these."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def rank_in_group(df: DataFrame, key: str, ts, tie, bucket="day") -> DataFrame:
    """Dense 1-based position of each row inside its ``key`` by (``ts``, ``tie``), without
    one window partition per key: rows are numbered inside (key, bucket) and shifted by
    the row count of all earlier buckets, taken from the bucket-level table (one row
    per key and bucket).  ``bucket`` is a ``date_trunc`` unit for a time order, or any
    Column that is monotone with the order (a name prefix for a name order)."""
    b = F.date_trunc(bucket, F.col(ts)) if isinstance(bucket, str) else bucket
    d = df.withColumn("_b", b)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(ts, tie)))
    counts = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0))).select(key, "_b", "_off")
    return d.join(offs, [key, "_b"]).withColumn("rank", F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")


def _near_in_window(commits: DataFrame, n: int, repo: str, ts: str, sha: str, bucket: str) -> DataFrame:
    """Neighbours by one window a repository, with the rows of ``_near_by_rank``: at the edges of a
    bucket repeated commits are one row, and those without a repository or time are left out."""
    c = commits.withColumn("_b", F.date_trunc(bucket, F.col(ts)))
    whole = Window.partitionBy(repo).orderBy("_b", ts, sha)
    c = c.withColumn("_k", F.row_number().over(whole))
    c = c.withColumn("_l", F.collect_list(F.struct("_k", F.col(sha).alias("_ns"), F.col("_b").isNull().alias("_z"))).over(whole.rowsBetween(-n, n)))
    c = (c.withColumn("_r", F.row_number().over(Window.partitionBy(repo, "_b").orderBy(ts, sha)))
          .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(repo, "_b"))))
    known = F.col(repo).isNotNull() & F.col("_b").isNotNull()
    c = c.withColumn("_edge", (F.col("_r") <= n) | (F.col("_r") > F.col("_n") - n)).where(~F.col("_edge") | known)
    near = F.transform(F.filter("_l", lambda x: x["_z"] == F.col("_b").isNull()),
                       lambda x: F.struct((x["_k"] - F.col("_k")).alias("_d"), x["_ns"].alias("_ns")))
    g = (c.select(repo, sha, ts, "_edge", F.when(~F.col("_edge"), F.col("_k")).alias("_own"), near.alias("_l"))
          .groupBy(repo, sha, ts, "_edge", "_own").agg(F.array_sort(F.flatten(F.collect_list("_l"))).alias("_l")))
    names = F.transform("_l", lambda x: x["_ns"])
    return g.select(repo, sha, ts, F.when(F.col("_edge"), names).otherwise(F.filter(names, lambda x: x.isNotNull())).alias("surrounding"))


def _near_by_rank(commits: DataFrame, n: int, repo: str, ts: str, sha: str, bucket: str) -> DataFrame:
    # ranked: numbered inside (repository, bucket); interior rows take their
    # neighbours from a bounded frame of that bucket, and only the n rows at each
    # bucket edge ask for ranks r-n..r+n through an equi-join on (repository, rank)
    # over edge rows alone, so a hot repository spreads over many tasks
    c = commits.withColumn("_b", F.date_trunc(bucket, F.col(ts)))
    wo = Window.partitionBy(repo, "_b").orderBy(ts, sha)
    c = (c.withColumn("_r", F.row_number().over(wo))
          .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(repo, "_b")))
          .withColumn("_in", F.collect_list(F.col(sha)).over(wo.rowsBetween(-n, n))))
    counts = c.groupBy(repo, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wb = Window.partitionBy(repo).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wb), F.lit(0))).select(repo, "_b", "_off")
    edge = (F.col("_r") <= n) | (F.col("_r") > F.col("_n") - n)
    near = (F.col("_r") <= 2 * n) | (F.col("_r") > F.col("_n") - 2 * n)
    interior = c.filter(~edge).select(repo, sha, ts, F.col("_in").alias("surrounding"))
    e = c.filter(near).join(offs, [repo, "_b"]).withColumn("rank", F.col("_r") + F.col("_off"))
    probe = (e.filter(edge).select(repo, F.col(sha).alias("_c"), F.col(ts).alias("_t"), "rank",
                                   F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("_d"))
             .withColumn("_nr", F.col("rank") + F.col("_d")))
    nb = e.select(repo, F.col("rank").alias("_nr"), F.col(sha).alias("_ns"))
    g = probe.join(nb, [repo, "_nr"]).groupBy(repo, "_c", "_t").agg(
        F.array_sort(F.collect_list(F.struct("_d", "_ns"))).alias("_l"))
    edges = g.select(repo, F.col("_c").alias(sha), F.col("_t").alias(ts),
                     F.transform("_l", lambda x: x["_ns"]).alias("surrounding"))
    return interior.unionByName(edges)


#: Commits of a repository that are ordered in one task; a larger one is ranked by time bucket.
HOT = 100_000


def surrounding_commits(commits: DataFrame, mode: str = "intended", n: int = 2, repo: str = "repository",
                        ts: str = "commit_ts", sha: str = "sha", method: str = "ranked",
                        bucket: str = "month", hot: int = HOT) -> DataFrame:
    """F15 (ledger L9).

    * ``intended``: per commit, the ``n`` commits before it, itself and the ``n`` after
      it in its repository, by (time, sha).  A bounded frame: ``rowsBetween(-n, n)``.
    * ``reference``: what the code really returns, the 5 newest commits of the branch,
      attached to every commit of that repository.

    ``ranked``: repositories of up to ``hot`` commits take their neighbours from one window each,
    larger ones from ranks within time buckets.
    """
    if mode == "intended" and method == "window":
        # one window partition per repository: fine unless a repository is very hot
        w = Window.partitionBy(repo).orderBy(ts, sha).rowsBetween(-n, n)
        return commits.select(repo, sha, ts, F.collect_list(F.col(sha)).over(w).alias("surrounding"))
    if mode == "intended":
        c = commits.select(repo, sha, ts)
        checkpoint_dir(commits.sparkSession)
        large = c.groupBy(repo).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot).select(F.col(repo).alias("_hot")).checkpoint()
        if large.isEmpty():
            return _near_in_window(c, n, repo, ts, sha, bucket)
        is_hot = F.col(repo).eqNullSafe(F.col("_hot"))
        large = F.broadcast(large)  # at most one repository for each ``hot`` commits
        return _near_in_window(c.join(large, is_hot, "left_anti"), n, repo, ts, sha, bucket).unionByName(
            _near_by_rank(c.join(large, is_hot, "left_semi"), n, repo, ts, sha, bucket))
    if mode == "reference":
        top = top_k_per_group(commits.select(repo, sha, ts), repo, [F.desc(ts), F.desc(sha)], 5)
        newest = top.groupBy(repo).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", sha))), lambda x: x[sha]).alias("surrounding"))
        return commits.select(repo, sha, ts).join(newest, repo, "left")
    raise ValueError(mode)
