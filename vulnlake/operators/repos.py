"""Repository size against vulnerability analyses.

Per-repository and per-size metrics are one ``groupBy`` each.  The second-pass
statistics (histogram ranges, decile edges, fit lines, kernel bandwidth) read
a one-row aggregate through ``DataFrame.scalar()``: Spark runs it once as a
scalar subquery and inlines the value, with no join and no ``collect``.

Quantiles are exact and distributed (``operators.quantiles``): no task holds more than
a range of the distinct values.  ``approx=True`` takes ``percentile_approx`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.features import safe_corr

from vulnlake.functions.features import log10_col, vuln_density
from vulnlake.operators.quantiles import medians, quantiles, quantiles_of, quantiles_of_counts, stored, value_counts

DECILE_LABELS = [f"Q{i}" for i in range(1, 11)]


def _quantiles(m: DataFrame, c: Column, qs: list[float], approx: bool) -> Column:
    """Quantiles of a column over all of ``m``, as an array-valued scalar subquery."""
    return m.select(F.percentile_approx(c, qs, 100000)).scalar() if approx else quantiles_of(m, c, qs)


def repo_metrics(df: DataFrame, repo: str = "repository", size: str = "size", score: str = "cvss_score",
                 order: str = "cve_id") -> DataFrame:
    """Per repository its size (first by ``order``), CVE count, mean score (apply F05 first)."""
    return df.groupBy(repo).agg(
        F.min_by(F.col(size), F.col(order)).alias("size"),
        F.count(F.col(score)).alias("vuln_count"),
        F.avg(score).alias("avg_cvss"),
    )


def repo_summary(m: DataFrame, repo: str = "repository") -> DataFrame:
    """Repositories, mean count, mean of means, max size, repository with the most
    CVEs (first in name order on ties)."""
    return m.agg(
        F.count(F.lit(1)).alias("n_repositories"),
        F.avg("vuln_count").alias("mean_vuln_count"),
        F.avg("avg_cvss").alias("mean_avg_cvss"),
        F.max("size").alias("max_size"),
        F.min_by(F.col(repo), F.struct(-F.col("vuln_count"), F.col(repo))).alias("top_repository"),
    )


def size_metrics(df: DataFrame, size: str = "size", score: str = "cvss_score") -> DataFrame:
    """Grouped by repository *size* (equal sizes merge, ledger L4): count, mean score."""
    return df.groupBy(F.col(size).alias("repo_size")).agg(
        F.count(F.lit(1)).alias("vulnerabilities"), F.avg(score).alias("avg_cvss"))


def size_metrics_ext(df: DataFrame, size: str = "size", score: str = "cvss_score") -> DataFrame:
    """F06 scores (null -> 0); count, mean, sample std (null for one row), density."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    g = df.groupBy(F.col(size).alias("repo_size")).agg(
        F.count(F.lit(1)).alias("vulnerabilities"), F.avg(s).alias("avg_cvss"), F.stddev_samp(s).alias("std_cvss"))
    return g.withColumn("vuln_density", vuln_density(F.col("vulnerabilities"), F.col("repo_size")))


def size_report(m: DataFrame, approx: bool = False) -> DataFrame:
    """The statistical report over A23's groups."""
    m = m if approx else stored(m.select("repo_size", "vulnerabilities", "avg_cvss"))
    size, count = F.col("repo_size").cast("double"), F.col("vulnerabilities").cast("double")
    of = {"median_size": size, "median_vulnerabilities": count, "median_avg_cvss": F.col("avg_cvss")}
    med = m.agg(*[F.percentile_approx(c, 0.5, 100000).alias(n) for n, c in of.items()]) if approx else medians(m, of)
    one = med.select(F.struct(*of)).scalar()
    st = m.agg(
        F.count(F.lit(1)).alias("size_groups"),
        F.sum("vulnerabilities").alias("total_vulnerabilities"),
        F.avg("repo_size").alias("mean_size"),
        F.avg("vulnerabilities").alias("mean_vulnerabilities"),
        F.avg("avg_cvss").alias("mean_avg_cvss"),
        safe_corr(size, count).alias("corr_size_count"),
        safe_corr(size, F.col("avg_cvss")).alias("corr_size_score"),
    ).withColumn("_m", one)
    return st.select("size_groups", "total_vulnerabilities", F.col("_m.median_size"), "mean_size", "mean_vulnerabilities",
                     F.col("_m.median_vulnerabilities"), "mean_avg_cvss", F.col("_m.median_avg_cvss"), "corr_size_count", "corr_size_score")


CORR_COLUMNS = ["repo_size", "vulnerabilities", "avg_cvss", "vuln_density", "std_cvss"]


def correlation_matrix(m: DataFrame, cols: list[str] = CORR_COLUMNS) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair, long form
    (one aggregate pass, then ``stack``)."""
    aggs, names = [], []
    for a in cols:
        for b in cols:
            names.append((a, b))
            aggs.append(safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}"))
    wide = m.agg(*aggs)
    stack = "stack({n}, {items}) as (col_a, col_b, corr)".format(
        n=len(names), items=", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in names))
    return wide.selectExpr(stack)


def _log_pairs(m: DataFrame) -> DataFrame:
    """F11 on (log10 size, log10 count): only finite pairs."""
    return m.select(log10_col(F.col("repo_size")).alias("lx"), log10_col(F.col("vulnerabilities")).alias("ly")) \
            .filter(F.col("lx").isNotNull() & F.col("ly").isNotNull()
                    & ~F.isnan("lx") & ~F.isnan("ly"))


def loglog_fit(m: DataFrame) -> DataFrame:
    """Degree-1 least-squares fit of log10(count) on log10(size)."""
    p = _log_pairs(m)
    return p.agg(F.regr_count("ly", "lx").alias("n"), F.regr_slope("ly", "lx").alias("slope"),
                 F.regr_intercept("ly", "lx").alias("intercept"))


def loglog_curve(m: DataFrame, n: int = 100) -> DataFrame:
    """``n`` log-spaced sizes from the smallest to the largest positive size and the
    fitted count ``10 ** (slope * log10(size) + intercept)`` at each."""
    p = _log_pairs(m)
    one = p.agg(F.min("lx").alias("lo"), F.max("lx").alias("hi"),
                F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"))
    g = one.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i", "_k")).drop("_k")
    lx = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(n - 1))
    return g.select(F.col("i").cast("bigint").alias("i"), F.pow(F.lit(10.0), lx).alias("size"),
                    F.pow(F.lit(10.0), F.col("slope") * lx + F.col("intercept")).alias("fitted_count"))


def upper_cut(m: DataFrame, col: str = "vulnerabilities", q: float = 0.995, approx: bool = False) -> DataFrame:
    """The 99.5th percentile of counts (linear interpolation)."""
    c = F.col(col).cast("double")
    if approx:
        return m.agg(F.percentile_approx(c, q, 100000).alias("upper_cut"))
    return quantiles(m, c, [q]).select(F.get("q", 0).alias("upper_cut"))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of ``v`` in [lo, hi]; the last bin is closed on the right; outside -> null."""
    b = F.floor(F.try_divide((v - lo) * F.lit(float(bins)), hi - lo)).cast("bigint")
    return F.when((v >= lo) & (v <= hi), F.least(b, F.lit(bins - 1)))


def hist2d(m: DataFrame, bins: int = 50, q: float = 0.995, approx: bool = False) -> DataFrame:
    """50 x 50 linear bins over [0, max log10 size] x [0, p99.5 of count]; outside dropped."""
    lx = log10_col(F.col("repo_size"))
    y = F.col("vulnerabilities").cast("double")
    m = m if approx else stored(m.select("repo_size", "vulnerabilities"))
    x_hi = m.select(F.max(lx)).scalar()
    y_hi = F.get(_quantiles(m, y, [q], approx), F.lit(0))
    binned = m.select(_bin(lx, F.lit(0.0), x_hi, bins).alias("x_bin"), _bin(y, F.lit(0.0), y_hi, bins).alias("y_bin"))
    return (binned.filter(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
            .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))


def hist2d_log(m: DataFrame, edges: int = 50) -> DataFrame:
    """``edges`` log-spaced edges (edges - 1 bins) per axis; x from the smallest positive
    size, y from max(min count, 0.1); binned on log10 values."""
    lx = log10_col(F.col("repo_size"))
    y = F.col("vulnerabilities").cast("double")
    ly = log10_col(y)
    st = m.agg(F.min(lx).alias("x_lo"), F.max(lx).alias("x_hi"),
               F.log10(F.greatest(F.min(y), F.lit(0.1))).alias("y_lo"), F.log10(F.max(y)).alias("y_hi"))
    one = st.select(F.struct("x_lo", "x_hi", "y_lo", "y_hi")).scalar()  # one subquery, reused
    x_lo, x_hi, y_lo, y_hi = one["x_lo"], one["x_hi"], one["y_lo"], one["y_hi"]
    nb = edges - 1
    binned = m.select(_bin(lx, x_lo, x_hi, nb).alias("x_bin"), _bin(ly, y_lo, y_hi, nb).alias("y_bin"))
    return (binned.filter(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
            .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))


def size_decile(m: DataFrame, approx: bool = False) -> DataFrame:
    """10 quantile bins of log10(size): edges by linear interpolation, right-closed,
    lowest included, labels Q1..Q10.  Equal edges keep the lower label.  Rows with
    size <= 0 have no log and no decile."""
    lx = log10_col(F.col("repo_size"))
    qs = [i / 10 for i in range(1, 10)]
    m = m if approx else stored(m)
    edges = _quantiles(m, lx, qs, approx)
    # one reference to the subquery: the nine comparisons are over its array
    above = F.size(F.filter("_edges", lambda e: e < F.col("lx")))
    return (m.withColumn("lx", lx).filter(F.col("lx").isNotNull()).withColumn("_edges", edges)
            .withColumn("decile", F.concat(F.lit("Q"), (above + 1).cast("string"))).drop("lx", "_edges"))


def box_stats(m: DataFrame, col: str = "vulnerabilities", approx: bool = False) -> DataFrame:
    """Per decile quartiles and whiskers at 1.5 IQR (last data point inside)."""
    d, qs = size_decile(m, approx).withColumn("_v", F.col(col).cast("double")), [0.25, 0.5, 0.75]
    if approx:
        q = d.groupBy("decile").agg(F.percentile_approx("_v", qs, 100000).alias("q"))
        d = d.withColumn("_n", F.lit(1))
    else:
        d = value_counts(d, F.col("_v"), ["decile"])  # all that the box needs
        q = quantiles_of_counts(d, qs, ["decile"])
    q = q.select("decile", F.get("q", 0).alias("q1"), F.get("q", 1).alias("median"), F.get("q", 2).alias("q3"))
    # At most ten rows: joined back as a broadcast of a proven size.
    j = d.join(F.broadcast(q), "decile")
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy("decile", "q1", "median", "q3").agg(
        F.sum("_n").alias("n"),
        F.min(F.when(F.col("_v") >= lo, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= hi, F.col("_v"))).alias("whisker_high"))


def kde(m: DataFrame, col: str = "avg_cvss", grid: int = 100, cut: float = 2.0) -> DataFrame:
    """Gaussian kernel density of ``col`` on ``grid`` points from min - cut*bw to
    max + cut*bw, Scott's bandwidth (sample std * n ** -1/5).

    Rows are counted by value first; each distinct value emits its weighted contribution to
    the ``grid`` points (a fixed fan-out, no join), and the partial aggregation folds them to
    ``grid`` rows per task.
    """
    v = F.col(col).cast("double")
    st = m.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    one = st.select(F.struct(F.col("n"), (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"),
                             "lo", "hi")).scalar()  # one subquery, reused
    n, bw, lo, hi = one["n"], one["bw"], one["lo"], one["hi"]
    pts = m.select(v.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("w")) \
           .select("v", "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    pts = pts.withColumn("bw", bw).withColumn("g0", lo - F.lit(cut) * F.col("bw")) \
             .withColumn("step", (hi - lo + F.lit(2 * cut) * F.col("bw")) / F.lit(float(grid - 1)))
    x = F.col("g0") + F.col("i") * F.col("step")
    z = (x - F.col("v")) / F.col("bw")
    dens = F.exp(-0.5 * z * z) / (F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5))
    return (pts.select(F.col("i").cast("bigint").alias("i"), x.alias("x"), (F.col("w") * dens).alias("d"))
            .groupBy("i").agg(F.first("x").alias("x"), (F.sum("d") / n).alias("density")))
