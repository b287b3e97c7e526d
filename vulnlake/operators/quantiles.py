"""Exact quantiles by distributed selection.

``percentile`` and ``median`` bring all distinct values of a group together in one task.  Here a
group's values are counted (map-side combine first), the distinct values are dealt to ranges
between splitters, and the ranges' totals, a few hundred numbers, tell which range holds each wanted
position.  Only those ranges are sorted, each in its own task, and the two values around each
position are interpolated as the built-in does.  The splitters are the distinct values with the
smallest hashes, so a range holds about one part in ``RANGES`` of the distinct values whatever
their distribution, and a value that fills a third of the rows is one counted row.

The counted values are written once, by a reliable checkpoint in the shared folder, so that the
steps above don't compute the source anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.session import checkpoint_dir

RANGES = 256


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared folder and read from there: for a table that several steps use."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def value_counts(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by..., _v, _n): the distinct non-null values of each group and how often each occurs, stored."""
    return stored(df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
                  .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))


def in_ranges(counts: DataFrame, by: list[str], ranges: int = RANGES) -> DataFrame:
    """``counts`` with ``_b``, the range of each value; larger values are never in a lower range."""
    some = counts.orderBy(F.xxhash64(*by, "_v"), "_v").limit(max(1, ranges - 1))
    splitters = some.agg(F.array_sort(F.collect_set("_v"))).scalar()  # one array, shared by all groups
    return counts.withColumn("_s", splitters).withColumn("_b", F.size(F.filter("_s", lambda s: s <= F.col("_v")))).drop("_s")


def quantiles(df: DataFrame, value: Column, qs: list[float], by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by..., q): for each group the array of its values' exact ``qs`` quantiles, interpolated
    linearly between the neighbours of position q * (n - 1).

    Nulls are left out; NaN is larger than any number.  Without ``by`` there is one row, whose
    quantiles are null if there are no values; with ``by``, a group without values has no row; null
    keys are a group."""
    by = by or []
    return quantiles_of_counts(value_counts(df, value, by), qs, by, ranges)


def quantiles_of_counts(counts: DataFrame, qs: list[float], by: list[str], ranges: int = RANGES) -> DataFrame:
    """``quantiles`` from a table of ``value_counts``."""
    counts = in_ranges(counts, by, ranges)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row a range
    totals = (counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_m"))
              .withColumn("_end", F.sum("_m").over(group.orderBy("_b"))).withColumn("_all", F.sum("_m").over(group)))
    place = F.col("_q") * (F.col("_all") - 1)
    wanted = (totals.select(*by, "_b", (F.col("_end") - F.col("_m")).alias("_before"), "_end", "_all",
                            F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("_i", "_q"))
              .withColumn("_p", place)
              .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p")))))
              .where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_end")))
              .groupBy(*by, "_b").agg(F.first("_before").alias("_before"), F.collect_list(F.struct("_i", "_r", "_p")).alias("_w")))
    c, w = counts.alias("c"), wanted.alias("w")
    if not by:
        w = F.broadcast(w)  # at most two ranges a quantile
    same = reduce(Column.__and__, [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*by, "_b"]])
    found = c.join(w, same).select(*[F.col(f"c.{k}").alias(k) for k in by], F.col("c._b").alias("_b"), "_v", "_n", "_before", "_w")
    upto = F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_v"))
    found = (found.withColumn("_end", F.col("_before") + upto)
             .withColumn("_h", F.filter("_w", lambda x: (x["_r"] < F.col("_end")) & (x["_r"] >= F.col("_end") - F.col("_n"))))
             .select(*by, "_v", F.explode("_h").alias("_h")))
    p = F.max("_h._p")
    low, high = (F.max(F.when(F.col("_h._r") == at("_h._p"), F.col("_v"))) for at in (F.floor, F.ceil))
    one = found.groupBy(*by, F.col("_h._i").alias("_i")).agg(p.alias("_p"), low.alias("_lo"), high.alias("_hi"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.ceil("_p") - F.col("_p")) * F.col("_lo") + (F.col("_p") - F.floor("_p")) * F.col("_hi"))
    every = F.map_from_entries(F.collect_list(F.struct("_i", value.alias("_q"))))
    return one.groupBy(*by).agg(F.transform(F.sequence(F.lit(0), F.lit(len(qs) - 1)), lambda i: F.try_element_at(every, i)).alias("q"))


def quantiles_of(df: DataFrame, value: Column, qs: list[float]) -> Column:
    """The array of ``quantiles`` over all rows as a scalar subquery, for use in another query."""
    return quantiles(df, value, qs).scalar()


def medians(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row with the median of each of several columns, in one pass over ``df``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(columns.values())])).alias("x"))
    q = quantiles(long.select("x.i", "x.v"), F.col("v"), [0.5], ["i"])
    return q.agg(*[F.max(F.when(F.col("i") == i, F.get("q", 0))).alias(name) for i, name in enumerate(columns)])
