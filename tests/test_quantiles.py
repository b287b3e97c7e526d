"""Exact distributed quantiles (A24, A28, A30-A32, K13, K16) against numpy and the built-in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from vulnlake.operators import quantiles as qt

SF = "/root/testdata/sf0.001"
QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.995, 1.0]


def table(spark, rows, schema="g string, v double"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_equals_builtin_on_skewed_groups(spark, ranges):
    r = np.random.default_rng(5)
    rows = [("hot", 3.0)] * 700 + [("hot", float(x)) for x in np.round(r.lognormal(3, 2, 500), 2)]  # one value holds over half
    rows += [("even", float(x)) for x in r.normal(0, 1e6, 301)] + [("one", -0.25)] + [("two", 1.0), ("two", 2.0)]
    rows += [(None, float(i)) for i in range(11)] + [("hot", None), ("none", None)]
    df = table(spark, rows)
    got = {r["g"]: list(r["q"]) for r in qt.quantiles(df, F.col("v"), QS, ["g"], ranges).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", QS).alias("q")).collect() if r["q"] is not None}
    assert got.keys() == want.keys() == {"hot", "even", "one", "two", None}
    for g in want:
        assert got[g] == pytest.approx(list(want[g]), rel=1e-12), g
    assert list(qt.quantiles(df, F.col("v"), QS, None, ranges).first()["q"]) == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], QS)))


def test_empty_and_null_only(spark):
    assert qt.quantiles(table(spark, []), F.col("v"), [0.5]).first()["q"] == [None]
    assert qt.quantiles(table(spark, [("a", None)]), F.col("v"), [0.5]).first()["q"] == [None]
    assert qt.quantiles(table(spark, [("a", None)]), F.col("v"), [0.5], ["g"]).count() == 0
    m = qt.medians(table(spark, [("a", 1.0), ("b", 4.0), ("c", None)]), {"x": F.col("v"), "y": F.length("g"), "z": F.lit(None).cast("double")}).first()
    assert (m["x"], m["y"], m["z"]) == (2.5, 1.0, None)


def test_nan_is_largest(spark):
    df = table(spark, [("a", float(x)) for x in (1, 2, 3)] + [("a", float("nan"))])
    q = qt.quantiles(df, F.col("v"), [0.0, 1.0]).first()["q"]
    assert q[0] == 1.0 and np.isnan(q[1])


def test_ranges_are_ordered_and_even(spark):
    """No range holds more than a small part of the distinct values, whatever their spread."""
    r = np.random.default_rng(1)
    v = np.unique(np.concatenate([r.lognormal(0, 8, 20_000), r.uniform(1, 1 + 1e-6, 20_000)]))
    counts = qt.value_counts(table(spark, [("a", float(x)) for x in v]), F.col("v"), [])
    b = qt.in_ranges(counts, []).groupBy("_b").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).orderBy("_b").collect()
    assert sum(x["n"] for x in b) == len(v) and max(x["n"] for x in b) < 12 * len(v) / qt.RANGES
    assert all(x["hi"] < y["lo"] for x, y in zip(b, b[1:]))


def test_no_builtin_percentile_in_the_plans(spark):
    for name in ("a24_size_report", "a28_hist2d", "a30_size_decile", "a31_box_stats", "a32_upper_cut", "k13_patch_size", "k16_score_stats"):
        p = E.queries()[name](spark, SF)._jdf.queryExecution().toString().lower()
        assert "percentile" not in p and "median(" not in p and "cartesian" not in p, name
