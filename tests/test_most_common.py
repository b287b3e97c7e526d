"""Exact most common items (K11, K14, K21) and the bucketed stored set."""

import random
import uuid
from collections import Counter

from pyspark.sql import functions as F

from vulnlake.operators import joins
from vulnlake.operators.windows import most_common


def want(items, k):
    c = Counter(items)
    return sorted(c.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]


def run(spark, items, k, tracked=4096):
    df = spark.createDataFrame([(x,) for x in items], "w string").repartition(6)
    out = most_common(df, F.col("w"), k, tracked)
    return out, [(r["item"], r["n"]) for r in out.collect()]


def exchanged(df) -> int:
    """Rows written to all exchanges of an executed query, subqueries included, each exchange once."""
    seen: dict = {}

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            walk(node.plan())
        found = node.metrics().get("shuffleRecordsWritten")
        if found.isDefined():
            seen[found.get().id()] = found.get().value()
        for group in (node.children(), node.subqueries()):
            for i in range(group.size()):
                walk(group.apply(i))
    walk(df._jdf.queryExecution().executedPlan())
    return sum(seen.values())


def test_heavy_items_need_no_full_count(spark):
    r = random.Random(3)
    items = [f"h{i}" for i in range(12) for _ in range(1400 + 10 * i)] + [f"r{r.randrange(10**9)}" for _ in range(20_000)] + [None] * 2700
    r.shuffle(items)
    df = spark.createDataFrame([(x,) for x in items], "w string").coalesce(6)
    out = most_common(df, F.col("w"), 8, 256)
    assert sorted(((x["item"], x["n"]) for x in out.collect()), key=str) == sorted(want(items, 8), key=str)
    assert exchanged(out) < 6 * 2 * 256  # tasks x summary: far fewer than the 20,000 distinct items


def test_flat_counts_fall_back_to_the_full_count(spark):
    items = [f"w{i:05d}" for i in range(9000) for _ in range(1 + (i % 3 == 0))]  # 3,000 items tie for the first place
    _, got = run(spark, items, 5, tracked=64)
    assert got == [("w00000", 2), ("w00003", 2), ("w00006", 2), ("w00009", 2), ("w00012", 2)]


def test_threshold_decides(spark):
    """The same table with a summary that can and one that cannot decide: the same rows."""
    items = [f"a{i}" for i in range(300) for _ in range(i + 1)]
    assert sorted(run(spark, items, 10, 4096)[1]) == sorted(run(spark, items, 10, 16)[1]) == sorted(want(items, 10))


def test_few_items_and_none(spark):
    assert sorted(run(spark, ["x", "y", "x", None], 5)[1], key=str) == sorted([("x", 2), ("y", 1), (None, 1)], key=str)
    assert run(spark, [], 5)[1] == []


def test_stored_side_is_not_exchanged(spark, tmp_path):
    name = f"seen_{uuid.uuid4().hex[:8]}"
    old = spark.createDataFrame([(f"k{i}",) for i in range(500)] + [("k1",), (None,)], "cve_id string")
    joins.store_keys(old, name, str(tmp_path / name), buckets=8)
    new = spark.createDataFrame([(f"k{i}", i) for i in range(400, 700)] + [(None, 0)], "cve_id string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.new_only_stored(new, name)
        assert sorted(map(str, out.collect())) == sorted(map(str, joins.new_only(new, old).collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
        stored = plan[plan.index("Bucketed: true") - 2000:plan.index("Bucketed: true")] if "Bucketed: true" in plan else ""
        assert plan.count("Exchange hashpartitioning") // max(1, plan.count("== Final Plan ==") + plan.count("== Initial Plan ==")) <= 1, plan
        assert "Bucketed: true" in plan and stored
        joins.store_keys(spark.createDataFrame([("k650",)], "cve_id string"), name, str(tmp_path / name), buckets=8)
        assert joins.new_only_stored(new, name).where("cve_id = 'k650'").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
