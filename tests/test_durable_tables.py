"""Tables that survive lost writers: versioned snapshots (W01), bucketed state (W08 / J12), the
duplicate drop (T02), late rows (T03) and stored replies (U03)."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import coverage, intent, joins
from vulnlake.sources import readers, sinks
from vulnlake.sources import snapshots as sn
from vulnlake.streaming import incremental as stm


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/part-*", recursive=True) if f"/{sn.MANIFEST}/" not in f}


# ---------------------------------------------------------------- snapshots
def test_unpublished_write_leaves_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sn.read_snapshot(spark, path)
    old = spark.createDataFrame([("CVE-1", "a/b"), ("CVE-2", None)], "cve_id string, repository string")
    sinks.write_cves(old, path)
    sn.stage(old.limit(1), path)  # the writer is lost between its files and the manifest
    assert rows(readers.read_cve_table(spark, path)) == rows(old)

    @F.udf("string")
    def fail(x):
        raise RuntimeError("lost")
    with pytest.raises(Exception, match="lost"):
        sinks.write_cves(old.withColumn("repository", fail("cve_id")), path)  # the writer is lost among its files
    assert rows(readers.read_cve_table(spark, path)) == rows(old)


def test_rewrite_reads_its_own_table_and_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_cves(spark.createDataFrame([("CVE-1", 2020), ("CVE-2", 2021)], "cve_id string, year int"), path, partition_by="year")
    was = sn.current(spark, path)
    reader = readers.read_cve_table(spark, path)
    sinks.write_cves(readers.read_cve_table(spark, path).withColumn("cve_id", F.concat("cve_id", F.lit("x"))), path, fmt="json")
    assert rows(readers.read_cve_table(spark, path)) == [("CVE-1x", 2020), ("CVE-2x", 2021)]
    assert rows(reader) == rows(sn.read_snapshot(spark, path, was)) == [("CVE-1", 2020), ("CVE-2", 2021)]  # a reader keeps its version
    assert [v.number for v in sn.versions(spark, path)] == [1, 2]
    sinks.write_cves(spark.createDataFrame([], "cve_id string, year int"), path)
    assert readers.read_cve_table(spark, path).count() == 0


def test_cves_without_repository_are_not_written(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([("CVE-1", ("a/b",)), ("CVE-2", (None,)), ("CVE-3", ("",))], "cve_id string, github_data struct<repository:string>")
    sinks.write_cves(d, path)
    assert [r.cve_id for r in readers.read_cve_table(spark, path).collect()] == ["CVE-1"]


# ---------------------------------------------------------------- bucketed state
@pytest.mark.parametrize("overwrite", [True, False])
def test_state_update_equals_upsert_and_leaves_other_buckets(spark, tmp_path, overwrite):
    path = str(tmp_path / "state")
    schema = "key string, status string"
    old = spark.createDataFrame([(f"k{i}", "failed") for i in range(200)] + [(None, "odd")], schema)
    sinks.update_state(old, path, buckets=32)
    before = files(path)
    new = spark.createDataFrame([("k7", "success"), ("new", "success"), ("k8", None), (None, "odder")], schema)
    sinks.update_state(new, path, overwrite)
    assert rows(sn.read_snapshot(spark, path)) == rows(joins.upsert_state(old, new, overwrite))
    after = files(path)
    assert before.items() <= after.items()  # no old file is touched
    v1, v2 = sn.versions(spark, path)
    changed = {b for b in v2.folders if v1.folders.get(b) != v2.folders[b]}
    assert changed == {str(b) for b in sn.touched(new, "key", 32)} and len(changed) <= 4
    read = set(sn.read_buckets(spark, path, sn.touched(new, "key", 32), v1).inputFiles())
    assert len(read) <= 4 < len(before)
    sinks.update_state(spark.createDataFrame([], schema), path)  # nothing to do is a version too
    assert rows(sn.read_snapshot(spark, path)) == rows(joins.upsert_state(old, new, overwrite))


def test_state_batch_lost_before_its_manifest(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "state"), "key string, status string"
    sinks.update_state(spark.createDataFrame([("a", "x"), ("b", "y")], schema), path, buckets=4)

    def lost(*_):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(sn, "publish", lost)
        with pytest.raises(RuntimeError):
            sinks.update_state(spark.createDataFrame([("a", "z")], schema), path)
    assert rows(sn.read_snapshot(spark, path)) == [("a", "x"), ("b", "y")]
    sinks.update_state(spark.createDataFrame([("a", "z"), ("a", "w")], schema), path)  # again; a repeated key takes its largest
    assert rows(readers.read_state(spark, path, "buckets")) == [("a", "z"), ("b", "y")]


# ---------------------------------------------------------------- duplicate drop
def test_dedupe_replay_with_null_keys(spark, tmp_path):
    src, sink, schema = str(tmp_path / "src"), str(tmp_path / "out"), "cve_id string, n int"
    first = [("a", 2), ("a", 1), (None, 5), (None, 4), ("b", 3)]
    spark.createDataFrame(first, schema).write.json(src + "/b1")
    like = spark.createDataFrame([], schema)
    for ck in ("ck1", "ck2"):  # a lost checkpoint: everything runs again
        stm.run_dedupe(stm.stream_cves(spark, src + "/*", like.schema), sink, str(tmp_path / ck), buckets=8)
        assert rows(stm.read_deduped(spark, sink, like.schema)) == [("a", 1), ("b", 3), (None, 4)]
    spark.createDataFrame([("c", 1), (None, 1), ("a", 0)], schema).write.json(src + "/b2")
    stm.run_dedupe(stm.stream_cves(spark, src + "/*", like.schema), sink, str(tmp_path / "ck2"), buckets=8)
    assert rows(stm.read_deduped(spark, sink, like.schema)) == [("a", 1), ("b", 3), ("c", 1), (None, 4)]


def test_dedupe_reads_only_the_batch_buckets(spark, tmp_path):
    src, sink, schema = str(tmp_path / "src"), str(tmp_path / "out"), "cve_id string"
    spark.createDataFrame([(f"k{i}",) for i in range(400)], schema).write.json(src + "/b1")
    like = spark.createDataFrame([], schema)
    stm.run_dedupe(stm.stream_cves(spark, src + "/*", like.schema), sink, str(tmp_path / "ck"), buckets=64)
    seen = stm.stored_keys(spark, sink, like.schema["cve_id"], [3, 4])
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket#", "").replace("cast(", "") or "PartitionFilters" in plan
    names = {f.split("_bucket=")[1].split("/")[0] for f in seen.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert names == {"3", "4"} and stm.read_deduped(spark, sink, like.schema).count() == 400


# ---------------------------------------------------------------- late rows
def test_weekly_stream_with_late_rows_equals_batch(spark, tmp_path):
    p = {k: str(tmp_path / k) for k in ("src", "now", "late", "out", "ck")}
    schema, monday = "cve_id string, published_date timestamp, has_commit boolean", dt.datetime(2024, 1, 1, 12)
    day = lambda n: monday + dt.timedelta(days=n)
    batches = [[(f"a{i}", day(i), i % 2 == 0) for i in range(60)],
               [("late1", day(3), True), ("late2", day(-400), False), ("near", day(55), True), ("none", None, True), ("new", day(90), False)],
               [("late3", day(3), False), ("late4", day(57), True), ("new2", day(91), True)]]
    like = spark.createDataFrame([], schema).schema
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).write.json(f"{p['src']}/b{n}")
        stm.route_late(stm.stream_cves(spark, p["src"] + "/*", like), p["now"], p["late"], p["ck"] + "/r", delay="14 days")
        stm.run_weekly(stm.stream_weekly(stm.stream_cves(spark, p["now"] + "/*", like, "parquet"), delay="14 days"), p["out"], p["ck"] + "/w")
    late = spark.read.schema(like).parquet(p["late"] + "/*")
    assert {r.cve_id for r in late.collect()} == {"late1", "late2", "late3", "late4"}
    got = rows(stm.fold_late(sn.read_snapshot(spark, p["out"]), late))
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = coverage.coverage_by(every.where("published_date is not null"), "week").select(F.date_format("bucket", "yyyy-MM-dd").alias("week"), "n_all", "n_with")
    assert got == rows(want)
    streamed = {r.week: r.n_all for r in sn.read_snapshot(spark, p["out"]).collect()}
    assert streamed["2024-01-01"] == 7 and dict((r[0], r[1]) for r in got)["2024-01-01"] == 9


# ---------------------------------------------------------------- stored replies
def test_each_prompt_is_asked_once_across_a_replay(spark, tmp_path):
    log, store = str(tmp_path / "calls"), str(tmp_path / "replies")
    os.makedirs(log)

    def count_calls(prompts):
        import uuid
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            json.dump(list(prompts), f)
        return [f"ok {p}" if not p.startswith("p3") or p.endswith("!") else "bad" for p in prompts]

    def calls():
        return sorted(p for f in glob.glob(log + "/*") for p in json.load(open(f)))
    df = spark.range(40).select(F.col("id").cast("string").alias("cve_id"), F.concat(F.lit("p"), (F.col("id") % 5)).alias("prompt"), F.lit(1).alias("prompt_x"))
    df = df.unionByName(spark.createDataFrame([("n", None, 1)], df.schema))
    good, fix = (lambda c: c.startswith("ok")), (lambda d: d.withColumn("prompt", F.concat("prompt", F.lit("!"))))
    for _ in range(2):  # the second run is the replay
        out = intent.score_until(df, "prompt", count_calls, good, fix, rounds=2, store=store)
        got = rows(out.select("cve_id", "reply"))
        assert calls() == ["p0", "p1", "p2", "p3", "p3!", "p4"]
        assert len(got) == 41 and ("3", "ok p3!") in got and ("n", None) in got and ("0", "ok p0") in got


def test_failed_prompts_are_asked_again_and_finished_tasks_kept(spark, tmp_path):
    store, flag = str(tmp_path / "replies"), str(tmp_path / "flag")

    def fails_first(prompts):
        if any(p == "p2" for p in prompts) and not os.path.exists(flag):
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]
    df = spark.range(4).select(F.concat(F.lit("p"), F.col("id")).alias("prompt"))
    first = {r.prompt: (r.reply, r.reply_error) for r in intent.score_stored(df, "prompt", fails_first, store).collect()}
    assert first["p1"] == ("P1", None) and first["p2"][0] is None and "no answer" in first["p2"][1]
    open(flag, "w").close()
    again = {r.prompt: (r.reply, r.reply_error) for r in intent.score_stored(df, "prompt", fails_first, store).collect()}
    assert again == {f"p{i}": (f"P{i}", None) for i in range(4)}
