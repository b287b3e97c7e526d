"""Findings on the disk of the scoring rounds and the time of op4."""

import json
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from vulnlake.llm import bm25
from vulnlake.operators import findings, intent
from vulnlake.session import checkpoint_dir


def test_scoring_rounds_keep_texts_once(spark):
    """Prompts and replies are on disk once a round, compressed; before, 5.7 times the prompts here."""
    r = random.Random(4)
    texts = [(i, r.randbytes(6_000).hex()) for i in range(300)]
    df = spark.createDataFrame(texts, "cve_id long, prompt string").repartition(3).cache()
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))

    def size():
        return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    out = intent.score_until(df, "prompt", lambda ps: ps, lambda c: (F.length(c) + F.ascii(c)) % 7 > 4, lambda d: d.withColumn("prompt", F.concat("prompt", F.lit("!"))))
    assert sorted(x[0] for x in out.select("cve_id").collect()) == list(range(300))
    assert size() - before < 3.5 * 300 * 12_000, (size() - before) / 300 / 12_000
    df.unpersist()


def test_scoring_round_of_repeated_stored_null_and_failing_prompts(spark, tmp_path):
    """Rows with the same prompt, stored prompts, prompts that fail and null ones, beside a column that is null by type."""
    log, store = tmp_path / "calls", str(tmp_path / "replies")
    log.mkdir()

    def model(prompts):
        import uuid
        (log / uuid.uuid4().hex).write_text(json.dumps(list(prompts)))
        if any(p.startswith("f") for p in prompts):
            raise RuntimeError("no answer")
        return [f"ok {p}" if "!" in p or p.startswith("a") else "bad" for p in prompts]

    def calls():
        return [p for f in log.iterdir() for p in json.loads(f.read_text())]
    rows = [(1, "a1"), (2, "a2"), (2, "a2"), (None, "b1"), (4, "b1"), (5, "b2"), (6, None), (None, None), (8, "f1"), (9, "f2"), (9, "f2")]
    df = spark.createDataFrame(rows, "cve_id long, prompt string").withColumn("none", F.lit(None)).withColumn("reply", F.lit("old"))
    fix = lambda d: d.withColumn("prompt", F.when(F.col("prompt").startswith("f"), F.col("prompt")).otherwise(F.concat("prompt", F.lit("!"))))
    want = sorted([(1, "a1", None, "ok a1"), (2, "a2", None, "ok a2"), (2, "a2", None, "ok a2"), (None, "b1!", None, "ok b1!"), (4, "b1!", None, "ok b1!"),
                   (5, "b2!", None, "ok b2!"), (6, None, None, None), (None, None, None, None), (8, "f1", None, None), (9, "f2", None, None), (9, "f2", None, None)], key=str)
    for k in range(2):  # the second run asks only what failed
        out = intent.score_until(df, "prompt", model, lambda c: c.startswith("ok"), fix, rounds=2, store=store)
        assert out.columns == ["cve_id", "prompt", "none", "reply", "reply_error"]
        got = out.collect()
        assert sorted((tuple(x[:4]) for x in got), key=str) == want
        assert all("no answer" in x.reply_error if (x.prompt or "").startswith("f") else x.reply_error is None for x in got)
        answered = [p for p in calls() if not p.startswith("f")]
        assert set(answered) == {"a1", "a2", "b1", "b2", "b1!", "b2!"}
    # prompts in a batch with a failing one are asked again alone, so twice at most, and not by the second run
    assert max(map(answered.count, answered)) <= 2


def test_met_prompts_are_told_by_their_bits(spark, tmp_path):
    store = str(tmp_path / "replies")
    hashes = spark.range(3000).select(F.sha2((F.col("id") % 2900).cast("string"), 256).alias("prompt_hash"))
    hashes.where("false").selectExpr("prompt_hash", "'' as reply", "'' as error").write.parquet(store)
    spark.range(2890, 2950).selectExpr("sha2(cast(id as string), 256) as prompt_hash", "if(id % 2 = 0, 'r', null) as reply", "'' as error").write.mode("append").parquet(store)
    met = intent.met_before(hashes, store)
    every = hashes.distinct().toPandas()["prompt_hash"]
    told = set(every[intent.is_met(every, met)])
    sure = {h[0] for h in spark.range(2900).where("id < 100 or (id >= 2890 and id % 2 = 0)").selectExpr("sha2(cast(id as string), 256)").collect()}
    assert sure <= told and len(told) < len(sure) + 20


def test_findings_are_parsed_once_a_row(spark):
    """Each search, cut and parse stands once in the plan; before, the parse stood in it four times."""
    df = spark.createDataFrame([("x ```json\n[1]\n``` y",)], "r string").select(findings.parse_findings(F.col("r")).alias("p")).select("p.status")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first()[0] == "item_not_dict"
    assert plan.lower().count("parsejson") == 1 and plan.lower().count("substring") == 1, plan


def test_bm25_task_returns_its_best_once(spark, monkeypatch):
    """A task of many shards returns at most k rows a query, with ties by id over all its shards; before, up to k for each shard."""
    docs = spark.createDataFrame([(i, f"same words w{i % 9} " + "x " * (i % 5)) for i in reversed(range(600))] + [(None, "same words")] * 2, "doc_id long, text string").coalesce(1)
    asked = docs.where("doc_id % 15 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, bm25.search(bm25.build(docs), asked, 4).collect()), key=str)
    monkeypatch.setattr(bm25, "SHARD", 1_500)
    index = bm25.build(docs).coalesce(1)
    assert index.count() > 20
    sizes, ranked = [], bm25.ranked
    monkeypatch.setattr(bm25, "ranked", lambda found, k: sizes.append(found.count()) or ranked(found, k))
    got = sorted(map(tuple, bm25.search(index, asked, 4).collect()), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    assert len(got) == 160 and sizes == [160, 320], sizes
