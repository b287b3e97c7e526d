"""Work that must not grow faster than the input: packed files, bounded batches, one parse, narrow joins."""

import __spark_entry__ as E
from pyspark.sql import functions as F

from vulnlake.operators import windows as wn
from vulnlake.plans import registry as rg
from vulnlake.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_packed_files_read_like_loose_ones(spark, tmp_path):
    rows = [("a", "x\r\ny"), ("b", "z"), ("b", "z"), ("c", None), (None, "n")]
    sinks.pack_files(spark.createDataFrame(rows, "name string, text string"), str(tmp_path / "p"), "name", "text")
    got = {r.file_name: r.text for r in readers.read_patches(spark, str(tmp_path / "p"), packed=True).collect()}
    assert got == {"a": "x\r\ny\n", "b": "z\nz\n", "c": "\n", None: "n\n"}
    got = {r.file: (r.length, r.content) for r in readers.read_snapshots(spark, str(tmp_path / "p"), packed=True).collect()}
    assert got == {"a": (5, "x\ny\n"), "b": (4, "z\nz\n"), "c": (1, "\n"), None: (2, "n\n")}


def test_file_reads_do_not_make_a_file_a_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rg, "scratch_dir", lambda spark, name: str(tmp_path / name))
    for name in ("s05", "s09"):
        query = next(q for q in E.queries() if q.startswith(f"{name}_"))
        assert E.queries()[query](spark, SF).count() > 100
        assert len(list((tmp_path / name).rglob("*.parquet"))) < 100


def test_score_gets_batches_bounded_in_bytes(spark):
    from vulnlake.operators import intent
    df = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("prompt"))
    out = intent.score(df, "prompt", lambda ps: [str(len(ps))] * len(ps)).agg(F.max(F.col("reply").cast("int")), F.count("reply")).first()
    assert out[0] < 2000 and out[1] == 4000


def test_replies_are_parsed_once_a_row(spark):
    plan = rg._snippet_findings(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 and "size(" not in plan.split("Generate")[1]


def test_surrounding_by_window_and_by_rank_agree(spark):
    rows = [("r", f"2024-0{1 + i // 9}-{1 + i % 9:02d}", f"s{i:02d}") for i in range(40)] + [("q", "2024-01-01", "t"), ("q", "2024-01-01", "t")]
    rows += [(None, "2024-01-01", f"n{i}") for i in range(7)] + [("r", None, f"z{i}") for i in range(7)] + [("q", "2024-03-01", None)]
    df = spark.createDataFrame(rows, "repository string, d string, sha string").select("repository", F.to_timestamp("d").alias("commit_ts"), "sha")
    key = lambda r: str(r)
    want = sorted(wn.surrounding_commits(df, hot=0).collect(), key=key)
    assert sorted(wn.surrounding_commits(df).collect(), key=key) == want
    assert sorted(wn.surrounding_commits(df, hot=5).collect(), key=key) == want
    plan = wn.surrounding_commits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_commit_joins_carry_no_files(spark):
    plan = E.queries()["p33_commit_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Join LeftOuter")[0]
    assert "md5" not in top.split("files")[0] and "array_join(array_sort" not in top


def test_index_rows_stand_in_their_own_row_groups(spark):
    import os

    import pyarrow.parquet as pq

    from vulnlake.llm import bm25, common
    df = spark.createDataFrame([(os.urandom(6 << 20),) for _ in range(6)], "b binary").coalesce(1)
    files = common.stage_table(df, "large", common.LARGE_ROWS).inputFiles()
    assert sum(pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in files) >= 3
    assert "LARGE_ROWS" in bm25.__dict__
