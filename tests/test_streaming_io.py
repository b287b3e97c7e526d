"""Streaming and I/O queries against their batch equivalents:
files added in two batches, exactly-once reads, duplicate drop, reject reporting."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from vulnlake.operators import coverage
from vulnlake.plans import derived as dv

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_reads_each_file_once(spark):
    got = E.queries()["t01_stream_cves"](spark, SF)
    want = dv.dv_cve(spark, SF).select("cve_id", "repository")
    assert rows(got) == rows(want)


def test_stream_dedupe_drops_copies(spark):
    got = E.queries()["t02_stream_dedupe"](spark, SF)
    assert got.count() == dv.dv_cve(spark, SF).count() == got.select("cve_id").distinct().count()


def test_stream_weekly_equals_batch(spark):
    got = E.queries()["t03_stream_weekly"](spark, SF)
    want = coverage.coverage_by(dv.dv_cve(spark, SF), "week").select(
        F.col("bucket").cast("string").alias("bucket"), "n_all", "n_with")  # registered queries give dates as text
    assert rows(got) == rows(want)


def test_cve_documents_round_trip(spark):
    got = E.queries()["w01_write_cves"](spark, SF)
    assert rows(got) == rows(dv.dv_cve(spark, SF).select("cve_id", "repository"))


def test_rejects_are_reported_not_fatal(spark):
    bad = E.queries()["s02_read_cves_rejects"](spark, SF)
    assert bad.count() == dv.table(spark, SF, "documents").count()
    good = E.queries()["s02_read_cves"](spark, SF)
    assert good.count() == dv.dv_cve(spark, SF).count()


def test_append_keeps_both_writes(spark):
    out = E.queries()["w05_append_results"](spark, SF)
    n = dv.table(spark, SF, "documents").count()
    n7 = dv.table(spark, SF, "documents").filter(F.col("doc_id").cast("string").endswith("7")).count()
    assert out.count() == n + n7


def test_feed_keeps_page_order(spark):
    f = E.queries()["s01_read_cve_feed"](spark, SF)
    assert f.count() == dv.dv_cve(spark, SF).count()
    assert f.select("page", "pos").distinct().count() == f.count()


def test_state_and_index_documents(spark, tmp_path):
    """The reference's layouts: one pretty-printed JSON document per file."""
    from vulnlake.sources import readers
    (tmp_path / "st").mkdir()
    (tmp_path / "st" / "clone_state.json").write_text('{\n  "a/b": "success",\n  "c/d": "failed: x"\n}\n')
    st = readers.read_state(spark, str(tmp_path / "st"), fmt="object")
    assert sorted(tuple(r) for r in st.collect()) == [("a/b", "success"), ("c/d", "failed: x")]
    (tmp_path / "nm").mkdir()
    (tmp_path / "nm" / "done.json").write_text('[\n  "x.patch",\n  "y.patch"\n]\n')
    assert sorted(r.key for r in readers.read_state(spark, str(tmp_path / "nm"), fmt="names").collect()) == ["x.patch", "y.patch"]
    (tmp_path / "ix").mkdir()
    (tmp_path / "ix" / "index.json").write_text(
        '{\n  "CVE-1": [\n    {"url": "u1", "filename": "f1.txt"},\n    {"url": "u2", "filename": "f2.txt"}\n  ]\n}\n')
    ix = readers.read_scrape_index(spark, str(tmp_path / "ix"))
    assert sorted(tuple(r) for r in ix.collect()) == [("CVE-1", "u1", "f1.txt"), ("CVE-1", "u2", "f2.txt")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "CVE-1_a_b.patch").write_text("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n")
    (tmp_path / "p" / "empty.patch").write_text("")
    ps = readers.read_patches(spark, str(tmp_path / "p"))
    rows = ps.collect()
    assert len(rows) == 1 and rows[0].file_name == "CVE-1_a_b.patch" and rows[0].text.count("\n") == 5


def test_stream_weekly_drops_rows_behind_the_watermark(spark, tmp_path):
    import datetime as dt

    from vulnlake.streaming import incremental as stm
    schema = "cve_id string, published_date timestamp, has_commit boolean"
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    monday = dt.datetime(2024, 1, 1, 12, 0)
    b1 = [(f"C{i}", monday + dt.timedelta(days=7 * i), i % 2 == 0) for i in range(10)]
    spark.createDataFrame(b1, schema).write.json(src + "/b1")

    def run():
        s = stm.stream_weekly(stm.stream_cves(spark, src + "/*", spark.createDataFrame([], schema).schema), delay="7 days")
        stm.run_available_now(s, sink, ck)

    run()
    late_and_new = [("LATE", monday + dt.timedelta(days=1), True), ("NEW", monday + dt.timedelta(days=7 * 14), False)]
    spark.createDataFrame(late_and_new, schema).write.json(src + "/b2")
    run()
    out = {r.start.date(): (r.n_all, r.n_with) for r in spark.read.parquet(sink).select("w.start", "n_all", "n_with").collect()}
    assert out[dt.date(2024, 1, 1)] == (1, 1)  # the late row of week 1 is not counted
    assert len(out) >= 9 and all(v[0] == 1 for v in out.values())


def test_dedupe_keeps_an_old_cve_after_a_new_one(spark, tmp_path):
    import datetime as dt

    from vulnlake.streaming import incremental as stm
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "cve_id string, published_date timestamp"
    for n, part in enumerate(([("CVE-2025-1", dt.datetime(2025, 1, 1))], [("CVE-1999-1", dt.datetime(1999, 1, 1)), ("CVE-2025-1", dt.datetime(2025, 1, 1))])):
        spark.createDataFrame(part, schema).write.json(f"{src}/b{n}")
        stm.run_dedupe(stm.stream_cves(spark, src + "/*", spark.createDataFrame([], schema).schema), sink, ck)
    assert sorted(r.cve_id for r in spark.read.parquet(sink).collect()) == ["CVE-1999-1", "CVE-2025-1"]


def test_documents_as_the_writers_indent_them(spark, tmp_path):
    from vulnlake.sources import readers
    d = tmp_path / "cves"
    d.mkdir()
    (d / "a.json").write_text('{\n  "cve_id": "CVE-1",\n  "vulnerability_details": {\n    "cvss_score": 7.5\n  }\n}\n')
    (d / "b.json").write_text('{\n  "cve_id": "CVE-2",\n  "vulnerability_details": {"cvss_score": "high"}\n}\n')
    (d / "c.json").write_text('{\n  "vulnerability_details": {"cvss_score": 1.0}\n}\n')
    (d / "d.json").write_text('{\n  broken\n')
    good, bad = readers.read_cves(spark, str(d)), readers.read_cves_rejects(spark, str(d))
    assert [r.cve_id for r in good.collect()] == ["CVE-1"]
    assert sorted(r._file[-6:] for r in bad.collect()) == ["b.json", "c.json", "d.json"]
    f = tmp_path / "findings"
    f.mkdir()
    (f / "CVE-9.json").write_text('{\n  "repo_name_from_patch": "o/r",\n  "vulnerable_snippets": [\n    {"file_path": "x.c"}\n  ]\n}\n')
    assert [(r.cve_id, len(r.vulnerable_snippets)) for r in readers.read_findings(spark, str(f)).collect()] == [("CVE-9", 1)]


def test_scoring_keeps_every_row(spark):
    from vulnlake.operators import intent

    def fail_on_seven(prompts):
        if any(p.endswith("7") for p in prompts):
            raise RuntimeError("no answer")
        return [f"ok {p}" for p in prompts]
    df = spark.range(20).select(F.col("id").cast("string").alias("cve_id"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))
    out = intent.score(df, "prompt", fail_on_seven).collect()
    assert sum(r.reply is None for r in out) == 2 and all("no answer" in r.reply_error for r in out if r.reply is None)
    again = intent.score_until(df, "prompt", fail_on_seven, lambda c: c.contains("ok"), lambda d: d, rounds=1)
    assert again.count() == 20
