"""Per-CVE texts as bounded chunks."""

from pyspark.sql import functions as F

from vulnlake.operators import chunks, intent, joins
from vulnlake.sources import readers, sinks


def hot_refs(spark, n=3000):
    """A CVE with most of all references, some others, repeated positions and a null key."""
    rows = [("hot", i, f"https://github.com/o/r/commit/c{i:04d}" if i % 3 else None, ["Patch"] if i % 2 else None) for i in range(n)]
    rows += [(f"c{i}", p, f"https://x.org/{i}/{p}", ["a", "b"]) for i in range(40) for p in range(3)] + [("c1", 1, "u", None), (None, 0, "https://github.com/o/r/commit/x", None)]
    return spark.createDataFrame(rows, "cve_id string, pos int, url string, tags array<string>").repartition(7)


def test_chunks_are_bounded_and_join_to_the_text(spark):
    pieces = hot_refs(spark).select("cve_id", "pos", F.coalesce("url", F.lit("N/A")).alias("text"))
    out = chunks.text_chunks(pieces, "cve_id", "pos", "text", most=500, bucket=64).collect()
    want: dict = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.pos, r.text)):
        want[r.cve_id] = want.get(r.cve_id, "") + r.text
    got: dict = {}
    for r in sorted(out, key=lambda r: r.chunk):
        got[r.cve_id] = got.get(r.cve_id, "") + r.text
    assert got == want
    assert max(len(r.text) for r in out) <= 500 + 40 and sum(r.cve_id == "hot" for r in out) > 100
    assert {r.cve_id: r.text for r in chunks.folded(chunks.text_chunks(pieces, "cve_id", most=300), "cve_id").collect()} == want


def test_offsets_never_sort_a_whole_key_in_one_window(spark):
    pieces = hot_refs(spark).select("cve_id", "pos", F.lit("x").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = chunks.text_chunks(pieces, "cve_id", bucket=64)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    wide = [line for line in by if "_b" not in line and "_tb" not in line and "chunk" not in line]
    assert len(wide) <= 1  # the totals of the buckets, one row each


def test_prompt_chunks_equal_the_prompt(spark):
    refs = hot_refs(spark).where("cve_id is not null")
    cves = spark.createDataFrame([("hot", "all of it"), ("c1", None), ("alone", "no references")], "cve_id string, description string")
    scraped = spark.createDataFrame([("c1", "https://x.org/1/0", "page text"), ("zz", "u", "other")], "cve_id string, url string, scraped_text string")
    parts = intent.intent_prompt_chunks(cves, refs, scraped, most=2000).collect()
    whole = {r.cve_id: r.prompt for r in intent.intent_prompt(cves, refs, scraped).collect()}
    assert whole.keys() == {"hot", "c1", "alone"} and max(len(r.text) for r in parts) < 2700
    for k, text in whole.items():
        assert text == "".join(r.text for r in sorted(parts, key=lambda r: r.chunk) if r.cve_id == k)
        assert text.startswith(intent.PROMPT_HEAD) and text.endswith(intent.PROMPT_TAIL)
    assert whole["alone"] == intent.PROMPT_HEAD + "no references.\n\nReferences:\n" + intent.PROMPT_TAIL
    assert "- URL: https://x.org/1/0, Tags: [a, b]\n\n---\nScraped Content from https://x.org/1/0:\npage text\n---\n- URL: " in whole["c1"]
    assert whole["hot"].count("- URL: ") == 3000 and whole["hot"].index("c0001") < whole["hot"].index("c2999")


def test_related_commits_in_reference_order(spark):
    out = {r.cve_id: r for r in joins.github_summary_long(hot_refs(spark)).collect()}
    assert out["hot"].related_commits == ",".join(f"c{i:04d}" for i in range(3000) if i % 3)
    assert out["c1"].related_commits == "" and out[None].related_commits == "x" and out["hot"].fix_commit == "c0001"
    parts = joins.related_commit_chunks(hot_refs(spark), most=600).where("cve_id = 'hot'")
    assert parts.count() > 15 and parts.agg(F.max(F.length("text"))).first()[0] <= 606


def test_findings_of_a_large_cve_are_several_documents(spark, tmp_path):
    rows = [("hot", "o/r", f"f{i:04d}.c", [i], {str(i): "s"}) for i in range(900)] + [("c", "o/r", "x.c", [1, 2], {"1": "a"}), ("d", None, "y.c", [3], {})]
    df = spark.createDataFrame(rows, "cve_id string, repo_name_from_patch string, file_path string, line_numbers array<int>, introducing_commits map<string,string>")
    sinks.write_finding_rows(df, str(tmp_path / "f"), most=100)
    back = readers.read_findings(spark, str(tmp_path / "f"), multi_line=False)
    assert back.agg(F.max(F.size("vulnerable_snippets"))).first()[0] < 200
    items = back.select("cve_id", F.inline("vulnerable_snippets"))
    assert {(r.cve_id, r.file_path, tuple(r.line_numbers)) for r in items.collect()} == {(a, f, tuple(n)) for a, repo, f, n, _ in rows if repo}
    assert items.count() == 901
