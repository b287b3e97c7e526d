"""The four end-to-end flows on inputs derived from the test tables."""

from pyspark.sql import functions as F

from vulnlake.operators import patches as pt
from vulnlake.plans import derived as dv
from vulnlake.plans import flows
from vulnlake.plans import registry as rg
from vulnlake.session import scratch_dir

SF = "/root/testdata/sf0.001"


def test_collect_and_enrich(spark):
    raw = rg._raw_cve(spark, SF)
    cve = dv.dv_cve(spark, SF).select("cve_key", "repository", "has_commit")
    url = F.concat(F.lit("https://github.com/"), F.col("repository"),
                   F.when(F.col("has_commit"), F.concat(F.lit("/commit/"), F.md5(F.col("cve_key").cast("string"))))
                   .otherwise(F.lit("")))
    ref = F.array(F.struct(url.alias("url"), F.lit("nvd").alias("source"), F.array(F.lit("Patch")).alias("tags")))
    raw = raw.join(cve, "cve_key").withColumn("cve", F.col("cve").withField("references", ref))
    path = scratch_dir(spark, "flow-feed")
    raw.select((F.col("cve_key") / 500).cast("bigint").alias("startIndex"), "cve_key", "cve") \
       .groupBy("startIndex").agg(F.array_sort(F.collect_list(F.struct("cve_key", "cve"))).alias("v")) \
       .select("startIndex", F.transform("v", lambda x: F.struct(x["cve"].alias("cve"))).alias("vulnerabilities")) \
       .write.json(path)
    commits = rg._commits(spark, SF).select("repository", "sha", F.col("commit_date").cast("timestamp"), "n_files")
    out = flows.collect_and_enrich(spark, path, None, dv.dv_repo(spark, SF).select("repository", "size"), commits,
                                   now="2024-01-01T00:00:00")
    n = dv.dv_cve(spark, SF).count()
    assert out.count() == n
    assert out.filter(F.col("processing_status") != "enhanced").count() == 0
    with_details = out.filter(F.col("fix_commit_details").isNotNull())
    assert with_details.count() == dv.dv_cve(spark, SF).filter("has_commit").count()
    assert with_details.filter(F.col("fix_date").isNull() | ~F.col("patch_url").endswith(".patch")).count() == 0


def test_analysis_tables(spark):
    cves = dv.dv_cve(spark, SF)
    out = flows.analysis(cves, dv.dv_repo(spark, SF).select("repository", "size"), dv.dv_event_commit(spark, SF),
                         years=(1995, 2000))
    for name, df in out.items():
        assert df.count() >= 1, name


def test_malicious_intent_rule_and_model(spark):
    cves = dv.dv_desc(spark, SF).select(F.col("doc_id").cast("string").alias("cve_id"), "description")
    refs = dv.dv_ref(spark, SF).select(F.col("cve_key").cast("string").alias("cve_id"), "pos", "url", "tags")
    pages = dv.dv_ref(spark, SF).join(dv.table(spark, SF, "pages").select("page_id", "html"), "page_id") \
        .select(F.col("cve_key").cast("string").alias("cve_id"), "url", "html")
    rule = flows.malicious_intent(cves, refs, pages)
    assert rule.count() == cves.count()
    model = flows.malicious_intent(cves, refs, pages, model=rg._fake_model)
    assert model.count() == cves.count()
    assert model.filter(F.col("result.malicious_intent_likely")).count() == \
        refs.filter(F.array_contains("tags", "Exploit")).select("cve_id").distinct().join(cves, "cve_id").count()
    path = scratch_dir(spark, "flow-intent")
    flows.write_intent_results(model, path)
    assert spark.read.text(path).count() == cves.count()


def test_patch_to_snippets(spark):
    docs = dv.table(spark, SF, "documents").select("doc_id", "source")
    cve = F.concat(F.lit("CVE-2024-"), F.format_string("%07d", F.col("doc_id")))
    patch = dv.dv_patch(spark, SF).join(docs, "doc_id")
    patches = patch.select(F.concat(cve, F.lit("_"), F.col("source"), F.lit(".patch")).alias("file_name"),
                           F.regexp_replace("text", r"(?m)^(---|\+\+\+) ([ab])/[^/]*/", "$1 $2/").alias("text"))
    replies = dv.dv_reply(spark, SF).select(cve.alias("cve_id"), "reply")
    snaps = dv.dv_snapshot(spark, SF).select("repo_name", F.md5(F.col("doc_id").cast("string")).alias("sha"), "path",
                                             "content")
    hist_in = patch.select("doc_id", "text", F.col("source").alias("repo"),
                           F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
                           F.lit("2020-01-01 00:00:00").cast("timestamp").alias("ts"),
                           F.md5(F.col("doc_id").cast("string")).alias("sha"))
    history = pt.patch_lines(hist_in, ["doc_id", "repo", "file", "ts", "sha"]).select("repo", "file", "ts", "text", "sha", "sign")
    out = flows.patch_to_snippets(patches, replies, snaps, history, replies.select("cve_id"))
    ok_replies = dv.dv_reply(spark, SF).filter(F.col("doc_id") % 7 == 6).count()
    assert 0 < out.count() <= ok_replies
    assert out.filter(~F.col("code").contains("VULN>    3: ")).count() == 0


def test_patch_to_snippets_in_the_state_before_publication(spark):
    """J08 picks each CVE's state, and a path that it lacks is corrected by the model, by the table given, or by the patch."""
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, n)
    sha = {n: f"{n:040x}" for n in range(1, 6)}
    old, new = "int a;\nbad();\nint b;\n", "bad();\nint b;\nworse();\n"
    snaps = spark.createDataFrame([("o_r", sha[1], "x.c", old), ("o_r", sha[2], "x.c", old + "int c;\n"), ("o_r", sha[3], "x.c", new), ("o_r", sha[3], "y.c", new),
                                   ("o_r", sha[4], "z.c", "late\n")], "repo_name string, sha string, path string, content string")
    commits = spark.createDataFrame([("o_r", sha[1], day(1), "main"), ("o_r", sha[2], day(5), "main"), ("o_r", sha[3], day(9), "main"), ("o_r", sha[4], day(8), "side"),
                                     ("o_r", sha[5], day(3), "master")], "repo_name string, sha string, commit_ts timestamp, branch string")
    cves = spark.createDataFrame([("CVE-2024-0001", day(6)), ("CVE-2024-0002", day(10)), ("CVE-2023-0003", dt.datetime(2023, 1, 1)), ("CVE-2024-0004", day(10)),
                                  ("CVE-2024-0005", day(7))], "cve_id string, published timestamp")
    patch = "--- a/{0}\n+++ b/{0}\n@@ -1,1 +1,1 @@\n-bad();\n+good();\n"
    names = [(1, 2024, "x.c"), (2, 2024, "y.c"), (3, 2023, "x.c"), (4, 2024, "x.c"), (5, 2024, "x.c")]
    patches = spark.createDataFrame([(f"CVE-{y}-000{i}_o_r.patch", patch.format(f)) for i, y, f in names], "file_name string, text string")
    reply = "```json\n[{{\"file_path\": \"{}\", \"line_numbers\": [{}]}}]\n```"
    asked = [(1, 2024, "x.c", 2), (2, 2024, "moved.c", 7), (3, 2023, "x.c", 2), (4, 2024, "gone.c", 1), (5, 2024, "x.c", 4)]
    replies = spark.createDataFrame([(f"CVE-{y}-000{i}", reply.format(f, n)) for i, y, f, n in asked], "cve_id string, reply string")
    history = spark.createDataFrame([("o_r", "x.c", day(1), "bad();", sha[1], "+"), ("o_r", "x.c", day(5), "int c;", sha[2], "+"), ("o_r", "x.c", day(9), "bad();", sha[3], "+"),
                                     ("o_r", "y.c", day(9), "worse();", sha[3], "+")], "repo string, file string, ts timestamp, text string, sha string, sign string")

    def model(prompts):
        return [reply.format("y.c", 3) if "moved.c" in p else "no idea" for p in prompts]
    # 1: line 2 of its own state (not of the newest one); 2: corrected to y.c; 3: no commit before; 4: the patch's path; 5: line of day 5
    want = {("CVE-2024-0001", "x.c", (2,), sha[1]), ("CVE-2024-0002", "y.c", (3,), sha[3]), ("CVE-2024-0004", "x.c", (1,), sha[3]), ("CVE-2024-0005", "x.c", (4,), sha[2])}

    def got(**more):
        out = flows.patch_to_snippets(patches, replies, snaps, history, cves, commits, **more)
        return {(r.cve_id, r.file_path, tuple(r.line_numbers), r.introducing_commit) for r in out.collect()}
    assert got(model=model) == want
    table = spark.createDataFrame([("CVE-2024-0002", "moved.c", "y.c", [3], "ok"), ("CVE-2024-0004", "gone.c", None, None, "bad_json")],
                                  "cve_id string, file_path string, c_path string, c_lines array<int>, c_status string")
    assert got(corrections=table) == want
    wrong = table.withColumn("c_path", F.lit("nowhere.c"))
    assert got(corrections=wrong) == {w for w in want if w[0] != "CVE-2024-0002"}  # a correction that the state lacks ends with no file
    assert {g[0] for g in got()} == {"CVE-2024-0001", "CVE-2024-0004", "CVE-2024-0005"}


def test_collect_and_enrich_takes_full_features(spark):
    """3.1 on the library's own P32 / P33 output: context and details are their structs."""
    from vulnlake.operators.features_repo import commit_features, repo_features
    raw = rg._raw_cve(spark, SF)
    cve = dv.dv_cve(spark, SF).select("cve_key", "repository", F.md5(F.col("cve_key").cast("string")).alias("sha"))
    ref = F.array(F.struct(F.concat(F.lit("https://github.com/"), F.col("repository"), F.lit("/commit/"), F.col("sha")).alias("url"),
                           F.lit("nvd").alias("source"), F.array(F.lit("Patch")).alias("tags")))
    raw = raw.join(cve, "cve_key").withColumn("cve", F.col("cve").withField("references", ref))
    path = scratch_dir(spark, "flow-full")
    raw.groupBy((F.col("cve_key") / 500).cast("bigint").alias("startIndex")) \
       .agg(F.array_sort(F.collect_list(F.struct("cve_key", "cve"))).alias("v")) \
       .select("startIndex", F.transform("v", lambda x: F.struct(x["cve"].alias("cve"))).alias("vulnerabilities")).write.json(path)
    repos = repo_features(dv.dv_repo_payload(spark, SF), dv.dv_policy_payload(spark, SF), dv.dv_branch_payload(spark, SF),
                          dv.dv_language_payload(spark, SF), dv.dv_activity_payload(spark, SF))
    out = flows.collect_and_enrich(spark, path, None, repos, commit_features(dv.dv_commit_payload(spark, SF)))
    n = dv.dv_cve(spark, SF).count()
    assert out.count() == n
    assert out.where("repository_context.default_branch is not null").count() == n
    found = dv.dv_commit_payload(spark, SF).count()
    assert out.where("fix_commit_details.commit_date = fix_date and size(fix_commit_details.files) > 0").count() == found


def test_features_without_optional_payloads(spark):
    from vulnlake.operators.features_repo import commit_features, repo_features
    r = repo_features(dv.dv_repo_payload(spark, SF)).first()
    assert r["protected_branches"] == [] and r["languages"] is None and r["commit_activity"]["avg_commits_per_week"] == 0
    assert not r["has_security_policy"] and not r["security_features"]["has_protected_branches"]
    c = commit_features(dv.dv_commit_payload(spark, SF))
    assert c.where("surrounding_commits != array()").count() == 0 and c.count() == dv.dv_commit_payload(spark, SF).count()
    assert c.where("author.login is null").count() > 0
