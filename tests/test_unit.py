"""Unit tests on small literal rows: FIXTURES.md section 2, worked out by hand
from the reference's code, and the semantics ledger (L1-L16)."""

import datetime as dt

from pyspark.sql import functions as F

from vulnlake.functions import cve as fc
from vulnlake.functions import features as ff
from vulnlake.functions import text as ft
from vulnlake.functions import urls as fu
from vulnlake.operators import asof, filters, findings, intent, joins, patches, repos, state, windows


def col1(df):
    return [r[0] for r in df.collect()]


def test_github_summary_order(spark):
    urls = ["https://github.com/a/b/commit/111", "https://example.org/x", "https://github.com/c/d/issues/5",
            "https://github.com/c/d/commit/222.patch"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos int, url string").withColumn("k", F.lit(1))
    r = joins.github_summary_long(df, "k").collect()[0]
    assert r.repository == "c/d" and r.fix_commit == "111"
    assert r.related_commits == "111,222.patch" and r.patch_url == urls[3]
    arr = spark.createDataFrame([(urls,)], "u array<string>").select(
        fc.github_summary(F.transform("u", lambda x: F.struct(x.alias("url")))).alias("s")).collect()[0].s
    assert arr.repository == "c/d" and arr.fix_commit == "111" and arr.related_commits == ["111", "222.patch"]


def test_repo_from_url_edges(spark):
    df = spark.createDataFrame([("https://github.com/foo",), ("https://github.com/foo/",),
                                ("https://github.com/advisories/GHSA-1",), ("https://example.com/?u=github.com/z/y",)], "u string")
    out = df.select(fu.is_github("u").alias("g"), fu.github_repo("u").alias("r")).collect()
    assert [r.r for r in out] == [None, "foo/", "advisories/GHSA-1", None]
    assert out[3].g is True


def test_empty_commit(spark):
    df = spark.createDataFrame([("https://github.com/a/b/commit/",)], "u string")
    assert col1(df.select(fu.github_commit("u"))) == [""]


def test_owner_repo_and_dirs(spark):
    df = spark.createDataFrame([("a/b",), ("a/b/c",), ("a",)], "r string")
    assert [x.o for x in df.select(fu.owner_repo("r").alias("o")).collect()][0].owner == "a"
    assert [x.o for x in df.select(fu.owner_repo("r").alias("o")).collect()][1:] == [None, None]
    d = spark.createDataFrame([("a_my_repo",)], "d string")
    assert col1(d.select(fu.repo_from_dir("d"))) == ["a/my/repo"]
    p = spark.createDataFrame([("CVE-2020-1_a_my_repo.patch",)], "n string").select(fu.parse_patch_name("n").alias("p"))
    r = p.collect()[0].p
    assert (r.cve_id, r.repo) == ("CVE-2020-1", "a_my_repo")


def test_url_file_name(spark):
    df = spark.createDataFrame([("https://h.org/a/b?q=1",), ("https://h.org/a/b?q=2",), ("https://h.org/",)], "u string")
    assert col1(df.select(fu.url_file_name("u"))) == ["h.org_a_b.txt", "h.org_a_b.txt", "h.org_.txt"]


def test_html_text():
    assert intent.html_to_text("<p>Hi <b>x</b></p><script>1</script><!--c-->") == "Hi x"


def test_first_cwe(spark):
    t = "array<struct<description:array<struct<value:string>>>>"
    df = spark.createDataFrame([([([("NVD-CWE-noinfo",), ("CWE-79",)],), ([("CWE-20",)],)],),
                                ([([("NVD-CWE-Other",)],), ([("CWE-20",)],)],)], f"w {t}")
    assert col1(df.select(fc.first_cwe("w"))) == ["CWE-79", None]


def test_severity_and_policies(spark):
    df = spark.createDataFrame([(s,) for s in [9.0, 8.9, 7.0, 6.9, 4.0, 3.9, 0.0, None]], "s double")
    assert col1(df.select(fc.severity("s", "Unknown"))) == ["Critical", "High", "High", "Medium", "Medium", "Low", "Low", "Unknown"]
    sc = spark.createDataFrame([(9.8,), (None,), (0.0,), (5.0,)], "cvss_score double").withColumn("repository", F.lit("r"))
    assert round(filters.scored(sc, "truthy").agg(F.avg("cvss_score")).first()[0], 6) == 7.4
    assert round(filters.scored(sc, "not_null").agg(F.avg("cvss_score")).first()[0], 6) == 4.933333
    assert round(filters.scored(sc, "zero").agg(F.avg("cvss_score")).first()[0], 6) == 3.7
    from vulnlake.operators.severity import overview
    assert round(overview(sc).first().avg_cvss_score, 6) == 3.7


def test_working_hours(spark):
    ts = ["2024-01-05 17:59:00", "2024-01-05 18:00:00", "2024-01-06 10:00:00", "2024-01-08 09:00:00", "2024-01-08 08:59:00"]
    df = spark.createDataFrame([(t,) for t in ts], "t string").select(F.to_timestamp("t").alias("t"))
    assert col1(df.select(fc.is_working_hours("t"))) == [True, False, False, True, False]


def test_message_features(spark):
    df = spark.createDataFrame([("Prefix change\n\nbody",), ("Update docs",), ("Update docs\n",)], "m string")
    out = [r.f for r in df.select(ff.message_features("m").alias("f")).collect()]
    assert [(o.title, o.length, o.has_description, o.references_issue) for o in out] == [
        ("Prefix change", 19, True, True), ("Update docs", 11, False, False), ("Update docs", 12, True, False)]


def test_file_patterns(spark):
    files = ["src/auth/Login.java", "package.json", "README", "tests/config.yml"]
    df = spark.createDataFrame([(files,)], "f array<string>").select(ff.file_pattern_counts("f").alias("p"))
    p = df.collect()[0].p
    assert (p.security_files, p.config_files, p.dependency_files, p.test_files) == (1, 2, 1, 1)
    assert (p.unique_directories, p.max_directory_depth) == (3, 2)
    long = spark.createDataFrame([("s", f) for f in files], "sha string, filename string")
    from vulnlake.operators.features import file_pattern_counts_long
    r = file_pattern_counts_long(long).collect()[0]
    assert (r.security_files, r.config_files, r.dependency_files, r.test_files, r.unique_directories,
            r.max_directory_depth) == (1, 2, 1, 1, 3, 2)
    m = spark.createDataFrame([(["docs/monkey.md"],)], "f array<string>").select(ff.file_pattern_counts("f").alias("p"))
    assert m.collect()[0].p.security_files == 1


def test_author_stats_and_activity(spark):
    df = spark.createDataFrame([([(2, 10, 1), (0, 0, 0), (1, 3, 4)],)], "w array<struct<c:int,a:int,d:int>>")
    a = df.select(ff.author_stats("w").alias("a")).collect()[0].a
    assert (a.total_commits, a.average_weekly_commits, a.total_additions, a.total_deletions, a.weeks_active) == (3, 1.0, 13, 5, 2)
    w = spark.createDataFrame([([(3, [1, 0, 2, 0, 0, 0, 0]), (0, [0] * 7)],)], "w array<struct<total:int,days:array<int>>>")
    c = w.select(ff.commit_activity("w").alias("c")).collect()[0].c
    assert (c.total_commits_last_year, round(c.avg_commits_per_week, 6), c.days_active_last_year) == (3, 0.057692, 2)


def test_ordinal_day(spark):
    df = spark.createDataFrame([("1970-01-01",), ("2020-01-01",)], "d string").select(F.to_date("d").alias("d"))
    assert col1(df.select(fc.ordinal_day("d"))) == [719163, 737425]


def test_patch_paths(spark):
    text = "--- a/src/x.c\n+++ b/src/x.c\n--- /dev/null\n+++ b/new file.txt\n"
    df = spark.createDataFrame([("p", text)], "file_name string, text string")
    assert sorted(r.path for r in patches.patch_paths(df).collect()) == ["new file.txt", "src/x.c"]
    assert sorted(r.path for r in patches.patch_paths(df, parity=True).collect()) == ["a/src/x.c", "b/new", "b/src/x.c"]


def test_patch_lines_header_lookalike(spark):
    text = "--- a/f.c\n+++ b/f.c\n@@ -3,3 +3,3 @@\n ctx\n--- x\n+++ y\n ctx2\n--- a/g.c\n+++ b/g.c\n@@ -1 +1 @@\n-a\n+b\n"
    df = spark.createDataFrame([("p", text)], "file_name string, text string")
    rows = patches.patch_lines(df).orderBy("pos").collect()
    assert [(r.path, r.sign, r.old_no, r.new_no, r.text) for r in rows] == [
        ("f.c", " ", 3, 3, "ctx"), ("f.c", "-", 4, None, "-- x"), ("f.c", "+", None, 4, "++ y"),
        ("f.c", " ", 5, 5, "ctx2"), ("g.c", "-", 1, None, "a"), ("g.c", "+", None, 1, "b")]


def test_parse_findings_statuses(spark):
    f = "```"
    replies = ["no fence", f"{f}json\n{f}", f"{f}json\n{{bad\n{f}", f'{f}json\n{{"a":1}}\n{f}', f"{f}json\n[1]\n{f}",
               f"{f}json\n[]\n{f}", f'{f}json\n[{{"file_path":"a.c","line_numbers":[3]}}]\n{f}']
    df = spark.createDataFrame([(r,) for r in replies], "r string").select(findings.parse_findings(F.col("r")).alias("p"))
    out = df.collect()
    assert [o.p.status for o in out] == ["no_markers", "empty", "bad_json", "not_list", "item_not_dict", "ok", "ok"]
    assert out[5].p["items"] == [] and out[6].p["items"][0].file_path == "a.c"


def test_parse_intent(spark):
    df = spark.createDataFrame([('{"malicious_intent_likely": true, "reason": "r"}',), ("oops",)], "r string")
    out = [x.p for x in df.select(intent.parse_intent(F.col("r")).alias("p")).collect()]
    assert (out[0].malicious_intent_likely, out[0].reason) == (True, "r")
    assert out[1].malicious_intent_likely is False and out[1].reason.startswith("Could not parse") and out[1].reason.endswith("oops")


def test_blame_and_codes(spark):
    h = "a" * 40
    df = spark.createDataFrame([(f"{h} 1 1 1",), ("fatal: x",)], "b string")
    assert col1(df.select(ft.parse_blame("b"))) == [h, "parse_error"]
    assert col1(df.select(ft.is_valid_commit(ft.parse_blame("b")))) == [True, False]


def _cut_model(content, lines, before=2, after=3):
    ls = content.splitlines()
    s, e = max(0, min(lines) - 1 - before), min(len(ls), max(lines) + after)
    out = [("VULN> " if i + 1 in lines else "      ") + f"{i + 1:4d}: {ls[i]}" for i in range(s, e)]
    return "\n".join(out) or None


def test_cut_snippet_against_model(spark):
    content = "\n".join(f"l{i}" for i in range(1, 11))
    cases = [[4, 5], [1], [20], [10], [2, 9]]
    df = spark.createDataFrame([(content, c) for c in cases], "c string, l array<int>")
    got = col1(df.select(ft.cut_snippet("c", "l")))
    assert got == [_cut_model(content, c) for c in cases]
    assert got[0].split("\n")[2] == "VULN>    4: l4" and got[0].split("\n")[0] == "         2: l2"


def test_state_pending_and_summary(spark):
    st = spark.createDataFrame([("a/b", "success"), ("c/d", "failed: x"), ("e/f", "started"), ("g/h", "failed")],
                               "key string, status string")
    work = st.select(F.col("key").alias("cve_id"))
    assert sorted(col1(joins.pending(work, st))) == ["c/d", "e/f"]
    s = state.state_summary(st).collect()[0]
    assert (s.success, s.failed) == (1, 3)


def test_asof_commit_before(spark):
    commits = spark.createDataFrame([("r", "s1", "2024-01-01 10:00:00"), ("r", "s2", "2024-01-01 12:00:00")],
                                    "repository string, sha string, t string").select(
        "repository", "sha", F.to_timestamp("t").alias("commit_ts"))
    cves = spark.createDataFrame([(1, "r", "2024-01-01 12:00:00"), (2, "r", "2024-01-01 11:59:00"), (3, "r", "2024-01-01 09:00:00"),
                                  (4, "r", "2024-03-01 09:00:00")],
                                 "id int, repository string, t string").select("id", "repository", F.to_timestamp("t").alias("published"))
    out = {r.id: r.commit_before for r in asof.commit_before(cves, commits, branch=None).collect()}
    assert out == {1: "s2", 2: "s1", 3: None, 4: "s2"}  # 4: carried from an earlier bucket


def test_introducing_commits(spark):
    added = spark.createDataFrame([("r", "f", "2024-01-01 00:00:00", "int x = 1;", "c1"),
                                   ("r", "f", "2024-01-02 00:00:00", "int x = 1;", "c2"),
                                   ("r", "f", "2024-01-05 00:00:00", "int x = 1;", "c3")],
                                  "repo string, file string, t string, text string, sha string").withColumn("ts", F.to_timestamp("t")).drop("t")
    removed = spark.createDataFrame([(1, "r", "f", "2024-01-03 00:00:00", "int x = 1;"), (2, "r", "f", "2024-01-03 00:00:00", "}"),
                                     (3, "r", "f", "2024-01-01 00:00:00", "int x = 1;")],
                                    "id int, repo string, file string, t string, text string").withColumn("ts", F.to_timestamp("t")).drop("t")
    out = {r.id: r.introducing_commit for r in asof.introducing_commits(removed, added).collect()}
    assert out == {1: "c2", 2: "blame_error", 3: "blame_error"}  # 2: no earlier line of that text


def test_resolve_path_fallback(spark):
    fnd = spark.createDataFrame([("C1", "r", "missing.c", [3])], "cve_id string, repo_name string, file_path string, line_numbers array<int>")
    corr = spark.createDataFrame([], "cve_id string, file_path string, c_path string, c_lines array<int>, c_status string")
    pp = spark.createDataFrame([("C1", "other.c", 5), ("C1", "x.c", 9)], "cve_id string, path string, first_pos int")
    snap = spark.createDataFrame([("r", "x.c"), ("r", "other.c")], "repo_name string, path string")
    r = findings.resolve_path(fnd, corr, pp, snap).collect()[0]
    assert (r.resolved_path, r.resolved_by) == ("other.c", "patch")


def test_size_metrics_ext(spark):
    df = spark.createDataFrame([(100, 5.0), (100, 7.0), (200, None)], "size bigint, cvss_score double")
    out = {r.repo_size: r for r in repos.size_metrics_ext(df).collect()}
    assert (out[100].vulnerabilities, out[100].avg_cvss, round(out[100].std_cvss, 6), out[100].vuln_density) == (2, 6.0, 1.414214, 0.02)
    assert (out[200].vulnerabilities, out[200].avg_cvss, out[200].std_cvss, out[200].vuln_density) == (1, 0.0, None, 0.005)


def test_regression_rows(spark):
    from vulnlake.operators.coverage import time_regression
    cov = spark.createDataFrame([("2020-01-01", 4, 2), ("2020-02-01", 4, 0), ("2020-03-01", 4, 4)], "b string, n_all int, n_with int") \
        .select(F.to_date("b").alias("bucket"), "n_all", "n_with", (F.col("n_with") * 100.0 / F.col("n_all")).alias("pct"))
    assert round(time_regression(cov, "n_with").first().slope, 6) == round(2 / 60, 6)
    assert round(time_regression(cov, "pct").first().slope, 6) == 0.805257


def test_first_last_per_key(spark):
    df = spark.createDataFrame([("c", "a/util.c", 1), ("c", "b/util.c", 2)], "cve string, path string, seq int") \
        .withColumn("base", ft.basename("path"))
    assert windows.last_per_key(df, ["cve", "base"], ["seq"]).first().path == "b/util.c"
    assert windows.first_per_key(df, ["cve", "base"], ["seq"]).first().path == "a/util.c"


def test_enhance_keeps_row(spark):
    c = spark.createDataFrame([("C1", "a/b", "s")], "cve_id string, repository string, fix_commit string") \
        .withColumn("repository_context", F.lit(None).cast("struct<size:bigint>")) \
        .withColumn("fix_commit_details", F.lit(None).cast("struct<n:bigint>"))
    repos_ = spark.createDataFrame([], "repository string, size bigint")
    commits = spark.createDataFrame([], "repository string, sha string, n bigint")
    r = joins.enhance(c, repos_, commits).collect()
    assert len(r) == 1 and r[0].processing_status == "enhanced"


def test_text_lines_like_readlines(spark):
    cases = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc", "x\n\ny\n"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    import io
    expect = [[ln.rstrip("\n") for ln in io.StringIO(c, newline=None).readlines()] for c in cases]
    assert [list(r[0]) for r in df.select(ft.text_lines("c")).collect()] == expect


def test_deciles_with_heavy_ties(spark):
    # 70% of the rows share one size: equal edges keep the lower label, nothing raises
    sizes = [100] * 70 + [10 ** (1 + i / 10) for i in range(30)]
    df = spark.createDataFrame([(int(s), 1) for s in sizes], "repo_size bigint, vulnerabilities bigint")
    out = repos.size_decile(df).groupBy("decile").count().collect()
    got = {r.decile: r["count"] for r in out}
    assert sum(got.values()) == 100
    assert all(k in [f"Q{i}" for i in range(1, 11)] for k in got)
    ties = repos.size_decile(df).filter(F.col("repo_size") == 100).select("decile").distinct().collect()
    assert len(ties) == 1  # equal values share one label


def test_patch_grammar(spark):
    text = ("From abc Mon Sep 17 00:00:00 2001\nSubject: fix\n\n"
            "diff --git a/old.c b/old.c\ndeleted file mode 100644\n--- a/old.c\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
            "diff --git a/n.c b/n.c\n--- a/n.c\n+++ b/n.c\n@@ -5,2 +5,2 @@\n keep\n-x\n\\ No newline at end of file\n+y\n")
    df = spark.createDataFrame([("p", text)], "file_name string, text string")
    rows = [(r.path, r.sign, r.old_no, r.new_no, r.text) for r in patches.patch_lines(df).orderBy("pos").collect()]
    assert rows == [("old.c", "-", 1, None, "gone"), ("n.c", " ", 5, 5, "keep"), ("n.c", "-", 6, None, "x"),
                    ("n.c", "+", None, 6, "y")]


def test_percent_of_zero_rows_is_null(spark):
    from vulnlake.operators.timing import timing_coverage
    empty = spark.createDataFrame([], "has_commit boolean")
    r = timing_coverage(empty).collect()[0]
    assert (r.total, r.with_date, r.pct) == (0, 0, None)


def test_density_and_log_of_zero(spark):
    df = spark.createDataFrame([(0, 3)], "s bigint, n bigint")
    r = df.select(ff.vuln_density("n", "s").alias("d"), ff.log10_col("s").alias("l")).collect()[0]
    assert r.d is None and r.l is None


def test_introducing_commits_prefilter_same_result(spark):
    rows = [(1, 0, "r", "f", "2024-01-01 00:00:00", "int x = 1;", "c1", "+"),
            (2, 0, "r", "f", "2024-01-03 00:00:00", "int x = 1;", "c2", "-"),
            (2, 1, "r", "f", "2024-01-03 00:00:00", "never added", "c2", "-"),
            (2, 2, "r", "f", "2024-01-03 00:00:00", "}", "c2", "-"),
            (3, 0, "r", "g", "2024-01-04 00:00:00", "int x = 1;", "c3", "-")]
    ln = spark.createDataFrame(rows, "doc_id int, pos int, repo string, file string, t string, text string, sha string, sign string") \
        .withColumn("ts", F.to_timestamp("t")).drop("t")
    pay = ["doc_id", "pos", "repo", "file", "ts", "text"]
    a = {(r.doc_id, r.pos): r.introducing_commit
         for r in asof.introducing_commits_from_lines(ln, pay, materialize=False).collect()}
    b = {(r.doc_id, r.pos): r.introducing_commit
         for r in asof.introducing_commits_from_lines(ln, pay, materialize=False, prefilter=True).collect()}
    assert a == b == {(2, 0): "c1", (2, 1): "blame_error", (2, 2): "blame_error", (3, 0): "blame_error"}
