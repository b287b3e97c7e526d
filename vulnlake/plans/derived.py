"""Derived views: the driver's TPC-H-like tables reshaped into the tables the
library works on (CVE, repository, commit, changed file, reference, patch,
snapshot, model reply, state).  Definitions follow FIXTURES.md section 3.

Every view is a lazy DataFrame over the parquet scan, so filters and column
pruning of a query that uses it reach the scan.  Nothing is cached here: a
query decides itself what it reuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _repo_name(key: Column) -> Column:
    return F.concat(F.lit("org"), (key % 97).cast("string"), F.lit("/repo"), key.cast("string"))


def dv_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per CVE (one order); fix date from the first returned line item."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    # Aggregate line items *before* the join: (orderkey, linenumber) is not unique.
    fix = (table(spark, sf_dir, "lineitem")
           .filter((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1))
           .groupBy("l_orderkey")
           .agg(F.min("l_shipdate").alias("fix_date")))
    k = F.col("o_orderkey")
    score = (F.when(k % 11 == 0, F.lit(None).cast("double"))
             .when(k % 53 == 0, F.lit(0.0))
             .otherwise(F.floor(F.col("o_totalprice") / 5000) / F.lit(10.0)))
    return (o.join(fix, o.o_orderkey == fix.l_orderkey, "left")
            .select(
                F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"),
                         F.format_string("%07d", k)).alias("cve_id"),
                k.alias("cve_key"),
                _repo_name(F.col("o_custkey")).alias("repository"),
                F.col("o_orderdate").alias("published_date"),
                score.alias("cvss_score"),
                F.when(F.col("o_custkey") % 7 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("CWE-"), (F.col("o_custkey") % 40).cast("string"))).alias("cwe_id"),
                F.col("o_orderpriority").alias("attack_vector"),
                F.col("o_orderstatus").alias("attack_complexity"),
                F.col("fix_date"),
                F.col("fix_date").isNotNull().alias("has_commit"),
            ))


def dv_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        _repo_name(F.col("c_custkey")).alias("repository"),
        F.floor(F.abs(F.col("c_acctbal")) / 10).cast("bigint").alias("size"),
        F.concat(F.lit("org"), (F.col("c_custkey") % 97).cast("string")).alias("owner"),
        F.col("c_custkey"),
        F.col("c_mktsegment").alias("license"),
    )


def dv_event_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("repo"), F.col("user_id").cast("string")).alias("repository"),
        F.md5(F.col("event_id").cast("string")).alias("sha"),
        F.col("ts").alias("commit_ts"),
        F.col("event_type").alias("author"),
        F.col("value").alias("n"),
        F.col("event_id"),
        F.col("event_type"),
    )


# The last path component chosen by p_size % 8 (FIXTURES.md section 3).
FILE_LEAVES = ["auth_util.py", "config.yml", "package.json", "test_main.c",
               "Gemfile", "README", "crypto.h", "main.go"]


def dv_commit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    leaf = F.element_at(F.array(*[F.lit(x) for x in FILE_LEAVES]), (F.col("p_size") % 8 + 1).cast("int"))
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(
                F.md5(F.col("l_orderkey").cast("string")).alias("sha"),
                F.col("l_orderkey"),
                F.col("l_linenumber"),
                F.concat(F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")),
                         F.lit("/"), leaf).alias("filename"),
                F.col("l_quantity").alias("additions"),
                F.col("l_shipdate").alias("commit_date"),
                F.element_at(F.array(*[F.lit(x) for x in FILE_STATUSES]), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("status"),
                (F.col("p_partkey") % 13).alias("deletions"),
                F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("@@ -1 +1 @@ "), F.col("p_name"))).alias("patch"),
            ))


# File statuses chosen by l_linenumber % 3.
FILE_STATUSES = ["added", "modified", "removed"]


def _owner(key: Column) -> Column:
    return F.concat(F.lit("org"), (key % 97).cast("string"))


def _repo(key: Column) -> Column:
    return F.concat(F.lit("repo"), key.cast("string"))


def dv_repo_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository payloads, one per customer; flags and license absent for some."""
    k = F.col("c_custkey")

    def day(n: Column) -> Column:
        return F.concat(F.date_add(F.lit("2015-01-01").cast("date"), n.cast("int")).cast("string"), F.lit("T00:00:00Z"))
    return table(spark, sf_dir, "customer").select(
        _owner(k).alias("owner"), _repo(k).alias("repo"), _repo(k).alias("name"),
        day(k % 1000).alias("created_at"), day(k % 1000 + 30).alias("updated_at"), day(k % 1000 + 60).alias("pushed_at"),
        F.floor(F.abs(F.col("c_acctbal")) / 10).cast("bigint").alias("size"),
        (k * 7 % 1000).alias("stargazers_count"), (k * 3 % 200).alias("forks_count"),
        (k % 50).alias("open_issues_count"), (k * 11 % 1000).alias("watchers_count"),
        F.when(k % 3 == 0, "master").when(k % 3 == 1, "main").otherwise("develop").alias("default_branch"),
        F.when(k % 3 != 0, k % 2 == 0).alias("has_wiki"), F.when(k % 5 != 0, k % 2 == 1).alias("has_issues"),
        F.when(k % 4 != 0, k % 3 == 0).alias("allow_forking"), F.when(k % 6 == 0, k % 4 == 0).alias("is_template"),
        F.when(k % 7 != 0, F.struct(F.lower("c_mktsegment").alias("key"))).alias("license"))


def dv_policy_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security policies of every second customer's repository, every third of them empty."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 2 == 0).select(
        _owner(k).alias("owner"), _repo(k).alias("repo"),
        F.when(k % 6 == 0, F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("name"), F.col("c_name"))).alias("policy"))


def dv_branch_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, one per order; ``protected`` absent for some."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        _owner(k).alias("owner"), _repo(k).alias("repo"), F.concat(F.lit("b"), o.cast("string")).alias("name"),
        F.when(o % 5 != 0, F.col("o_orderstatus") == "F").alias("protected"))


def dv_language_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by language, absent for every fourth customer's repository."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 4 != 0).select(
        _owner(k).alias("owner"), _repo(k).alias("repo"),
        F.create_map(F.lit("C"), k * 13 % 5000, F.lit("Python"), k * 17 % 7000).alias("languages"))


def dv_activity_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly activity (Monday to Sunday) from the events of each user's repository."""
    k = F.col("user_id")
    return (table(spark, sf_dir, "events").groupBy(k, F.date_trunc("week", "ts").alias("w"))
            .agg(F.count(F.lit(1)).alias("total"), F.array(*[F.count_if(F.weekday("ts") == d) for d in range(7)]).alias("days"))
            .select(_owner(k).alias("owner"), _repo(k).alias("repo"), "total", "days"))


def dv_commit_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit payloads, one per order that has line items; the author absent for some."""
    f = dv_commit_file(spark, sf_dir)
    files = f.groupBy("l_orderkey").agg(
        F.collect_list(F.struct("filename", "status", F.col("additions").cast("bigint").alias("additions"), "deletions", "patch")).alias("files"),
        F.sum(F.col("additions").cast("bigint")).alias("a"), F.sum("deletions").alias("d"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    k, key = F.col("o_custkey"), F.col("o_orderkey")
    message = (F.when(key % 3 == 0, F.concat(F.lit("Fixes #"), key.cast("string")))
               .when(key % 3 == 1, F.concat(F.col("o_orderpriority"), F.lit("\n\nDetails of "), key.cast("string")))
               .otherwise(F.concat(F.lit("Update "), F.col("o_orderstatus"))))
    return files.join(o, F.col("l_orderkey") == key).select(
        _owner(k).alias("owner"), _repo(k).alias("repo"), F.md5(key.cast("string")).alias("sha"),
        F.struct(message.alias("message"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")).alias("author")).alias("commit"),
        F.when(k % 10 != 0, F.struct(F.concat(F.lit("user"), (k % 200).cast("string")).alias("login"),
                                     F.when(k % 9 == 0, "Bot").otherwise("User").alias("type"))).alias("author"),
        F.struct(F.col("a").alias("additions"), F.col("d").alias("deletions"), (F.col("a") + F.col("d")).alias("total")).alias("stats"),
        "files")


# Reference tags chosen by page_id % 3.
REF_TAGS = [["Patch"], ["Exploit", "Third Party Advisory"], []]


def dv_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    gh = F.concat(F.lit("https://github.com/org"), (pid % 9).cast("string"), F.lit("/repo"),
                  (pid % 17).cast("string"), F.lit("/commit/"), F.md5(pid.cast("string")))
    url = (F.when(pid % 4 == 0, gh)
           .when(pid % 4 == 1, F.concat(gh, F.lit(".patch")))
           .when(pid % 4 == 2, F.concat(F.lit("https://github.com/org"), (pid % 9).cast("string")))
           .otherwise(F.col("url")))
    tags = (F.when(pid % 3 == 0, F.array(F.lit("Patch")))
            .when(pid % 3 == 1, F.array(F.lit("Exploit"), F.lit("Third Party Advisory")))
            .otherwise(F.array().cast("array<string>")))
    return pg.select(
        F.floor(pid / 5).cast("bigint").alias("cve_key"),
        (pid % 5).cast("bigint").alias("pos"),
        pid.alias("page_id"),
        url.alias("url"),
        F.lit("nvd@nist.gov").alias("source"),
        tags.alias("tags"),
    )


def dv_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("user_id"), F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("a"),
                 F.sum(F.col("value") * 0.5).alias("d")))


def dv_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unified diff per document: header, one hunk, line i signed by i % 3."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lines = F.split(F.col("text"), "\n")
    signed = F.transform(lines, lambda s, i: F.concat(
        F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), (i % 3 + 1).cast("int")), s))
    n = F.size(lines)
    # i % 3 == 0 context, 1 removed, 2 added; old side = context + removed
    n_old = n - F.floor(n / 3).cast("int")
    n_new = n - F.floor((n + 1) / 3).cast("int")
    path = F.concat(F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.concat_ws("\n",
                       F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path),
                       F.format_string("@@ -1,%d +1,%d @@", n_old, n_new),
                       F.array_join(signed, "\n"))
    cve = F.concat(F.lit("CVE-2024-"), F.format_string("%07d", F.col("doc_id")))
    return d.select(
        F.col("doc_id"),
        F.concat(cve, F.lit("_org"), (F.col("doc_id") % 7).cast("string"), F.lit("_"),
                 F.col("source"), F.lit(".patch")).alias("file_name"),
        F.concat(F.lit("org"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("source")).alias("repository"),
        path.alias("path"),
        F.concat(text, F.lit("\n")).alias("text"),
    )


def dv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select(
        F.col("doc_id"),
        F.col("source").alias("repo_name"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


FENCE = "```"


def dv_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: document text followed by one of seven fenced bodies (doc_id % 7)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 7
    good = F.concat(F.lit('[{"file_path": "f'), F.col("doc_id").cast("string"),
                    F.lit('.txt", "line_numbers": [3]}]'))
    body = (F.when(k == 1, F.lit(""))
            .when(k == 2, F.lit("{bad"))
            .when(k == 3, F.lit('{"a": 1}'))
            .when(k == 4, F.lit("[1]"))
            .when(k == 5, F.lit("[]"))
            .otherwise(good))
    reply = F.when(k == 0, F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit("\n" + FENCE + "json\n"), body, F.lit("\n" + FENCE + "\n")))
    return d.select("doc_id", reply.alias("reply"))


# State statuses chosen by c_custkey % 4 (FIXTURES.md section 2, J05/A37).
STATE_STATUSES = ["success", "failed: x", "started", "failed"]


def dv_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dv_repo(spark, sf_dir)
    st = F.element_at(F.array(*[F.lit(s) for s in STATE_STATUSES]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return r.select(F.col("repository").alias("key"), st.alias("status"), F.col("c_custkey"))


def dv_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def dv_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lb = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lb, "doc_id", "left").select(
        "doc_id", F.col("text").alias("description"), "lang", "source", "quality", "toxic")
