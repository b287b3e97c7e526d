"""Model replies about vulnerable lines, and path resolution
(SURVEY X05, X06, X08, X09, J13).  Replies are parsed with Spark's VARIANT
(``try_parse_json``), so bad JSON is a status, never an exception."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.text import fenced_json, let
from vulnlake.functions.urls import safe_name
from vulnlake.session import scratch_dir

STATUSES = ["no_markers", "empty", "bad_json", "not_list", "item_not_dict", "ok"]


def parse_findings(text: Column) -> Column:
    """``struct(status, items array<struct<file_path, line_numbers>>)``; one bad item
    rejects the whole list."""
    def from_items(fj, v, kind, items):
        all_obj = F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
        status = (F.when(fj["status"] != "ok", fj["status"])
                  .when(v.isNull(), F.lit("bad_json"))
                  .when(~kind.startswith("ARRAY"), F.lit("not_list"))
                  .when(~all_obj, F.lit("item_not_dict"))
                  .otherwise(F.lit("ok")))
        parsed = F.transform(items, lambda x: F.struct(
            F.try_variant_get(x, "$.file_path", "string").alias("file_path"),
            F.try_variant_get(x, "$.line_numbers", "array<int>").alias("line_numbers")))
        return let(status, lambda st: F.struct(st.alias("status"), F.when(st == "ok", parsed).alias("items"), fj["body"].alias("body")))
    return let(fenced_json(text), lambda fj: let(F.try_parse_json(fj["body"]), lambda v: let(F.schema_of_variant(v), lambda kind: let(
        F.when(kind.startswith("ARRAY"), v.cast("array<variant>")), lambda items: from_items(fj, v, kind, items)))))


def correction_prompt(cve_id: Column, status: Column, body: Column) -> Column:
    """Follow-up request after a failed parse: a syntax hint for bad JSON, a
    structure hint otherwise, plus the rejected text; null when the parse was ok."""
    hint = (F.when(status == "bad_json", F.lit("The JSON syntax is invalid; return well-formed JSON. "))
            .otherwise(F.lit("The JSON structure is wrong; return a list of objects with "
                             "'file_path' and 'line_numbers'. ")))
    return F.when(status != "ok", F.concat(
        F.lit("The reply for "), cve_id, F.lit(" could not be used ("), status, F.lit("). "), hint,
        F.when(body.isNotNull() & (body != ""), F.concat(F.lit("Rejected text: `"), body, F.lit("`. "))).otherwise(F.lit("")),
        F.lit("Answer again with the JSON alone inside ```json and ``` markers.")))


def finding_prompt(cve_id: Column, repo: Column) -> Column:
    """The request naming the CVE and repository (P12-safe names)."""
    return F.concat(F.lit("Identify the vulnerable lines fixed for "), safe_name(cve_id, ""),
                    F.lit(" in repository "), safe_name(repo),
                    F.lit(". Answer with a JSON list of {\"file_path\", \"line_numbers\"} inside ```json and ```."))


def path_prompt(cve_id: Column, repo: Column, path: Column) -> Column:
    """Ask for a corrected path when the proposed one is not in the snapshot."""
    return F.concat(F.lit("The file "), path, F.lit(" was not found in "), safe_name(repo),
                    F.lit(" for "), safe_name(cve_id, ""),
                    F.lit(". Give the correct path and line numbers as JSON inside ```json and ```."))


def resolve_path(findings: DataFrame, corrections: DataFrame, patch_paths: DataFrame, snapshot: DataFrame,
                 key: str = "cve_id", repo: str = "repo_name") -> DataFrame:
    """Choose the file a finding refers to.

    1. the model's path, when the snapshot has it;
    2. else a correction: its path (and lines) when complete and in the snapshot; an
       incomplete correction, or one whose path is absent, ends with no file;
    3. no correction, bad JSON or an empty list: the first patch path (by position) the
       snapshot has, with the model's lines;
    4. else no file.
    ``findings``: (key, repo, file_path, line_numbers); ``corrections``: (key, file_path,
    c_path, c_lines, c_status); ``patch_paths``: (key, path, first_pos); ``snapshot``: (repo, path).
    """
    # every join below is on renamed columns, so inputs that share a lineage (self-joins)
    # never produce ambiguous references
    snap = snapshot.select(F.col(repo).alias("_sr"), F.col("path").alias("_sp")).distinct()
    f = findings.join(snap, (F.col(repo) == F.col("_sr")) & (F.col("file_path") == F.col("_sp")), "left") \
                .withColumn("_in", F.col("_sp").isNotNull()).drop("_sr", "_sp")
    c = corrections.select(F.col(key).alias("_ck"), F.col("file_path").alias("_cf"), "c_path", "c_lines", "c_status")
    f = f.join(c, (F.col(key) == F.col("_ck")) & (F.col("file_path") == F.col("_cf")), "left").drop("_ck", "_cf")
    snap2 = snap.withColumnsRenamed({"_sr": "_cr", "_sp": "_cp"})
    f = f.join(snap2, (F.col(repo) == F.col("_cr")) & (F.col("c_path") == F.col("_cp")), "left") \
         .withColumn("_c_in", F.col("_cp").isNotNull()).drop("_cr", "_cp")
    # a patch path is looked up in the repositories of its own CVE only
    asked = findings.select(F.col(key).alias("_pk"), F.col(repo).alias("_pr")).distinct()
    there = snapshot.select(F.col(repo).alias("_pr"), F.col("path")).distinct()
    pp = (patch_paths.select(F.col(key).alias("_pk"), "path", "first_pos").join(asked, "_pk").join(there, ["_pr", "path"])
          .groupBy("_pk", "_pr").agg(F.min_by("path", F.col("first_pos")).alias("_fallback")))
    f = f.join(pp, (F.col(key) == F.col("_pk")) & (F.col(repo) == F.col("_pr")), "left").drop("_pk", "_pr")
    complete = (F.col("c_status") == "ok") & F.col("c_path").isNotNull() & (F.coalesce(F.size("c_lines"), F.lit(0)) > 0)
    has_corr = F.coalesce(F.col("c_status") == "ok", F.lit(False))
    path = (F.when(F.col("_in"), F.col("file_path"))
            .when(has_corr & complete & F.col("_c_in"), F.col("c_path"))
            .when(has_corr, F.lit(None).cast("string"))
            .otherwise(F.col("_fallback")))
    lines = (F.when(F.col("_in"), F.col("line_numbers"))
             .when(has_corr & complete & F.col("_c_in"), F.col("c_lines"))
             .when(has_corr, F.lit(None))
             .otherwise(F.when(F.col("_fallback").isNotNull(), F.col("line_numbers"))))
    how = (F.when(F.col("_in"), F.lit("model")).when(has_corr & complete & F.col("_c_in"), F.lit("corrected"))
           .when(has_corr, F.lit("none")).when(F.col("_fallback").isNotNull(), F.lit("patch")).otherwise(F.lit("none")))
    return f.select(key, repo, "file_path", path.alias("resolved_path"), lines.alias("resolved_lines"),
                    how.alias("resolved_by"))


def path_corrections(findings: DataFrame, snapshot: DataFrame, fn: Callable, store: str | None = None,
                     key: str = "cve_id", repo: str = "repo_name") -> DataFrame:
    """X09 -> U03 -> X05: corrections (key, file_path, c_path, c_lines, c_status) for the findings whose path
    the ``snapshot`` (repo, path) lacks, asked of the caller's ``fn(list[str]) -> list[str]``.

    The first item of a reply counts; a reply that does not parse, or is an empty list, has a
    status other than ok, and ``resolve_path`` then falls back to the patch.  Replies are kept in
    ``store`` (``intent.score_stored``), each distinct prompt being asked once."""
    from vulnlake.operators import intent
    there = snapshot.select(F.col(repo).alias("_r"), F.col("path").alias("_p")).distinct()
    name = "repo_name" if "repo_name" in findings.columns else repo
    lost = findings.join(there, (F.col(repo) == F.col("_r")) & (F.col("file_path") == F.col("_p")), "left_anti").select(key, name, "file_path").distinct()
    asked = lost.withColumn("prompt", path_prompt(F.col(key), F.col(name), F.col("file_path")))
    store = store or scratch_dir(findings.sparkSession, "replies")
    d = with_findings(intent.score_stored(asked, "prompt", fn, store), "reply")
    first = F.get("p.items", 0)
    status = F.when((F.col("p.status") == "ok") & (F.coalesce(F.size("p.items"), F.lit(0)) == 0), F.lit("empty")).otherwise(F.coalesce("p.status", F.lit("no_reply")))
    return d.select(key, "file_path", first["file_path"].alias("c_path"), first["line_numbers"].alias("c_lines"), status.alias("c_status"))


def with_findings(df: DataFrame, text: str, out: str = "p") -> DataFrame:
    """X05 as staged projections (the form to use on large tables): ``out`` =
    struct(status, items, body); the fence search and the JSON parse run once per row."""
    from vulnlake.functions.text import with_fenced_json
    d = with_fenced_json(df, text, "_pf_fj")
    d = d.withColumn("_pf_v", F.try_parse_json(F.col("_pf_fj.body")))
    d = d.withColumn("_pf_k", F.schema_of_variant(F.col("_pf_v")))
    d = d.withColumn("_pf_i", F.when(F.col("_pf_k").startswith("ARRAY"), F.col("_pf_v").cast("array<variant>")))
    items = F.col("_pf_i")
    all_obj = F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    status = (F.when(F.col("_pf_fj.status") != "ok", F.col("_pf_fj.status"))
              .when(F.col("_pf_v").isNull(), F.lit("bad_json"))
              .when(~F.col("_pf_k").startswith("ARRAY"), F.lit("not_list"))
              .when(~all_obj, F.lit("item_not_dict"))
              .otherwise(F.lit("ok")))
    d = d.withColumn("_pf_st", status)
    parsed = F.transform(items, lambda x: F.struct(
        F.try_variant_get(x, "$.file_path", "string").alias("file_path"),
        F.try_variant_get(x, "$.line_numbers", "array<int>").alias("line_numbers")))
    d = d.withColumn(out, F.struct(F.col("_pf_st").alias("status"),
                                   F.when(F.col("_pf_st") == "ok", parsed).alias("items"),
                                   F.col("_pf_fj.body").alias("body")))
    return d.drop("_pf_fj", "_pf_v", "_pf_k", "_pf_i", "_pf_st")
