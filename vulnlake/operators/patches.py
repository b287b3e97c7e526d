"""Unified-diff text as tables.

A patch is one row of whole text; its lines are exploded with their
positions, and hunk membership and line numbers come from running sums over
``(patch, hunk)`` windows.  A patch's lines sit in one window partition,
which holds exactly what one text row already held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK_RE = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def explode_lines(df: DataFrame, key, text: str = "text") -> DataFrame:
    """One row per line: ``(key..., pos, line)``; ``\\r`` before a newline is dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")).alias("pos", "line"))


def patch_paths(df: DataFrame, key: str = "file_name", text: str = "text", parity: bool = False) -> DataFrame:
    """Distinct file paths of lines starting ``--- a/`` or ``+++ b/``.

    Default: the path after the ``a/`` / ``b/`` prefix, inner spaces kept.
    ``parity=True``: the second space-separated token, prefix kept (ledger L7)."""
    ln = explode_lines(df, key, text)
    ln = ln.filter(F.col("line").startswith("--- a/") | F.col("line").startswith("+++ b/"))
    if parity:
        path = _strip(F.get(F.split(F.col("line"), " ", 3), 1))
    else:
        path = _strip(F.substring(F.col("line"), 7, 1 << 30))
    return (ln.select(key, path.alias("path"), "pos")
            .filter((F.col("path") != "") & (F.col("path") != "/dev/null"))
            .groupBy(key, "path").agg(F.min("pos").alias("first_pos")))


def patch_lines(df: DataFrame, key: str = "file_name", text: str = "text") -> DataFrame:
    """X02 + F16: one row per hunk body line with file path, hunk number, sign and the
    old / new line numbers.

    A hunk's body is the lines after its ``@@`` header until both its old and new
    counts are used up, so body lines that look like file headers (a removed
    ``-- x`` line reads ``--- x``) stay body lines.

    Every window shares one spec, ``(patch ORDER BY pos)``: the in-hunk counts are the
    patch-wide running counts minus their value at the hunk header, so the lines are
    sorted once and the three window passes reuse that order.  The patches are
    hash-partitioned by their key *before* the lines are exploded: that is the exchange
    the windows need anyway, it moves whole texts instead of exploded lines, and the
    explode then runs in every shuffle partition."""
    keys = [key] if isinstance(key, str) else list(key)
    ln = explode_lines(df.repartition(F.col(keys[0])), keys, text)
    key = keys[0]
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    is_h = line.startswith("@@ ")
    sign = F.substring(line, 1, 1)
    h = F.regexp_extract(line, HUNK_RE, 1)
    hdr = F.when(is_h & (h != ""), F.struct(
        h.cast("bigint").alias("os"),
        F.coalesce(F.nullif(F.regexp_extract(line, HUNK_RE, 2), F.lit("")), F.lit("1")).cast("bigint").alias("oc"),
        F.regexp_extract(line, HUNK_RE, 3).cast("bigint").alias("ns"),
        F.coalesce(F.nullif(F.regexp_extract(line, HUNK_RE, 4), F.lit("")), F.lit("1")).cast("bigint").alias("nc")))
    u_old = (~is_h & sign.isin(" ", "-")).cast("bigint")
    u_new = (~is_h & sign.isin(" ", "+")).cast("bigint")
    # pass 1: hunk number, current header, patch-wide running counts
    ln = ln.select("*", is_h.alias("is_hunk"), sign.alias("sign"), u_old.alias("_uo"), u_new.alias("_un"),
                   F.sum(is_h.cast("int")).over(w).alias("hunk"), F.last(hdr, ignorenulls=True).over(w).alias("h"),
                   F.sum(u_old).over(w).alias("_co"), F.sum(u_new).over(w).alias("_cn"))
    # pass 2: the running counts at the current hunk's header
    ln = ln.select("*", F.last(F.when(F.col("is_hunk"), F.col("_co")), ignorenulls=True).over(w).alias("_ho"),
                   F.last(F.when(F.col("is_hunk"), F.col("_cn")), ignorenulls=True).over(w).alias("_hn"))
    old_before = F.col("_co") - F.col("_uo") - F.col("_ho")
    new_before = F.col("_cn") - F.col("_un") - F.col("_hn")
    body_row = (F.col("hunk") > 0) & ~F.col("is_hunk")
    in_body = body_row & F.col("h").isNotNull() & (
        (old_before < F.col("h.oc")) | (new_before < F.col("h.nc"))) & F.col("sign").isin(" ", "-", "+", "\\")
    ln = ln.select("*", in_body.alias("in_body"), old_before.alias("old_before"), new_before.alias("new_before"))
    # pass 3: file headers are the non-body '--- ' / '+++ ' lines; the path is the last one seen
    new_p = F.when(~F.col("in_body") & line.startswith("+++ "),
                   F.regexp_replace(_strip(F.substring(line, 5, 1 << 30)), "^b/", ""))
    old_p = F.when(~F.col("in_body") & line.startswith("--- "),
                   F.regexp_replace(_strip(F.substring(line, 5, 1 << 30)), "^a/", ""))
    ln = ln.select("*", F.last(new_p, ignorenulls=True).over(w).alias("_new"),
                   F.last(old_p, ignorenulls=True).over(w).alias("_old"))
    path = F.when(F.col("_new") == "/dev/null", F.col("_old")).otherwise(F.coalesce(F.col("_new"), F.col("_old")))
    return (ln.filter(F.col("in_body") & (F.col("sign") != "\\"))
            .select(*keys, F.col("pos").cast("bigint").alias("pos"), path.alias("path"),
                    F.col("hunk").cast("bigint").alias("hunk"), "sign",
                    F.when(F.col("sign") != "+", F.col("h.os") + F.col("old_before")).alias("old_no"),
                    F.when(F.col("sign") != "-", F.col("h.ns") + F.col("new_before")).alias("new_no"),
                    F.substring(line, 2, 1 << 30).alias("text")))
