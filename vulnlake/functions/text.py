"""Text functions: paths, captions, model replies, blame lines and snippet
cutting (SURVEY P14, P16, X03, X04, X07, X12-X14)."""

from __future__ import annotations

import pandas as pd  # noqa: F401  (pandas_udf type hints)
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = "```"
# Error codes a line -> commit map may hold instead of a hash.
ERROR_CODES = ["blame_error", "parse_error", "timeout_error", "git_not_found", "exception_error"]
# Snippet context lines and line markers.
CONTEXT_BEFORE, CONTEXT_AFTER = 2, 3
VULN_MARK, PLAIN_MARK = "VULN> ", "      "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, f) -> Column:
    """``f(value)``, where ``value`` is evaluated once a row however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def basename(p) -> Column:
    """Last path component."""
    return F.substring_index(_c(p), "/", -1)


def extension(p) -> Column:
    """Lower-cased extension with its dot, empty when none (dot-files have none)."""
    return F.lower(F.regexp_extract(basename(p), r"^.+(\.[^.]*)$", 1))


@F.pandas_udf(T.StringType())
def format_2f(x: "pd.Series") -> "pd.Series":  # noqa: F821
    """Two-decimal text of a double rounded on its exact binary value (Python's ``:.2f``;
    Java's formatter rounds the shortest decimal form half-up instead, so 4.225 differs)."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.2f}")


def repo_caption(repo, size, count, score) -> Column:
    """``Repository: r<br>Size: 1,234 KB<br>Vulnerabilities: n<br>Avg CVSS: x.xx``."""
    return F.concat(F.lit("Repository: "), _c(repo),
                    F.lit("<br>Size: "), F.format_number(_c(size).cast("bigint"), 0), F.lit(" KB"),
                    F.lit("<br>Vulnerabilities: "), _c(count).cast("string"),
                    F.lit("<br>Avg CVSS: "), format_2f(F.round(_c(score).cast("double"), 6)))


def fenced_json(text) -> Column:
    """X03 strict: body between the first three-backtick ``json`` opener and the next
    three backticks, trimmed.  ``struct(body, status)``; status ``no_markers`` when
    either marker is missing, ``empty`` for an empty body, else ``ok``."""
    t = _c(text)
    opener = FENCE + "json"

    def from_start(start):
        body_from = start + F.lit(len(opener))
        # locate() with a column start position: no copy of the text after the opener
        close = F.when(start > 0, F.call_function("locate", F.lit(FENCE), t, body_from)).otherwise(F.lit(0))
        return let(close, lambda end: F.when((start > 0) & (end > 0), F.btrim(F.substring(t, body_from, end - body_from), F.lit(" \t\n\r\x0b\x0c"))))

    def from_body(body):
        status = (F.when(body.isNull(), F.lit("no_markers")).when(body == "", F.lit("empty")).otherwise(F.lit("ok")))
        return F.struct(body.alias("body"), status.alias("status"))
    return let(let(F.instr(t, opener), from_start), from_body)


def fenced_json_or_all(text) -> Column:
    """X04 lenient: regex ``FENCE json \\s*(.*?)\\s* FENCE`` across lines; no match = whole text."""
    t = _c(text)
    pat = r"(?s)```json\s*(.*?)\s*```"
    return F.when(t.rlike(pat), F.regexp_extract(t, pat, 1)).otherwise(t)


def parse_blame(text) -> Column:
    """Hash of the first line starting with 40 hex characters and a space;
    ``parse_error`` when there is none."""
    h = F.regexp_extract(_c(text), r"(?m)^([0-9a-f]{40}) ", 1)
    return F.when(h != "", h).otherwise(F.lit("parse_error"))


def is_valid_commit(c) -> Column:
    """Non-empty and not one of the error codes."""
    x = _c(c)
    return F.coalesce(x.isNotNull() & (x != "") & ~x.isin(*ERROR_CODES), F.lit(False))


def text_lines(content) -> Column:
    """Lines as a file reader sees them: ``\\r\\n`` / ``\\r`` -> ``\\n``; a final newline
    does not start another line."""
    c = _c(content)
    t = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))


def cut_snippet(content, line_numbers, before: int = CONTEXT_BEFORE, after: int = CONTEXT_AFTER) -> Column:
    """Lines ``max(0, min-1-before)`` .. ``min(n, max+after)`` (0-based, end excluded),
    each ``VULN> `` or six spaces, ``%4d: `` and the text, joined by newlines.
    Null when the range is empty (the failure case)."""
    lines = text_lines(content)
    ln = _c(line_numbers)
    start = F.greatest(F.lit(0), F.array_min(ln) - 1 - before)
    end = F.least(F.size(lines), F.array_max(ln) + after)
    sel = F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))
    fmt = F.transform(sel, lambda s, i: F.format_string(
        "%s%4d: %s",
        F.when(F.array_contains(ln, start + i + 1), F.lit(VULN_MARK)).otherwise(F.lit(PLAIN_MARK)),
        start + i + 1, s))
    return F.when(end > start, F.array_join(fmt, "\n"))


def with_fenced_json(df, text: str, out: str = "fj"):
    """X03 as staged projections: ``out`` = struct(body, status).

    Each step is its own projection so that the search, the cut and the trim run once
    per row (a single nested expression would be re-evaluated inside every branch
    that refers to it)."""
    t = F.col(text)
    opener = FENCE + "json"
    d = df.withColumn("_fj_s", F.instr(t, opener))
    d = d.withColumn("_fj_e", F.when(F.col("_fj_s") > 0, F.call_function(
        "locate", F.lit(FENCE), t, F.col("_fj_s") + len(opener))).otherwise(F.lit(0)))
    d = d.withColumn("_fj_b", F.when((F.col("_fj_s") > 0) & (F.col("_fj_e") > 0), F.btrim(
        F.substring(t, F.col("_fj_s") + len(opener), F.col("_fj_e") - F.col("_fj_s") - len(opener)),
        F.lit(" \t\n\r\x0b\x0c"))))
    b = F.col("_fj_b")
    st = F.when(b.isNull(), F.lit("no_markers")).when(b == "", F.lit("empty")).otherwise(F.lit("ok"))
    return d.withColumn(out, F.struct(b.alias("body"), st.alias("status"))).drop("_fj_s", "_fj_e", "_fj_b")


def with_snippet(df, content: str, line_numbers: str, out: str = "code",
                 before: int = CONTEXT_BEFORE, after: int = CONTEXT_AFTER):
    """X14 as staged projections: the file is split into lines once per row, then cut."""
    d = df.withColumn("_sn_l", text_lines(F.col(content)))
    ln = F.col(line_numbers)
    d = d.withColumn("_sn_s", F.greatest(F.lit(0), F.array_min(ln) - 1 - before)) \
         .withColumn("_sn_e", F.least(F.size("_sn_l"), F.array_max(ln) + after))
    start, end = F.col("_sn_s"), F.col("_sn_e")
    d = d.withColumn("_sn_sel", F.when(end > start, F.slice(F.col("_sn_l"), start + 1, end - start)))
    fmt = F.transform(F.col("_sn_sel"), lambda s, i: F.format_string(
        "%s%4d: %s",
        F.when(F.array_contains(ln, start + i + 1), F.lit(VULN_MARK)).otherwise(F.lit(PLAIN_MARK)),
        start + i + 1, s))
    return d.withColumn(out, F.array_join(fmt, "\n")).drop("_sn_l", "_sn_s", "_sn_e", "_sn_sel")
