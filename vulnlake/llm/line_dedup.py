"""Line dedup by site-relative frequency: a line that stands on too large a share of a
host's pages is boilerplate of that host and is dropped from its pages.

DataFrame expressions only.  Lines are counted per (host, line hash) with map-side
partial sums, so neither a hot host nor a hot line gathers in one task.  The boilerplate
lines of one host are few by construction (at most its mean distinct lines a page divided
by the ratio), so they travel as one array per host, joined to the pages; a hot host's
pages are split by AQE's skew join, or never shuffled where the array table is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RATIO = 0.1
MIN_PAGES = 5


def line_key(line: Column) -> Column:
    """Two independent 64-bit hashes of the trimmed line."""
    t = F.trim(line)
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("line"), t).alias("b"))


def boilerplate(df: DataFrame, site: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(site, bad): per site the keys of the lines on more than ``max_ratio`` of its pages and on
    at least ``min_pages`` pages."""
    pages = df.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("_site"), F.col(text).alias("_text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""), line_key))
    counts = (pages.select("_site", F.explode(lines).alias("_line"))
              .groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages))
    totals = pages.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    bad = counts.join(totals, "_site").where(F.col("_n") > F.col("_pages") * F.lit(max_ratio))
    return bad.groupBy("_site").agg(F.collect_list("_line").alias("_bad"))


def line_dedup(df: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO,
               min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with boilerplate lines cut out of ``text``, plus ``n_lines`` and ``n_dropped``.

    A page counts once for a line however often it repeats it; all its repeats are dropped.
    Lines are compared without outer spaces; blank lines are never boilerplate and stay.  A null
    site counts as the site ''; a null text has 0 lines and stays null, but counts as a page.
    Ties (a share of exactly ``max_ratio``) keep the line.  A site's few pages are safe: a line
    needs ``min_pages`` pages.  Texts and lines of any length are read whole.  Every row stays, also one whose text becomes empty; an empty
    table gives an empty result; input columns ``n_lines`` and ``n_dropped`` are replaced."""
    host, hits, left = unused(df, "_site"), unused(df, "_bad"), unused(df, "_kept")
    bad = boilerplate(df, site, text, max_ratio, min_pages).withColumnsRenamed({"_site": host, "_bad": hits})
    key = F.coalesce(F.col(site).cast("string"), F.lit(""))
    out = df.withColumn(host, key).join(bad, host, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(hits), line_key(x)))
    kept = F.when(F.col(hits).isNull(), lines).otherwise(kept)
    out = out.withColumn(left, kept)
    return out.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_dropped": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long"),
        text: F.array_join(left, "\n"),
    }).drop(host, hits, left)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with more underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def html_lines(html: Column) -> Column:
    """Text of a web page, one block element a line: scripts, styles and comments go, block tags
    end a line, other tags vanish, blank lines are squeezed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(p|div|li|ul|ol|nav|article|footer|header|h1|h2|h3|table|tr|title|body|br|hr)( [^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(t, r"[ \t\r]*\n[ \t\r\n]*", "\n"))
