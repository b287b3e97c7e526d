"""One registered query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm import bm25, bpe
from vulnlake.llm import decontaminate as dc
from vulnlake.llm import hard_negatives as hn
from vulnlake.llm import jaccard_join as jj
from vulnlake.llm import langid as li
from vulnlake.llm import line_dedup as ld
from vulnlake.llm import lm_score as lm
from vulnlake.llm import packing as pk
from vulnlake.llm import phrases as ph
from vulnlake.llm import quality as ql
from vulnlake.llm import toxicity as tx
from vulnlake.llm import url_filter as uf
from vulnlake.llm.common import held_out, stage_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each host, cut out of the text of its web pages.  The text is staged, as its
    lines are first counted and then cut."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", uf.parts(F.col("url"))[0].alias("host"), ld.html_lines(F.col("html")).alias("text"))
    return ld.line_dedup(stage_table(pages, "page-lines"), "host", "text").select("page_id", "host", "n_lines", "n_dropped", "text")


ORACLES["op1_line_dedup"] = r"""
WITH raw AS (
  SELECT page_id, html,
         translate(regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM pages),
t1 AS (SELECT page_id, host, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS t FROM raw),
t2 AS (SELECT page_id, host, regexp_replace(t, '(?i)</?(p|div|li|ul|ol|nav|article|footer|header|h1|h2|h3|table|tr|title|body|br|hr)( [^>]*)?/?>', chr(10), 'g') AS t FROM t1),
p AS (SELECT page_id, host, trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), ' ') AS text FROM t2),
l AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
tot AS (SELECT host, count(*) AS n FROM p GROUP BY host),
bad AS (SELECT l.host, trim(line, ' ') AS line FROM l JOIN tot ON tot.host = l.host WHERE trim(line, ' ') <> ''
        GROUP BY l.host, trim(line, ' '), tot.n HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) > 0.1 * tot.n),
k AS (SELECT l.page_id, count(*) AS n_lines, count(bad.line) AS n_dropped,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE bad.line IS NULL), '') AS text
      FROM l LEFT JOIN bad ON bad.host = l.host AND bad.line = trim(l.line, ' ') GROUP BY l.page_id)
SELECT p.page_id, p.host, n_lines, n_dropped, k.text FROM p JOIN k ON k.page_id = p.page_id
"""

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page url: rules first, then the regression."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = uf.url_filter(pages, uf.labelled_urls(spark), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of packed sequences of 1024 tokens, the sources mixed evenly."""
    return pk.pack(table(spark, sf_dir, "documents")).drop("source")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = tx.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return tx.toxicity(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op4_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    found = bm25.search(bm25.build(docs), queries)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


ORACLES["op4_bm25_topk"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT doc_id AS query_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents WHERE doc_id % 20 = 0),
qt AS (SELECT query_id, word, count(*) AS c FROM q GROUP BY ALL),
n AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1e-9) AS mean FROM d),
t AS (SELECT doc_id, dl, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS word FROM d) GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM t WHERE word IN (SELECT word FROM qt) GROUP BY word),
s AS (SELECT query_id, doc_id, round(sum(c * ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
      FROM qt JOIN f USING (word) JOIN t USING (word), n GROUP BY query_id, doc_id)
SELECT query_id, rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op4_bm25_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item whose id is divisible by 20."""
    queries = table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "text")
    found = bm25.search(bm25.build(table(spark, sf_dir, "documents")), queries)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


ORACLES["op4_bm25_benchmark"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query_id, word, count(*) AS c FROM q GROUP BY ALL),
n AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1e-9) AS mean FROM d),
t AS (SELECT doc_id, dl, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS word FROM d) GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM t WHERE word IN (SELECT word FROM qt) GROUP BY word),
s AS (SELECT query_id, doc_id, round(sum(c * ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
      FROM qt JOIN f USING (word) JOIN t USING (word), n GROUP BY query_id, doc_id)
SELECT query_id, rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return li.identify(docs, li.fit(docs.where(~F.col("held_out"))))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = ql.fit(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return ql.quality(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items."""
    found = dc.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op8_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS win FROM bi),
lens AS (SELECT DISTINCT m FROM bw),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM di),
occ AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.win = dw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of 4-word-shingle similarity 0.85 or more."""
    return jj.jaccard_join(table(spark, sf_dir, "documents"), words=4, least=Fraction(85, 100))


ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    return lm.score(docs, lm.fit(docs.where(~F.col("held_out"))))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, against all vectors."""
    label, vector = F.col("label").cast("long"), F.col("embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").where(hn.usable(label, vector)).select(
        "vec_id", moved.alias("label"), hn.quantised(vector).alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hn.hard_negatives(rows)


ORACLES["op11_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, label, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, CAST(sum(a.x * b.x) AS BIGINT) AS s
      FROM c a JOIN c b ON a.i = b.i WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT a, la, b, s FROM s WHERE la = lb AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND s.lb <> p.la AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) QUALIFY row_number() OVER w <= 5
"""


@query
def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level BPE ids and decoded again, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language."""
    return ph.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrases"] = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE m >= 2),
cut AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST(CAST(c.f AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[k + 1:], ' ')),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, f, array_to_string(p[i:i + q - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c))),
longer AS (SELECT lang, phrase, max(f) AS f FROM sub GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase WHERE longer.f IS NULL OR 100 * longer.f < 80 * s.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
