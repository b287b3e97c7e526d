"""The derived views of FIXTURES.md section 3 written as DuckDB SQL.

These are written from the view definitions, independently of the Spark code
in ``derived.py``; the driver runs them against the raw parquet tables.
``with_views(sql, ...)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["dv_cve"] = """
dv_cve AS (
  SELECT 'CVE-' || CAST(year(o.o_orderdate) AS VARCHAR) || '-' || printf('%07d', o.o_orderkey) AS cve_id,
         o.o_orderkey AS cve_key,
         'org' || CAST(o.o_custkey % 97 AS VARCHAR) || '/repo' || CAST(o.o_custkey AS VARCHAR) AS repository,
         o.o_orderdate AS published_date,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
              WHEN o.o_orderkey % 53 = 0 THEN CAST(0 AS DOUBLE)
              ELSE floor(o.o_totalprice / 5000) / CAST(10 AS DOUBLE) END AS cvss_score,
         CASE WHEN o.o_custkey % 7 = 0 THEN NULL ELSE 'CWE-' || CAST(o.o_custkey % 40 AS VARCHAR) END AS cwe_id,
         o.o_orderpriority AS attack_vector,
         o.o_orderstatus AS attack_complexity,
         f.fix_date AS fix_date,
         f.fix_date IS NOT NULL AS has_commit
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS fix_date FROM lineitem
             WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY l_orderkey) f
    ON o.o_orderkey = f.l_orderkey
)"""

VIEWS["dv_repo"] = """
dv_repo AS (
  SELECT 'org' || CAST(c_custkey % 97 AS VARCHAR) || '/repo' || CAST(c_custkey AS VARCHAR) AS repository,
         CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS size,
         'org' || CAST(c_custkey % 97 AS VARCHAR) AS owner,
         c_custkey,
         c_mktsegment AS license
  FROM customer
)"""

VIEWS["dv_event_commit"] = """
dv_event_commit AS (
  SELECT 'repo' || CAST(user_id AS VARCHAR) AS repository,
         md5(CAST(event_id AS VARCHAR)) AS sha,
         ts AS commit_ts,
         event_type AS author,
         value AS n,
         event_id,
         event_type
  FROM events
)"""

VIEWS["dv_commit_file"] = """
dv_commit_file AS (
  SELECT md5(CAST(l.l_orderkey AS VARCHAR)) AS sha,
         l.l_orderkey,
         l.l_linenumber,
         lower(p.p_type) || '/' || replace(p.p_name, ' ', '/') || '/' ||
           CASE p.p_size % 8 WHEN 0 THEN 'auth_util.py' WHEN 1 THEN 'config.yml' WHEN 2 THEN 'package.json'
                WHEN 3 THEN 'test_main.c' WHEN 4 THEN 'Gemfile' WHEN 5 THEN 'README' WHEN 6 THEN 'crypto.h'
                ELSE 'main.go' END AS filename,
         l.l_quantity AS additions,
         l.l_shipdate AS commit_date,
         CASE l.l_linenumber % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END AS status,
         p.p_partkey % 13 AS deletions,
         CASE WHEN p.p_size % 5 <> 0 THEN '@@ -1 +1 @@ ' || p.p_name END AS patch
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
)"""

VIEWS["dv_ref"] = """
dv_ref AS (
  SELECT CAST(floor(page_id / 5) AS BIGINT) AS cve_key,
         CAST(page_id % 5 AS BIGINT) AS pos,
         page_id,
         CASE page_id % 4
           WHEN 0 THEN 'https://github.com/org' || CAST(page_id % 9 AS VARCHAR) || '/repo' || CAST(page_id % 17 AS VARCHAR)
                       || '/commit/' || md5(CAST(page_id AS VARCHAR))
           WHEN 1 THEN 'https://github.com/org' || CAST(page_id % 9 AS VARCHAR) || '/repo' || CAST(page_id % 17 AS VARCHAR)
                       || '/commit/' || md5(CAST(page_id AS VARCHAR)) || '.patch'
           WHEN 2 THEN 'https://github.com/org' || CAST(page_id % 9 AS VARCHAR)
           ELSE url END AS url,
         'nvd@nist.gov' AS source,
         CASE page_id % 3 WHEN 0 THEN ['Patch'] WHEN 1 THEN ['Exploit', 'Third Party Advisory']
              ELSE CAST([] AS VARCHAR[]) END AS tags
  FROM pages
)"""

VIEWS["dv_weeks"] = """
dv_weeks AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS c, sum(value) AS a, sum(value * 0.5) AS d
  FROM events GROUP BY user_id, CAST(ts AS DATE)
)"""

VIEWS["dv_snapshot"] = """
dv_snapshot AS (
  SELECT doc_id, source AS repo_name, 'f' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content
  FROM documents
)"""

VIEWS["dv_reply"] = """
dv_reply AS (
  SELECT doc_id,
         CASE doc_id % 7
           WHEN 0 THEN text
           ELSE text || chr(10) || '```json' || chr(10) ||
                CASE doc_id % 7 WHEN 1 THEN '' WHEN 2 THEN '{bad' WHEN 3 THEN '{"a": 1}' WHEN 4 THEN '[1]'
                     WHEN 5 THEN '[]'
                     ELSE '[{"file_path": "f' || CAST(doc_id AS VARCHAR) || '.txt", "line_numbers": [3]}]' END
                || chr(10) || '```' || chr(10) END AS reply
  FROM documents
)"""

VIEWS["dv_state"] = """
dv_state AS (
  SELECT 'org' || CAST(c_custkey % 97 AS VARCHAR) || '/repo' || CAST(c_custkey AS VARCHAR) AS key,
         CASE c_custkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed: x' WHEN 2 THEN 'started' ELSE 'failed' END AS status,
         c_custkey
  FROM customer
)"""

VIEWS["dv_desc"] = """
dv_desc AS (
  SELECT d.doc_id, d.text AS description, d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

def with_views(sql: str, *views: str) -> str:
    """``WITH <views> <sql>``; ``sql`` may itself start with more CTEs (``, x AS (...)``)."""
    ctes = ",".join(VIEWS[v] for v in views)
    sql = sql.strip()
    if sql.startswith(","):
        return "WITH " + ctes + sql
    return "WITH " + ctes + "\n" + sql

VIEWS["dv_patch"] = """
dv_patch AS (
  SELECT doc_id, 'CVE-2024-' || printf('%07d', doc_id) || '_org' || CAST(doc_id % 7 AS VARCHAR) || '_' || source || '.patch' AS file_name,
         source || '/f' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         '--- a/' || source || '/f' || CAST(doc_id AS VARCHAR) || '.txt' || chr(10) ||
         '+++ b/' || source || '/f' || CAST(doc_id AS VARCHAR) || '.txt' || chr(10) ||
         '@@ -1,' || CAST(len(string_split(text, chr(10))) - len(string_split(text, chr(10))) // 3 AS VARCHAR) ||
         ' +1,' || CAST(len(string_split(text, chr(10))) - (len(string_split(text, chr(10))) + 1) // 3 AS VARCHAR) || ' @@' || chr(10) ||
         array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: [' ', '-', '+'][((i - 1) % 3) + 1] || s), chr(10))
         || chr(10) AS text
  FROM documents
)"""
