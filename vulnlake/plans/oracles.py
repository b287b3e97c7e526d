"""DuckDB oracle SQL for the registered queries, written from the operator
Doubles are rounded to 6 places and integers cast to BIGINT, as on the Spark
side."""

from __future__ import annotations

from vulnlake.plans.oracle_views import with_views as W

ORACLES: dict[str, str] = {}

SEV = ("CASE WHEN {s} >= 9 THEN 'Critical' WHEN {s} >= 7 THEN 'High' WHEN {s} >= 4 THEN 'Medium' "
       "WHEN {s} IS NOT NULL THEN 'Low' END")
SW = """, sw AS (SELECT * FROM dv_cve WHERE cvss_score IS NOT NULL AND cvss_score <> 0
                  AND year(published_date) BETWEEN 1996 AND 2000)"""
MONTH = "CAST(CAST(date_trunc('month', published_date) AS DATE) AS VARCHAR)"  # dates leave as ISO text


def sev(s: str) -> str:
    return SEV.format(s=s)


# ---------------------------------------------------------------- severity
ORACLES["a06_monthly_severity"] = W(SW + f"""
SELECT {MONTH} AS month,
       CAST(count_if({sev('cvss_score')} = 'Critical') AS BIGINT) AS critical,
       CAST(count_if({sev('cvss_score')} = 'High') AS BIGINT) AS high,
       CAST(count_if({sev('cvss_score')} = 'Medium') AS BIGINT) AS medium,
       CAST(count_if({sev('cvss_score')} = 'Low') AS BIGINT) AS low
FROM sw GROUP BY 1""", "dv_cve")

ORACLES["a07_monthly_total"] = W(SW + f"""
SELECT {MONTH} AS month, count(*) AS total FROM sw GROUP BY 1""", "dv_cve")

ORACLES["a08_monthly_severity_pct"] = W(SW + f"""
SELECT {MONTH} AS month, count(*) AS total,
       round(count_if({sev('cvss_score')} = 'Critical') * CAST(100 AS DOUBLE) / count(*), 6) AS pct_critical,
       round(count_if({sev('cvss_score')} = 'High') * CAST(100 AS DOUBLE) / count(*), 6) AS pct_high,
       round(count_if({sev('cvss_score')} = 'Medium') * CAST(100 AS DOUBLE) / count(*), 6) AS pct_medium,
       round(count_if({sev('cvss_score')} = 'Low') * CAST(100 AS DOUBLE) / count(*), 6) AS pct_low
FROM sw GROUP BY 1""", "dv_cve")

ORACLES["a01_overview"] = W("""
SELECT count(*) AS total_vulnerabilities, count(DISTINCT repository) AS unique_repositories,
       round(sum(CASE WHEN cvss_score IS NOT NULL AND cvss_score <> 0 THEN cvss_score ELSE 0 END)
             / CAST(count(*) AS DOUBLE), 6) AS avg_cvss_score
FROM dv_cve""", "dv_cve")

ORACLES["a02_count_by_year"] = W("""
SELECT substr(CAST(published_date AS VARCHAR), 1, 4) AS year, count(*) AS n FROM dv_cve GROUP BY 1""", "dv_cve")

ORACLES["a03_severity_summary"] = W(SW + f"""
SELECT count(*) AS n, round(avg(cvss_score), 6) AS mean_score,
       round(avg(CASE WHEN {sev('cvss_score')} = 'Critical' THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_critical
FROM sw""", "dv_cve")

ORACLES["a04_severity_distribution"] = W(SW + f"""
, g AS (SELECT {sev('cvss_score')} AS severity, count(*) AS n FROM sw GROUP BY 1)
SELECT severity, n, round(n * CAST(100 AS DOUBLE) / sum(n) OVER (), 6) AS pct FROM g""", "dv_cve")

ORACLES["a05_yearly_trend"] = W(SW + f"""
SELECT CAST(year(published_date) AS BIGINT) AS year, round(avg(cvss_score), 6) AS mean_score, count(*) AS n,
       round(avg(CASE WHEN {sev('cvss_score')} = 'Critical' THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_critical
FROM sw GROUP BY 1""", "dv_cve")

# ---------------------------------------------------------------- filters
ORACLES["f01_with_repository"] = W("""
SELECT cve_id, repository FROM dv_cve WHERE repository IS NOT NULL AND repository <> ''""", "dv_cve")
ORACLES["f02_published_since"] = W("""
SELECT cve_id, published_date FROM dv_cve WHERE published_date >= TIMESTAMP '1998-01-01 00:00:00'""", "dv_cve")
ORACLES["f03_year_between"] = W("""
SELECT cve_id, published_date FROM dv_cve WHERE year(published_date) BETWEEN 1996 AND 2000""", "dv_cve")
ORACLES["f04_scored_truthy"] = W("""
SELECT cve_id, round(cvss_score, 6) AS cvss_score FROM dv_cve WHERE cvss_score IS NOT NULL AND cvss_score <> 0""",
                                 "dv_cve")
ORACLES["f05_scored_not_null"] = W("""
SELECT cve_id, round(cvss_score, 6) AS cvss_score FROM dv_cve
WHERE cvss_score IS NOT NULL AND repository IS NOT NULL""", "dv_cve")
ORACLES["f06_scored_zero"] = W(f"""
SELECT cve_id, round(coalesce(cvss_score, 0), 6) AS cvss_score,
       coalesce({sev('coalesce(cvss_score, 0)')}, 'Unknown') AS severity FROM dv_cve""", "dv_cve")
ORACLES["f07_has_commit"] = W("""
SELECT cve_id, fix_date FROM dv_cve WHERE has_commit AND fix_date IS NOT NULL""", "dv_cve")

# ---------------------------------------------------------------- scalar: severity and time
ORACLES["p22_severity"] = W(f"""
SELECT cve_id, round(cvss_score, 6) AS cvss_score, coalesce({sev('cvss_score')}, 'Unknown') AS severity
FROM dv_cve""", "dv_cve")

ORACLES["p23_parse_ts"] = """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS parsed FROM events"""

ORACLES["p24_time_parts"] = W("""
SELECT sha, CAST(year(commit_ts) AS BIGINT) AS year, CAST(month(commit_ts) AS BIGINT) AS month,
       CAST(CAST(date_trunc('month', commit_ts) AS DATE) AS VARCHAR) AS month_start,
       CAST(CAST(date_trunc('week', commit_ts) AS DATE) AS VARCHAR) AS week_start,
       dayname(commit_ts) AS weekday, CAST(hour(commit_ts) AS BIGINT) AS hour
FROM dv_event_commit""", "dv_event_commit")

ORACLES["p25_is_working_hours"] = W("""
SELECT sha, hour(commit_ts) BETWEEN 9 AND 17 AND isodow(commit_ts) <= 5 AS is_working_hours
FROM dv_event_commit""", "dv_event_commit")

ORACLES["p36_ordinal_day"] = W("""
SELECT cve_id, CAST(date_diff('day', DATE '0001-01-01', CAST(published_date AS DATE)) + 1 AS BIGINT) AS ordinal_day
FROM dv_cve""", "dv_cve")

# ---------------------------------------------------------------- timing
ORACLES["a09_timing_coverage"] = W("""
SELECT count(*) AS total, count_if(has_commit) AS with_date,
       round(count_if(has_commit) * CAST(100 AS DOUBLE) / nullif(count(*), 0), 6) AS pct FROM dv_cve""", "dv_cve")

ORACLES["a10_weekday_hour"] = W("SELECT CAST(isodow(commit_ts) - 1 AS BIGINT) AS weekday_idx, dayname(commit_ts) AS weekday, "
                                + ", ".join(f"count_if(hour(commit_ts) = {h}) AS h{h:02d}" for h in range(24))
                                + " FROM dv_event_commit GROUP BY 1, 2", "dv_event_commit")

ORACLES["a11_top_days"] = W("""
SELECT dayname(commit_ts) AS weekday, count(*) AS n FROM dv_event_commit GROUP BY 1
ORDER BY n DESC, weekday LIMIT 5""", "dv_event_commit")

ORACLES["a12_top_hours"] = W("""
SELECT CAST(hour(commit_ts) AS BIGINT) AS hour, count(*) AS n FROM dv_event_commit GROUP BY 1
ORDER BY n DESC, hour LIMIT 5""", "dv_event_commit")

ORACLES["a13_working_share"] = W("""
SELECT round(avg(CASE WHEN hour(commit_ts) BETWEEN 9 AND 17 AND isodow(commit_ts) <= 5 THEN 1.0 ELSE 0.0 END) * 100, 6)
         AS pct_working,
       round(100 - avg(CASE WHEN hour(commit_ts) BETWEEN 9 AND 17 AND isodow(commit_ts) <= 5 THEN 1.0 ELSE 0.0 END)
         * 100, 6) AS pct_off
FROM dv_event_commit""", "dv_event_commit")

# ---------------------------------------------------------------- coverage
_COV = """SELECT {b} AS bucket, count(*) AS n_all, count_if(has_commit) AS n_with,
       round(coalesce(count_if(has_commit) * CAST(100 AS DOUBLE) / nullif(count(*), 0), 0), 6) AS pct
FROM dv_cve GROUP BY 1"""
_B = {"year": "CAST(year(published_date) AS BIGINT)",
      "month": "CAST(date_trunc('month', published_date) AS DATE)",
      "week": "CAST(date_trunc('week', published_date) AS DATE)"}

ORACLES["a14_coverage"] = W("""
SELECT count(*) AS n_all, count_if(has_commit) AS n_with,
       round(coalesce(count_if(has_commit) * CAST(100 AS DOUBLE) / nullif(count(*), 0), 0), 6) AS pct
FROM dv_cve""", "dv_cve")
ORACLES["a14_coverage_by_year"] = W(_COV.format(b=_B["year"]), "dv_cve")
ORACLES["a15_coverage_by_month"] = W(_COV.format(b="CAST(" + _B["month"] + " AS VARCHAR)"), "dv_cve")
ORACLES["a16_coverage_by_week"] = W(_COV.format(b="CAST(" + _B["week"] + " AS VARCHAR)"), "dv_cve")


def _regr(bucket: str, y: str, where: str) -> str:
    cov_sql = _COV.format(b=_B[bucket]).replace("round(", "(").replace(", 6) AS pct", ") AS pct")
    return W(f""", cv AS ({cov_sql}),
pts AS (SELECT CAST(date_diff('day', DATE '0001-01-01', bucket) + 1 AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y
        FROM cv {where})
SELECT regr_count(y, x) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
       round(corr(y, x), 6) AS r, round(regr_r2(y, x), 6) AS r2,
       round(sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / nullif(regr_count(y, x) - 2, 0)) / sqrt(regr_sxx(y, x)), 6)
         AS std_err,
       round(min(x), 6) AS x_min, round(max(x), 6) AS x_max
FROM pts""", "dv_cve")


ORACLES["a17_time_regression_month"] = _regr("month", "n_with", "WHERE n_with > 0")
ORACLES["a17_time_regression_week"] = _regr("week", "n_with", "WHERE n_with > 0")
ORACLES["a18_time_regression_pct_month"] = _regr("month", "pct", "")
ORACLES["a18_time_regression_pct_week"] = _regr("week", "pct", "")
ORACLES["a19_regression_line"] = W(f""", cv AS ({_COV.format(b=_B['week']).replace('round(', '(').replace(', 6) AS pct', ') AS pct')}),
pts AS (SELECT CAST(date_diff('day', DATE '0001-01-01', bucket) + 1 AS DOUBLE) AS x, CAST(pct AS DOUBLE) AS y FROM cv),
f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, min(x) AS x_min, max(x) AS x_max FROM pts)
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(slope * x_min + intercept, 6) AS y_at_min, round(slope * x_max + intercept, 6) AS y_at_max FROM f""",
                                   "dv_cve")

# ---------------------------------------------------------------- repositories
_J = """, j AS (SELECT c.cve_id, c.repository, r.size, c.cvss_score
             FROM dv_cve c JOIN dv_repo r ON c.repository = r.repository),
f5 AS (SELECT * FROM j WHERE cvss_score IS NOT NULL AND repository IS NOT NULL AND size IS NOT NULL),
m20 AS (SELECT repository, arg_min(size, cve_id) AS size, count(cvss_score) AS vuln_count, avg(cvss_score) AS avg_cvss
        FROM f5 GROUP BY repository),
m22 AS (SELECT size AS repo_size, count(*) AS vulnerabilities, avg(cvss_score) AS avg_cvss FROM f5 GROUP BY size),
m23 AS (SELECT size AS repo_size, count(*) AS vulnerabilities, avg(coalesce(cvss_score, 0)) AS avg_cvss,
               stddev_samp(coalesce(cvss_score, 0)) AS std_cvss,
               CAST(count(*) AS DOUBLE) / nullif(CAST(size AS DOUBLE), 0) AS vuln_density
        FROM j GROUP BY size)"""


def R(sql: str) -> str:
    return W(_J + "\n" + sql, "dv_cve", "dv_repo")


ORACLES["j01_join_repo"] = R("SELECT cve_id, repository, size FROM j")
ORACLES["a20_repo_metrics"] = R("SELECT repository, size, vuln_count, round(avg_cvss, 6) AS avg_cvss FROM m20")
ORACLES["a21_repo_summary"] = R("""
SELECT count(*) AS n_repositories, round(avg(vuln_count), 6) AS mean_vuln_count,
       round(avg(avg_cvss), 6) AS mean_avg_cvss, max(size) AS max_size,
       (SELECT repository FROM m20 ORDER BY vuln_count DESC, repository LIMIT 1) AS top_repository
FROM m20""")
ORACLES["a22_size_metrics"] = R("SELECT repo_size, vulnerabilities, round(avg_cvss, 6) AS avg_cvss FROM m22")
ORACLES["a23_size_metrics_ext"] = R("""
SELECT repo_size, vulnerabilities, round(avg_cvss, 6) AS avg_cvss, round(std_cvss, 6) AS std_cvss,
       round(vuln_density, 6) AS vuln_density FROM m23""")
ORACLES["a24_size_report"] = R("""
SELECT count(*) AS size_groups, CAST(sum(vulnerabilities) AS BIGINT) AS total_vulnerabilities,
       round(median(CAST(repo_size AS DOUBLE)), 6) AS median_size, round(avg(repo_size), 6) AS mean_size,
       round(avg(vulnerabilities), 6) AS mean_vulnerabilities,
       round(median(CAST(vulnerabilities AS DOUBLE)), 6) AS median_vulnerabilities,
       round(avg(avg_cvss), 6) AS mean_avg_cvss, round(median(avg_cvss), 6) AS median_avg_cvss,
       round(corr(CAST(repo_size AS DOUBLE), CAST(vulnerabilities AS DOUBLE)), 6) AS corr_size_count,
       round(corr(CAST(repo_size AS DOUBLE), avg_cvss), 6) AS corr_size_score
FROM m23""")
_CC = ["repo_size", "vulnerabilities", "avg_cvss", "vuln_density", "std_cvss"]
ORACLES["a25_correlation_matrix"] = R("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM m23"
    for a in _CC for b in _CC))
_LP = """, lp AS (SELECT log10(CAST(repo_size AS DOUBLE)) AS lx, log10(CAST(vulnerabilities AS DOUBLE)) AS ly
         FROM m23 WHERE repo_size > 0 AND vulnerabilities > 0)"""
ORACLES["a26_loglog_fit"] = R(_LP + """
SELECT regr_count(ly, lx) AS n, round(regr_slope(ly, lx), 6) AS slope, round(regr_intercept(ly, lx), 6) AS intercept
FROM lp""")
ORACLES["a27_loglog_curve"] = R(_LP + """
, one AS (SELECT min(lx) AS lo, max(lx) AS hi, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept FROM lp)
SELECT CAST(g.i AS BIGINT) AS i, round(pow(10.0, lo + (hi - lo) * g.i / CAST(99 AS DOUBLE)), 6) AS size,
       round(pow(10.0, slope * (lo + (hi - lo) * g.i / CAST(99 AS DOUBLE)) + intercept), 6) AS fitted_count
FROM one, range(100) g(i)""")


def _bin(v: str, lo: str, hi: str, bins: int) -> str:
    return (f"CASE WHEN {v} >= {lo} AND {v} <= {hi} THEN "
            f"least(CAST(floor(({v} - {lo}) * CAST({bins} AS DOUBLE) / nullif({hi} - {lo}, 0)) AS BIGINT), {bins - 1}) END")


ORACLES["a28_hist2d"] = R(f"""
, st AS (SELECT max(CASE WHEN repo_size > 0 THEN log10(CAST(repo_size AS DOUBLE)) END) AS x_hi,
                quantile_cont(CAST(vulnerabilities AS DOUBLE), 0.995) AS y_hi FROM m22),
b AS (SELECT {_bin('CASE WHEN repo_size > 0 THEN log10(CAST(repo_size AS DOUBLE)) END', 'CAST(0 AS DOUBLE)', 'st.x_hi', 50)} AS x_bin,
             {_bin('CAST(vulnerabilities AS DOUBLE)', 'CAST(0 AS DOUBLE)', 'st.y_hi', 50)} AS y_bin FROM m22, st)
SELECT x_bin, y_bin, count(*) AS n FROM b WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL GROUP BY 1, 2""")
ORACLES["a29_hist2d_log"] = R(f"""
, st AS (SELECT min(CASE WHEN repo_size > 0 THEN log10(CAST(repo_size AS DOUBLE)) END) AS x_lo,
                max(CASE WHEN repo_size > 0 THEN log10(CAST(repo_size AS DOUBLE)) END) AS x_hi,
                log10(greatest(min(CAST(vulnerabilities AS DOUBLE)), 0.1)) AS y_lo,
                log10(max(CAST(vulnerabilities AS DOUBLE))) AS y_hi FROM m23),
b AS (SELECT {_bin('CASE WHEN repo_size > 0 THEN log10(CAST(repo_size AS DOUBLE)) END', 'st.x_lo', 'st.x_hi', 49)} AS x_bin,
             {_bin('CASE WHEN vulnerabilities > 0 THEN log10(CAST(vulnerabilities AS DOUBLE)) END', 'st.y_lo', 'st.y_hi', 49)} AS y_bin
      FROM m23, st)
SELECT x_bin, y_bin, count(*) AS n FROM b WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL GROUP BY 1, 2""")
_DEC = """, lx AS (SELECT *, log10(CAST(repo_size AS DOUBLE)) AS lx FROM m22 WHERE repo_size > 0),
ed AS (SELECT quantile_cont(lx, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM lx),
dec AS (SELECT lx.*, 'Q' || CAST(1 + len(list_filter(ed.e, lambda x: x < lx.lx)) AS VARCHAR) AS decile FROM lx, ed)"""
ORACLES["a30_size_decile"] = R(_DEC + """
SELECT repo_size, vulnerabilities, round(avg_cvss, 6) AS avg_cvss, decile FROM dec""")
ORACLES["a31_box_stats"] = R(_DEC + """
, q AS (SELECT decile, quantile_cont(CAST(vulnerabilities AS DOUBLE), 0.25) AS q1,
               quantile_cont(CAST(vulnerabilities AS DOUBLE), 0.5) AS median,
               quantile_cont(CAST(vulnerabilities AS DOUBLE), 0.75) AS q3 FROM dec GROUP BY decile)
SELECT d.decile, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3, count(*) AS n,
       round(min(CASE WHEN vulnerabilities >= q.q1 - 1.5 * (q.q3 - q.q1) THEN CAST(vulnerabilities AS DOUBLE) END), 6)
         AS whisker_low,
       round(max(CASE WHEN vulnerabilities <= q.q3 + 1.5 * (q.q3 - q.q1) THEN CAST(vulnerabilities AS DOUBLE) END), 6)
         AS whisker_high
FROM dec d JOIN q ON d.decile = q.decile GROUP BY d.decile, q.q1, q.median, q.q3""")
ORACLES["a32_upper_cut"] = R("SELECT round(quantile_cont(CAST(vulnerabilities AS DOUBLE), 0.995), 6) AS upper_cut FROM m22")
ORACLES["a33_kde"] = R("""
, st AS (SELECT count(avg_cvss) AS n, stddev_samp(avg_cvss) * pow(CAST(count(avg_cvss) AS DOUBLE), -0.2) AS bw,
                min(avg_cvss) AS lo, max(avg_cvss) AS hi FROM m23),
g AS (SELECT i, st.lo - 2.0 * st.bw + i * ((st.hi - st.lo + 4.0 * st.bw) / 99.0) AS x FROM st, range(100) t(i))
SELECT CAST(g.i AS BIGINT) AS i, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * ((g.x - m.avg_cvss) / st.bw) * ((g.x - m.avg_cvss) / st.bw))
                 / (st.bw * sqrt(2 * pi()))) / st.n, 6) AS density
FROM g, m23 m, st WHERE m.avg_cvss IS NOT NULL GROUP BY g.i, g.x, st.n""")
ORACLES["p34_vuln_density"] = R("SELECT repo_size, vulnerabilities, round(vuln_density, 6) AS vuln_density FROM m23")
ORACLES["p35_log10_col"] = W("""
SELECT repository, round(CASE WHEN size > 0 THEN log10(CAST(size AS DOUBLE)) END, 6) AS log10_size FROM dv_repo""",
                             "dv_repo")
ORACLES["f11_finite"] = R(_LP + " SELECT round(lx, 6) AS lx, round(ly, 6) AS ly FROM lp")

# ---------------------------------------------------------------- URLs and names
PATH_RE = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
NETLOC_RE = r"^(?:[^:/?#]+:)?//([^/?#]*)"


def upath(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '{PATH_RE}', 1)"


def gh_repo(u: str) -> str:
    parts = f"string_split({upath(u)}, '/')"
    return f"CASE WHEN len({parts}) >= 3 THEN {parts}[2] || '/' || {parts}[3] END"


def gh_commit(u: str) -> str:
    parts = f"string_split({upath(u)}, '/')"
    return f"CASE WHEN list_position({parts}, 'commit') > 0 THEN {parts}[list_position({parts}, 'commit') + 1] END"


ORACLES["p01_is_github"] = W("SELECT page_id, coalesce(contains(url, 'github.com'), false) AS is_github FROM dv_ref", "dv_ref")
ORACLES["p02_url_path"] = W(f"SELECT page_id, {upath('url')} AS path FROM dv_ref", "dv_ref")
ORACLES["p03_github_repo"] = W(f"SELECT page_id, {gh_repo('url')} AS repository FROM dv_ref WHERE contains(url, 'github.com')",
                               "dv_ref")
ORACLES["p04_github_commit"] = W(f"SELECT page_id, {gh_commit('url')} AS commit FROM dv_ref WHERE contains(url, 'github.com')",
                                 "dv_ref")
ORACLES["p05_is_patch_url"] = W("""
SELECT page_id, coalesce(contains(url, 'github.com') AND ends_with(url, '.patch'), false) AS is_patch FROM dv_ref""",
                                "dv_ref")
ORACLES["p06_owner_repo"] = W(f"""
, s AS (SELECT page_id, string_split(regexp_replace({upath('url')}, '^/', ''), '/') AS p FROM dv_ref)
SELECT page_id, CASE WHEN len(p) = 2 THEN p[1] END AS owner, CASE WHEN len(p) = 2 THEN p[2] END AS repo FROM s""",
                              "dv_ref")
ORACLES["p07_repo_dir"] = W("SELECT repository, replace(repository, '/', '_') AS dir_name FROM dv_repo", "dv_repo")
ORACLES["p08_repo_from_dir"] = W("""
SELECT replace(repository, '/', '_') || '_x' AS dir_name, replace(replace(repository, '/', '_') || '_x', '_', '/') AS repository
FROM dv_repo""", "dv_repo")
ORACLES["p09_patch_file_name"] = W("""
SELECT cve_id, cve_id || '_' || replace(repository, '/', '_') || '.patch' AS file_name FROM dv_cve""", "dv_cve")
_PN = """'CVE-2024-' || printf('%07d', doc_id) || '_org' || CAST(doc_id % 7 AS VARCHAR) || '_' || source || '.patch'"""
ORACLES["p10_parse_patch_name"] = f"""
WITH p AS (SELECT doc_id, {_PN} AS n FROM documents)
SELECT doc_id, nullif(split_part(n, '_', 1), '') AS cve_id,
       nullif(replace(replace(n, split_part(n, '_', 1) || '_', ''), '.patch', ''), '') AS repo FROM p"""
ORACLES["p11_default_patch_url"] = W(f"""
, s AS (SELECT page_id, url,
               CASE WHEN contains(url, 'github.com') AND ends_with(url, '.patch') THEN url ELSE '' END AS pu,
               {gh_repo('url')} AS repo, {gh_commit('url')} AS sha FROM dv_ref)
SELECT page_id, CASE WHEN page_id % 2 = 0 AND sha IS NOT NULL AND sha <> ''
                     THEN coalesce(nullif(pu, ''), 'https://github.com/' || repo || '/commit/' || sha || '.patch')
                     ELSE pu END AS patch_url FROM s""", "dv_ref")
ORACLES["p12_safe_name"] = r"""
SELECT page_id, coalesce(regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g'), 'unknown_repository') AS safe FROM pages"""
ORACLES["p13_url_file_name"] = f"""
SELECT page_id, regexp_replace(regexp_extract(url, '{NETLOC_RE}', 1) || '_' ||
         replace(regexp_replace({upath('url')}, '^/', ''), '/', '_'), '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') || '.txt'
       AS file_name FROM pages"""
ORACLES["p14_basename"] = W("""
SELECT sha, CAST(l_linenumber AS BIGINT) AS l_linenumber, string_split(filename, '/')[-1] AS basename FROM dv_commit_file""",
                            "dv_commit_file")
ORACLES["p14_extension"] = W(r"""
SELECT sha, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       lower(regexp_extract(string_split(filename, '/')[-1], '^.+(\.[^.]*)$', 1)) AS extension FROM dv_commit_file""",
                             "dv_commit_file")
ORACLES["p16_repo_caption"] = R("""
SELECT repository, 'Repository: ' || repository || '<br>Size: ' || format('{:,}', size) || ' KB<br>Vulnerabilities: '
       || CAST(vuln_count AS VARCHAR) || '<br>Avg CVSS: ' || format('{:,.2f}', round(avg_cvss, 6)) AS caption FROM m20""")

# ---------------------------------------------------------------- commit / repository features
ORACLES["p26_message_features"] = """
SELECT doc_id, split_part(text, chr(10), 1) AS title, CAST(length(text) AS BIGINT) AS length,
       contains(text, chr(10)) AS has_description,
       contains(lower(text), 'fix') OR contains(lower(text), 'close') OR contains(lower(text), 'resolve')
         OR contains(lower(text), 'issue') OR contains(lower(text), '#') AS references_issue
FROM documents"""


def _any(col: str, pats: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{p}')" for p in pats) + ")"


_SEC = ["security", "auth", "crypto", "password", "secret", "key"]
_CFG = ["config", "settings", ".env", ".ini", ".yml", ".json"]
_DEP = ["requirements.txt", "package.json", "gemfile", "cargo.toml"]
_PAT = f"""count_if({_any('filename', _SEC)}) AS security_files, count_if({_any('filename', _CFG)}) AS config_files,
       count_if({_any('filename', _DEP)}) AS dependency_files, count_if({_any('filename', ['test'])}) AS test_files"""
_DIR = r"""count(DISTINCT CASE WHEN contains(filename, '/') THEN regexp_extract(filename, '^(.*)/[^/]*$', 1) ELSE '.' END)
         AS unique_directories,
       coalesce(max(len(list_filter(string_split(filename, '/'), lambda x: x <> '')) - 1), 0) AS max_directory_depth"""
ORACLES["p27_file_pattern_counts"] = W(f"SELECT sha, {_PAT} FROM dv_commit_file GROUP BY sha", "dv_commit_file")
ORACLES["p28_dir_features"] = W(f"SELECT sha, {_DIR} FROM dv_commit_file GROUP BY sha", "dv_commit_file")
ORACLES["p29_changed_files"] = W("""
SELECT sha, CAST(l_linenumber AS BIGINT) AS l_linenumber, filename, status, round(additions, 6) AS additions,
       CAST(deletions AS BIGINT) AS deletions, patch FROM dv_commit_file""", "dv_commit_file")
ORACLES["p30_author_stats"] = W("""
SELECT 'user' || CAST(user_id AS VARCHAR) AS login, CAST(sum(c) AS BIGINT) AS total_commits,
       round(sum(c) / count(*), 6) AS average_weekly_commits, round(sum(a), 6) AS total_additions,
       round(sum(d), 6) AS total_deletions, count_if(c > 0) AS weeks_active
FROM dv_weeks GROUP BY user_id""", "dv_weeks")
ORACLES["p31_commit_activity"] = W("""
SELECT 'repo' || CAST(user_id AS VARCHAR) AS repository, CAST(sum(c) AS BIGINT) AS total_commits_last_year,
       round(sum(c) / CAST(52 AS DOUBLE), 6) AS avg_commits_per_week, count_if(c > 0) AS days_active_last_year
FROM dv_weeks GROUP BY user_id""", "dv_weeks")
ORACLES["a40_weekly_totals"] = W("""
SELECT user_id, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, CAST(sum(c) AS BIGINT) AS c, round(sum(a), 6) AS a,
       round(sum(d), 6) AS d, count_if(c > 0) AS days_active
FROM dv_weeks GROUP BY 1, 2""", "dv_weeks")
ORACLES["p32_repo_features"] = """
WITH br AS (SELECT o_custkey AS k, string_agg('b' || o_orderkey, ',' ORDER BY 'b' || o_orderkey) AS names
            FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus = 'F' GROUP BY 1),
act AS (SELECT user_id AS k, count(*) AS total, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1)
SELECT 'org' || (c_custkey % 97) || '/repo' || c_custkey AS repository, 'repo' || c_custkey AS name,
       'org' || (c_custkey % 97) AS owner,
       CAST(DATE '2015-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS VARCHAR) || 'T00:00:00Z' AS created_at,
       CAST(DATE '2015-01-01' + CAST(c_custkey % 1000 + 30 AS INTEGER) AS VARCHAR) || 'T00:00:00Z' AS updated_at,
       CAST(DATE '2015-01-01' + CAST(c_custkey % 1000 + 60 AS INTEGER) AS VARCHAR) || 'T00:00:00Z' AS pushed_at,
       CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS size, c_custkey * 7 % 1000 AS stars, c_custkey * 3 % 200 AS forks,
       c_custkey % 50 AS open_issues, c_custkey * 11 % 1000 AS watchers,
       c_custkey % 2 = 0 AND c_custkey % 6 <> 0 AS has_security_policy,
       CASE c_custkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'main' ELSE 'develop' END AS default_branch,
       coalesce(br.names, '') AS protected_branches,
       CASE WHEN c_custkey % 4 <> 0 THEN 'C:' || (c_custkey * 13 % 5000) || ',Python:' || (c_custkey * 17 % 7000) END AS languages,
       coalesce(act.total, 0) AS total_commits_last_year,
       round(coalesce(act.total, 0) / CAST(52 AS DOUBLE), 6) AS avg_commits_per_week,
       coalesce(act.days, 0) AS days_active_last_year, br.k IS NOT NULL AS has_protected_branches,
       c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AS has_wiki, c_custkey % 5 <> 0 AND c_custkey % 2 = 1 AS has_issues,
       c_custkey % 4 = 0 OR c_custkey % 3 = 0 AS allow_forking, c_custkey % 12 = 0 AS is_template,
       CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) END AS license
FROM customer LEFT JOIN br ON br.k = c_custkey LEFT JOIN act ON act.k = c_custkey"""
ORACLES["p33_commit_features"] = W(f"""
, fl AS (SELECT l_orderkey, CAST(sum(CAST(additions AS BIGINT)) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
                count(*) AS n_files, {_PAT}, {_DIR},
                md5(string_agg(concat_ws('|', filename, status, CAST(additions AS BIGINT), deletions, patch), ';'
                    ORDER BY concat_ws('|', filename, status, CAST(additions AS BIGINT), deletions, patch))) AS files_md5
         FROM dv_commit_file GROUP BY l_orderkey),
st AS (SELECT 'user' || user_id AS login, CAST(sum(c) AS BIGINT) AS total_commits,
              round(sum(c) / count(*), 6) AS average_weekly_commits, count_if(c > 0) AS weeks_active FROM dv_weeks GROUP BY user_id),
m AS (SELECT o.*, md5(CAST(o_orderkey AS VARCHAR)) AS sha, CASE WHEN o_custkey % 10 <> 0 THEN 'user' || (o_custkey % 200) END AS login,
             CASE o_orderkey % 3 WHEN 0 THEN 'Fixes #' || o_orderkey WHEN 1 THEN o_orderpriority || chr(10) || chr(10) || 'Details of ' || o_orderkey
                  ELSE 'Update ' || o_orderstatus END AS msg
      FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM fl)),
near AS (SELECT sha, string_agg(sha, ',') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, sha ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
                AS surrounding FROM m)
SELECT 'org' || (o_custkey % 97) || '/repo' || o_custkey AS repository, m.sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS commit_date,
       m.login, CASE WHEN m.login IS NULL THEN NULL WHEN o_custkey % 9 = 0 THEN 'Bot' ELSE 'User' END AS type,
       st.total_commits, st.average_weekly_commits, st.weeks_active, split_part(msg, chr(10), 1) AS title,
       CAST(length(msg) AS BIGINT) AS length, contains(msg, chr(10)) AS has_description,
       {_any('msg', ['fix', 'close', 'resolve', 'issue', '#'])} AS references_issue,
       fl.* EXCLUDE (l_orderkey), additions + deletions AS total, near.surrounding
FROM m JOIN fl ON fl.l_orderkey = m.o_orderkey LEFT JOIN st ON st.login = m.login JOIN near ON near.sha = m.sha""",
                                   "dv_commit_file", "dv_weeks")

# ---------------------------------------------------------------- joins, state, windows
_FIX = """, cf AS (SELECT *, CASE WHEN has_commit THEN md5(CAST(cve_key AS VARCHAR)) END AS fix_commit,
               CASE WHEN has_commit THEN 'https://github.com/' || repository || '/commit/' || md5(CAST(cve_key AS VARCHAR))
                    || '.patch' END AS patch_url FROM dv_cve),
cm AS (SELECT 'org' || CAST(o.o_custkey % 97 AS VARCHAR) || '/repo' || CAST(o.o_custkey AS VARCHAR) AS repository, p.*
       FROM (SELECT sha, l_orderkey, count(*) AS n_files, sum(additions) AS additions, max(commit_date) AS commit_date
             FROM dv_commit_file GROUP BY sha, l_orderkey) p JOIN orders o ON p.l_orderkey = o.o_orderkey),
ps AS (SELECT cve_id AS key, CASE cve_key % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed: x' WHEN 2 THEN 'started'
              ELSE 'failed' END AS status FROM dv_cve),
refs AS (SELECT *, 'CVE-' || CAST(cve_key AS VARCHAR) AS cve_id FROM dv_ref)"""


def J(sql: str, *extra: str) -> str:
    return W(_FIX + "\n" + sql, "dv_cve", "dv_commit_file", "dv_ref", "dv_state", "dv_repo", *extra)


ORACLES["j02_join_commit"] = J("""
SELECT c.cve_id, c.fix_commit, m.n_files, round(m.additions, 6) AS additions, coalesce(m.commit_date, c.fix_date) AS fix_date
FROM cf c LEFT JOIN cm m ON c.repository = m.repository AND c.fix_commit = m.sha""")
ORACLES["j03_new_only"] = J("""
SELECT cve_id, repository FROM dv_cve WHERE cve_id NOT IN
  (SELECT cve_id FROM dv_cve WHERE published_date < TIMESTAMP '1997-01-01 00:00:00')""")
_WL = """SELECT cve_id, repository FROM cf WHERE patch_url IS NOT NULL AND patch_url <> ''
  AND repository IN (SELECT key FROM dv_state WHERE status = 'success')"""
ORACLES["j04_patch_worklist"] = J(_WL)
_PEND = """SELECT cve_id FROM cf WHERE patch_url IS NOT NULL
  AND cve_id NOT IN (SELECT key FROM ps WHERE status IN ('success', 'failed'))"""
ORACLES["j05_pending"] = J(_PEND)
_CLONE = """SELECT DISTINCT repository FROM dv_cve WHERE repository IS NOT NULL AND repository <> ''
  AND replace(repository, '/', '_') NOT IN (SELECT replace(repository, '/', '_') FROM dv_repo WHERE c_custkey % 5 = 0)
  AND repository NOT IN (SELECT key FROM dv_state WHERE c_custkey % 3 = 0)"""
ORACLES["j06_clone_worklist"] = J(_CLONE)
ORACLES["j07_unscraped"] = J("""
SELECT r.cve_id, r.url, r.page_id FROM refs r
WHERE NOT EXISTS (SELECT 1 FROM refs i WHERE i.page_id % 3 = 0 AND i.cve_id = r.cve_id AND i.url = r.url)""")
ORACLES["j10_join_author"] = W("""
, c AS (SELECT sha, 'user' || regexp_replace(repository, '^repo', '') AS login FROM dv_event_commit),
w AS (SELECT 'user' || CAST(user_id AS VARCHAR) AS login, day, c, a FROM dv_weeks),
f AS (SELECT login, arg_min(c, day) AS c, arg_min(a, day) AS a FROM w GROUP BY login)
SELECT c.sha, c.login, CAST(f.c AS BIGINT) AS c, round(f.a, 6) AS a FROM c LEFT JOIN f ON c.login = f.login""",
                               "dv_event_commit", "dv_weeks")
ORACLES["j11_join_scraped"] = J("""
, s AS (SELECT r.cve_id, r.url, md5(p.html) AS text_md5 FROM refs r JOIN pages p ON r.page_id = p.page_id
        WHERE r.page_id % 2 = 0)
SELECT r.cve_id, r.url, r.page_id, s.text_md5 FROM refs r LEFT JOIN s ON r.cve_id = s.cve_id AND r.url = s.url""")
ORACLES["j12_upsert_state"] = J("""
SELECT o.key, CASE WHEN o.c_custkey % 5 = 0 THEN 'success' ELSE o.status END AS status FROM dv_state o""")
ORACLES["j14_join_patch_cve"] = J(f"""
, p AS (SELECT doc_id, nullif(split_part({_PN}, '_', 1), '') AS cve_id FROM documents)
SELECT p.doc_id, p.cve_id, c.repository FROM p
LEFT JOIN (SELECT 'CVE-2024-' || printf('%07d', cve_key) AS cve_id, repository FROM dv_cve WHERE cve_key % 2 = 0) c ON p.cve_id = c.cve_id""")
_ENH = """, e AS (SELECT c.cve_id, r.size, m.n_files, CASE WHEN m.sha IS NOT NULL THEN m.commit_date ELSE c.fix_date END AS fix_date,
               'enhanced' AS processing_status FROM cf c
        LEFT JOIN (SELECT repository, size FROM dv_repo WHERE c_custkey % 2 = 0) r ON c.repository = r.repository
        LEFT JOIN cm m ON c.repository = m.repository AND c.fix_commit = m.sha)"""
ORACLES["j17_enhance"] = J(_ENH + " SELECT * FROM e")
ORACLES["f08_needs_enrichment"] = J("""
SELECT c.cve_id FROM cf c LEFT JOIN (SELECT repository, size FROM dv_repo WHERE c_custkey % 2 = 0) r
  ON c.repository = r.repository
WHERE NOT ends_with(c.cve_id, '0')""")
ORACLES["a37_state_summary"] = J("""
SELECT count_if(status = 'success') AS success, count_if(status <> 'success') AS failed FROM dv_state""")
ORACLES["a38_run_counts"] = J(f"""
SELECT 'clone_worklist' AS name, count(*) AS n FROM ({_CLONE})
UNION ALL SELECT 'patch_worklist', count(*) FROM ({_WL})
UNION ALL SELECT 'patch_pending', count(*) FROM ({_PEND})""")
ORACLES["a39_latest_result"] = """
SELECT user_id AS key, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value
FROM events GROUP BY user_id"""
ORACLES["e01_distinct_repos"] = W("SELECT DISTINCT repository FROM dv_cve WHERE repository IS NOT NULL AND repository <> ''",
                                  "dv_cve")
ORACLES["f12_urls_of"] = J("SELECT cve_id, page_id, url FROM refs WHERE url IS NOT NULL AND url <> ''")
ORACLES["f13_first_per_key"] = W("SELECT cve_key, min(pos) AS pos, arg_min(url, pos) AS url FROM dv_ref GROUP BY cve_key",
                                 "dv_ref")
ORACLES["f14_last_per_key"] = W("""
, f AS (SELECT string_split(filename, '/')[-1] AS basename, l_orderkey, l_linenumber, filename, additions FROM dv_commit_file),
r AS (SELECT *, row_number() OVER (PARTITION BY basename ORDER BY l_orderkey DESC, l_linenumber DESC, filename DESC,
                                   additions DESC) AS rn FROM f)
SELECT basename, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, filename, round(additions, 6) AS additions
FROM r WHERE rn = 1""", "dv_commit_file")
ORACLES["f15_surrounding_commits_intended"] = W("""
SELECT sha, string_agg(sha, ',') OVER (PARTITION BY repository ORDER BY commit_ts, sha
                                      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS surrounding
FROM dv_event_commit""", "dv_event_commit")
ORACLES["f15_surrounding_commits_reference"] = W("""
, r AS (SELECT repository, sha, row_number() OVER (PARTITION BY repository ORDER BY commit_ts DESC, sha DESC) AS rn
        FROM dv_event_commit),
t AS (SELECT repository, string_agg(sha, ',' ORDER BY rn) AS surrounding FROM r WHERE rn <= 5 GROUP BY repository)
SELECT c.sha, t.surrounding FROM dv_event_commit c LEFT JOIN t ON c.repository = t.repository""", "dv_event_commit")

# ---------------------------------------------------------------- patch / reply / snippet text
_LINES = """, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                unnest(range(len(string_split(text, chr(10))))) AS pos FROM dv_patch)"""
ORACLES["x01_patch_paths"] = W(_LINES + r"""
, p AS (SELECT doc_id, regexp_replace(substr(line, 7), '^\s+|\s+$', '', 'g') AS path, pos FROM ln
        WHERE starts_with(line, '--- a/') OR starts_with(line, '+++ b/'))
SELECT doc_id, path, min(pos) AS first_pos FROM p WHERE path <> '' AND path <> '/dev/null' GROUP BY 1, 2""", "dv_patch")
ORACLES["x01_patch_paths_parity"] = W(_LINES + r"""
, p AS (SELECT doc_id, regexp_replace(string_split(line, ' ')[2], '^\s+|\s+$', '', 'g') AS path, pos FROM ln
        WHERE starts_with(line, '--- a/') OR starts_with(line, '+++ b/'))
SELECT doc_id, path, min(pos) AS first_pos FROM p WHERE path <> '' AND path <> '/dev/null' GROUP BY 1, 2""", "dv_patch")
_DOCLINES = """, dl AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""
ORACLES["x02_patch_lines"] = _DOCLINES.replace(", dl AS", "WITH dl AS") + """
SELECT doc_id, CAST(i + 3 AS BIGINT) AS pos, source || '/f' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(1 AS BIGINT) AS hunk,
       [' ', '-', '+'][i % 3 + 1] AS sign,
       CASE WHEN i % 3 <> 2 THEN CAST(1 + i - i // 3 AS BIGINT) END AS old_no,
       CASE WHEN i % 3 <> 1 THEN CAST(1 + i - (i + 1) // 3 AS BIGINT) END AS new_no,
       line AS text
FROM dl"""
_FJ = """, fj AS (SELECT doc_id, reply, instr(reply, '```json') AS s,
                CASE WHEN instr(reply, '```json') > 0 THEN instr(substr(reply, instr(reply, '```json') + 7), '```') ELSE 0 END AS e
         FROM dv_reply),
fb AS (SELECT doc_id, reply, CASE WHEN s > 0 AND e > 0 THEN regexp_replace(substr(reply, s + 7, e - 1), '^\\s+|\\s+$', '', 'g') END AS body
       FROM fj)"""
ORACLES["x03_fenced_json"] = W(_FJ + """
SELECT doc_id, body, CASE WHEN body IS NULL THEN 'no_markers' WHEN body = '' THEN 'empty' ELSE 'ok' END AS status FROM fb""",
                               "dv_reply")
ORACLES["x04_fenced_json_or_all"] = W(r"""
SELECT doc_id, CASE WHEN regexp_matches(reply, '(?s)```json\s*(.*?)\s*```') THEN regexp_extract(reply, '(?s)```json\s*(.*?)\s*```', 1)
                    ELSE reply END AS json_text FROM dv_reply""", "dv_reply")
_PF = _FJ + """
, pf AS (SELECT doc_id, body,
               CASE WHEN body IS NULL THEN 'no_markers' WHEN body = '' THEN 'empty'
                    WHEN NOT json_valid(body) THEN 'bad_json'
                    WHEN json_type(CASE WHEN json_valid(body) THEN body END) <> 'ARRAY' THEN 'not_list'
                    WHEN NOT coalesce(list_bool_and(list_transform(json_extract(CASE WHEN json_valid(body) THEN body END, '$[*]'),
                                                                   lambda x: json_type(x) = 'OBJECT')), true)
                      THEN 'item_not_dict'
                    ELSE 'ok' END AS status FROM fb)"""
ORACLES["x05_parse_findings"] = W(_PF + """
SELECT doc_id, status, CASE WHEN status = 'ok' THEN CAST(json_array_length(body) AS BIGINT) END AS n_items,
       CASE WHEN status = 'ok' THEN json_extract_string(body, '$[0].file_path') END AS first_path,
       CASE WHEN status = 'ok' THEN array_to_string(CAST(json_extract(body, '$[0].line_numbers') AS INTEGER[]), ',') END AS first_lines
FROM pf""", "dv_reply")
ORACLES["x06_correction_prompt"] = W(_PF + """
SELECT doc_id, CASE WHEN status <> 'ok' THEN
         'The reply for ' || 'CVE-2024-' || printf('%07d', doc_id) || ' could not be used (' || status || '). ' ||
         CASE WHEN status = 'bad_json' THEN 'The JSON syntax is invalid; return well-formed JSON. '
              ELSE 'The JSON structure is wrong; return a list of objects with ''file_path'' and ''line_numbers''. ' END ||
         CASE WHEN body IS NOT NULL AND body <> '' THEN 'Rejected text: `' || body || '`. ' ELSE '' END ||
         'Answer again with the JSON alone inside ```json and ``` markers.' END AS prompt
FROM pf""", "dv_reply")
ORACLES["x07_parse_intent"] = W(r"""
, r AS (SELECT doc_id, CASE doc_id % 3
          WHEN 0 THEN '{"malicious_intent_likely": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "reason": "' || lang || '"}'
          WHEN 1 THEN 'Result:' || chr(10) || '```json' || chr(10) || '{"malicious_intent_likely": ' ||
                      CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "reason": "' || lang || '"}' || chr(10) || '```'
          ELSE description END AS reply FROM dv_desc),
b AS (SELECT doc_id, reply, CASE WHEN regexp_matches(reply, '(?s)```json\s*(.*?)\s*```')
                                 THEN regexp_extract(reply, '(?s)```json\s*(.*?)\s*```', 1) ELSE reply END AS body FROM r),
v AS (SELECT doc_id, reply, CASE WHEN json_valid(body) THEN body END AS v FROM b),
o AS (SELECT doc_id, reply, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS o FROM v)
SELECT doc_id,
       CASE WHEN o IS NOT NULL THEN coalesce(CAST(json_extract(o, '$.malicious_intent_likely') AS BOOLEAN), false)
            ELSE false END AS malicious_intent_likely,
       CASE WHEN o IS NOT NULL THEN json_extract_string(o, '$.reason')
            ELSE 'Could not parse model JSON output: ' || reply END AS reason
FROM o""", "dv_desc")


def _safe(x: str, null: str = "unknown_repository") -> str:
    return f"coalesce(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), '{null}')"


_PN2 = """, pn AS (SELECT doc_id, path, nullif(split_part(file_name, '_', 1), '') AS cve,
               nullif(replace(replace(file_name, split_part(file_name, '_', 1) || '_', ''), '.patch', ''), '') AS repo FROM dv_patch)"""
ORACLES["x08_finding_prompt"] = W(_PN2 + f"""
SELECT doc_id, 'Identify the vulnerable lines fixed for ' || {_safe('cve', '')} || ' in repository ' || {_safe('repo')} ||
       '. Answer with a JSON list of {{"file_path", "line_numbers"}} inside ```json and ```.' AS prompt FROM pn""", "dv_patch")
ORACLES["x09_path_prompt"] = W(_PN2 + f"""
SELECT doc_id, 'The file ' || path || ' was not found in ' || {_safe('repo')} || ' for ' || {_safe('cve', '')} ||
       '. Give the correct path and line numbers as JSON inside ```json and ```.' AS prompt FROM pn""", "dv_patch")
_BL = """WITH b AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE sha1(CAST(event_id AS VARCHAR)) END AS h FROM events)"""
ORACLES["x12_parse_blame"] = _BL + " SELECT event_id, coalesce(h, 'parse_error') AS commit FROM b"
ORACLES["x13_is_valid_commit"] = _BL + " SELECT event_id, h IS NOT NULL AS is_valid FROM b"
ORACLES["x14_cut_snippet"] = """
WITH s AS (SELECT doc_id, string_split(content_n, chr(10)) AS raw FROM
             (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content_n FROM documents)),
l AS (SELECT doc_id, CASE WHEN raw[-1] = '' THEN raw[1:len(raw) - 1] ELSE raw END AS lines,
             CAST(doc_id % 5 + 1 AS INTEGER) AS lo, CAST(doc_id % 5 + 3 AS INTEGER) AS hi FROM s),
r AS (SELECT doc_id, lines, lo, hi, greatest(0, lo - 1 - 2) AS st, least(len(lines), hi + 3) AS en FROM l)
SELECT doc_id, CASE WHEN en > st THEN array_to_string(list_transform(lines[st + 1:en], lambda x, i:
         printf('%s%4d: %s', CASE WHEN st + i = lo OR st + i = hi THEN 'VULN> ' ELSE '      ' END, st + i, x)), chr(10)) END AS code
FROM r"""
_SNIP = _PF + """
, d AS (SELECT doc_id, source FROM documents),
f AS (SELECT 'CVE-2024-' || printf('%07d', pf.doc_id) AS cve_id, d.source AS repo_name, pf.doc_id,
             json_extract_string(body, '$[0].file_path') AS file_path,
             CAST(json_extract(body, '$[0].line_numbers') AS INTEGER[]) AS line_numbers,
             CASE WHEN pf.doc_id % 11 = 0 THEN NULL WHEN pf.doc_id % 5 = 0 THEN 'blame_error' ELSE md5(CAST(pf.doc_id AS VARCHAR)) END AS first_sha
      FROM pf JOIN d ON pf.doc_id = d.doc_id WHERE pf.status = 'ok' AND json_array_length(body) > 0),
f9 AS (SELECT * FROM f WHERE file_path IS NOT NULL AND file_path <> '' AND len(line_numbers) > 0 AND first_sha IS NOT NULL),
f10 AS (SELECT * FROM f9 WHERE first_sha NOT IN ('blame_error', 'parse_error', 'timeout_error', 'git_not_found', 'exception_error')
                             AND first_sha <> ''),
j AS (SELECT f10.*, s.content FROM f10 LEFT JOIN dv_snapshot s ON f10.repo_name = s.repo_name
        AND f10.first_sha = md5(CAST(s.doc_id AS VARCHAR)) AND f10.file_path = s.path),
cut AS (SELECT *, CASE WHEN content IS NULL THEN NULL ELSE
          (SELECT CASE WHEN en > st THEN array_to_string(list_transform(ls[st + 1:en], lambda x, i:
             printf('%s%4d: %s', CASE WHEN list_contains(line_numbers, st + i) THEN 'VULN> ' ELSE '      ' END, st + i, x)), chr(10)) END
           FROM (SELECT ls, greatest(0, list_min(line_numbers) - 3) AS st, least(len(ls), list_max(line_numbers) + 3) AS en
                 FROM (SELECT CASE WHEN string_split(content, chr(10))[-1] = '' THEN string_split(content, chr(10))[1:-2]
                                   ELSE string_split(content, chr(10)) END AS ls))) END AS code FROM j),
sn AS (SELECT * FROM cut WHERE code IS NOT NULL)"""


def S(sql: str) -> str:
    return W(_SNIP + "\n" + sql, "dv_reply", "dv_snapshot")


ORACLES["f09_complete_snippets"] = S("SELECT cve_id, file_path FROM f9")
ORACLES["f10_first_commit"] = S("SELECT cve_id, first_sha AS introducing_commit FROM f10")
ORACLES["j15_join_content"] = S("SELECT cve_id, file_path, md5(content) AS content_md5 FROM j")
ORACLES["x15_snippet_metadata"] = S("""
SELECT cve_id, file_path, array_to_string(line_numbers, ',') AS line_numbers, first_sha AS introducing_commit,
       'vulnerable' AS label, code FROM sn""")
_MANY = """, ms AS (SELECT substr(cve_id, 1, 15) AS cve_id, string_split(file_path, '.')[1] ||
             CASE WHEN cve_id[16] < '4' THEN '.c' WHEN cve_id[16] < '7' THEN '.PY' ELSE '' END AS file_path FROM sn)"""
ORACLES["a34_snippets_per_cve"] = S(_MANY + """
SELECT c.cve_id, coalesce(n.n, 0) AS n_snippets
FROM (SELECT DISTINCT substr('CVE-2024-' || printf('%07d', doc_id), 1, 15) AS cve_id FROM documents) c
LEFT JOIN (SELECT cve_id, count(*) AS n FROM ms GROUP BY cve_id) n ON c.cve_id = n.cve_id""")
ORACLES["a35_snippets_per_extension"] = S(_MANY + r"""
SELECT lower(regexp_extract(string_split(file_path, '/')[-1], '^.+(\.[^.]*)$', 1)) AS extension, count(*) AS n FROM ms GROUP BY 1""")
ORACLES["a35_snippets_per_extension_parity"] = S("SELECT '.txt' AS extension, count(*) AS n FROM sn")
ORACLES["a36_list_snippets"] = S(_MANY + """
SELECT cve_id, string_split(file_path, '/')[-1] || '.txt' AS file,
       row_number() OVER (PARTITION BY cve_id ORDER BY string_split(file_path, '/')[-1] || '.txt', file_path) AS rank FROM ms""")
ORACLES["j08_commit_before"] = W("""
, e AS (SELECT *, CAST(substr(repository, 5) AS BIGINT) % 3 = 0 AS only_master FROM dv_event_commit),
c AS (SELECT event_id, repository, commit_ts AS published FROM e WHERE event_type IN ('signup', 'error')),
b AS (SELECT repository, sha, commit_ts, CASE WHEN event_type = 'view' THEN 'develop' WHEN event_type = 'click' AND NOT only_master THEN 'main' ELSE 'master' END AS branch
      FROM e WHERE event_type IN ('view', 'click', 'purchase')),
h AS (SELECT DISTINCT repository FROM b WHERE branch = 'main'),
m AS (SELECT b.repository, max(sha) AS sha, commit_ts FROM b LEFT JOIN h ON h.repository = b.repository
      WHERE branch = CASE WHEN h.repository IS NULL THEN 'master' ELSE 'main' END GROUP BY b.repository, commit_ts)
SELECT c.event_id, m.sha AS commit_before FROM c ASOF LEFT JOIN m ON c.repository = m.repository AND c.published >= m.commit_ts""",
                                 "dv_event_commit")
ORACLES["j09_introducing_commits"] = _DOCLINES.replace(", dl AS", "WITH dl AS") + r"""
, x AS (SELECT doc_id, CAST(i + 3 AS BIGINT) AS pos, source AS repo, 'f' || CAST(doc_id % 13 AS VARCHAR) || '.txt' AS file,
               TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS ts, md5(CAST(doc_id AS VARCHAR)) AS sha,
               i % 3 AS k, line AS text, true AS ok FROM dl),
r AS (SELECT * FROM x WHERE k = 1), a AS (SELECT * FROM x WHERE k = 2 AND ok)
SELECT r.doc_id, r.pos, CASE WHEN r.ok THEN coalesce(a.sha, 'blame_error') ELSE 'blame_error' END AS introducing_commit
FROM r ASOF LEFT JOIN a ON r.repo = a.repo AND r.file = a.file AND r.text = a.text AND r.ts > a.ts"""

# ---------------------------------------------------------------- planned analyses
_F6 = ["repository", "cvss_score", "cwe_id", "attack_vector", "attack_complexity", "fix_date"]
C = lambda sql: W(sql, "dv_cve")
ORACLES["k01_missing_pct"] = C("SELECT cve_id, round((" + " + ".join(f"CAST({f} IS NULL AS INTEGER)" for f in _F6)
                               + ") * CAST(100 AS DOUBLE) / 6, 6) AS pct_missing FROM dv_cve")
ORACLES["k02_missing_report"] = C("\nUNION ALL\n".join(
    f"SELECT '{f}' AS field, count_if({f} IS NULL) AS n_missing, round(count_if({f} IS NULL) * CAST(100 AS DOUBLE) / count(*), 6) AS pct FROM dv_cve"
    for f in _F6))
ORACLES["k03_cwe_distribution"] = C("SELECT cwe_id, count(*) AS n FROM dv_cve GROUP BY cwe_id")
ORACLES["k04_vector_cube"] = C("""
SELECT attack_vector, attack_complexity, count(*) AS n, CAST(grouping(attack_vector, attack_complexity) AS BIGINT) AS level
FROM dv_cve GROUP BY CUBE (attack_vector, attack_complexity)""")
ORACLES["k05_score_by_vector"] = C("""
SELECT attack_vector, count(cvss_score) AS n, round(avg(cvss_score), 6) AS mean_score, round(stddev_samp(cvss_score), 6) AS std_score,
       round(median(cvss_score), 6) AS median_score FROM dv_cve GROUP BY attack_vector""")
ORACLES["k06_time_to_fix"] = C("""
SELECT count(*) AS n, round(avg(date_diff('day', CAST(published_date AS DATE), CAST(fix_date AS DATE))), 6) AS mean_days,
       round(median(date_diff('day', CAST(published_date AS DATE), CAST(fix_date AS DATE))), 6) AS median_days
FROM dv_cve WHERE fix_date IS NOT NULL""")
ORACLES["k07_seasonal"] = C("SELECT CAST(month(published_date) AS BIGINT) AS month, count(*) AS n FROM dv_cve GROUP BY 1")
ORACLES["k08_hot_periods"] = W("""
, o AS (SELECT repository, commit_ts, CASE WHEN commit_ts - lag(commit_ts) OVER (PARTITION BY repository ORDER BY commit_ts)
                                          < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM dv_event_commit),
s AS (SELECT repository, commit_ts, sum(brk) OVER (PARTITION BY repository ORDER BY commit_ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT repository, min(commit_ts) AS start, max(commit_ts) + INTERVAL 6 HOUR AS "end", count(*) AS n
FROM s GROUP BY repository, sid HAVING count(*) >= 3""", "dv_event_commit")
ORACLES["k09_by_language"] = W("""
SELECT r.license AS language, count(*) AS n FROM dv_cve c JOIN dv_repo r ON c.repository = r.repository GROUP BY 1""",
                               "dv_cve", "dv_repo")
ORACLES["k10_file_types"] = W(r"""
SELECT lower(regexp_extract(string_split(filename, '/')[-1], '^.+(\.[^.]*)$', 1)) AS extension, count(*) AS n
FROM dv_commit_file GROUP BY 1""", "dv_commit_file")
ORACLES["k11_top_directories"] = W(r"""
SELECT CASE WHEN contains(filename, '/') THEN regexp_extract(filename, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, count(*) AS n
FROM dv_commit_file GROUP BY 1 ORDER BY n DESC, directory LIMIT 10""", "dv_commit_file")
_CS = """, cs AS (SELECT f.sha, count(*) AS n_files, sum(additions) AS additions FROM dv_commit_file f GROUP BY f.sha),
fx AS (SELECT DISTINCT md5(CAST(cve_key AS VARCHAR)) AS sha FROM dv_cve WHERE has_commit),
k AS (SELECT cs.*, fx.sha IS NOT NULL AS is_fix FROM cs LEFT JOIN fx ON cs.sha = fx.sha)"""
ORACLES["k12_files_fix_vs_other"] = W(_CS + " SELECT is_fix, count(*) AS n, round(avg(n_files), 6) AS mean_files FROM k GROUP BY is_fix",
                                      "dv_cve", "dv_commit_file")
ORACLES["k13_patch_size"] = W(_CS + """
SELECT round(quantile_cont(additions, 0.25), 6) AS p25, round(quantile_cont(additions, 0.5), 6) AS p50,
       round(quantile_cont(additions, 0.75), 6) AS p75, round(quantile_cont(additions, 0.9), 6) AS p90 FROM k""",
                              "dv_cve", "dv_commit_file")
ORACLES["k14_common_words"] = r"""
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 1 GROUP BY word ORDER BY n DESC, word LIMIT 20"""
ORACLES["k15_commits_per_fix"] = W(f"""
, per AS (SELECT cve_key, count_if(contains(url, 'github.com') AND {gh_commit('url')} IS NOT NULL) AS n_commits
          FROM dv_ref GROUP BY cve_key)
SELECT n_commits, count(*) AS n_cves FROM per GROUP BY n_commits""", "dv_ref")
ORACLES["k16_score_histogram"] = C("""
SELECT CAST(floor(cvss_score) AS BIGINT) AS bucket, count(*) AS n FROM dv_cve WHERE cvss_score IS NOT NULL GROUP BY 1""")
ORACLES["k16_score_stats"] = C("""
, m AS (SELECT avg(cvss_score) AS mu FROM dv_cve)
SELECT round(quantile_cont(cvss_score, 0.1), 6) AS p10, round(median(cvss_score), 6) AS p50,
       round(quantile_cont(cvss_score, 0.9), 6) AS p90,
       round(avg(pow(cvss_score - m.mu, 3)) / pow(avg(pow(cvss_score - m.mu, 2)), 1.5), 6) AS skewness
FROM dv_cve, m""")
ORACLES["k17_score_correlations"] = C("""
SELECT round(corr(cvss_score, CAST(date_diff('day', CAST(published_date AS DATE), CAST(fix_date AS DATE)) AS DOUBLE)), 6)
         AS corr_days_to_fix,
       round(corr(cvss_score, CAST(cve_key AS DOUBLE)), 6) AS corr_cve_key FROM dv_cve""")
ORACLES["k18_tag_distribution"] = W("SELECT unnest(tags) AS tag, count(*) AS n FROM dv_ref GROUP BY 1", "dv_ref")
ORACLES["k19_refs_vs_score"] = W("""
, n AS (SELECT cve_key, count(*) AS n_refs, count_if(contains(url, 'github.com')) AS n_github FROM dv_ref GROUP BY cve_key)
SELECT round(corr(c.cvss_score, CAST(n.n_refs AS DOUBLE)), 6) AS corr_n_refs,
       round(corr(c.cvss_score, CAST(n.n_github AS DOUBLE)), 6) AS corr_n_github FROM dv_cve c JOIN n ON c.cve_key = n.cve_key""",
                                 "dv_cve", "dv_ref")
ORACLES["k20_exploit_share"] = W("""
, per AS (SELECT cve_key, max(CAST(list_contains(tags, 'Exploit') AS INTEGER)) AS h FROM dv_ref GROUP BY cve_key)
SELECT count(*) AS n_cves, round(avg(h) * 100, 6) AS pct_exploit FROM per""", "dv_ref")
ORACLES["k21_top_hosts"] = f"""
SELECT lower(regexp_extract(regexp_extract(url, '{NETLOC_RE}', 1), '^(?:[^@]*@)?([^:]*)', 1)) AS host, count(*) AS n
FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10"""
ORACLES["k22_balanced_sample"] = C(f"""
, s AS (SELECT cve_id, cvss_score, coalesce({sev('cvss_score')}, 'Unknown') AS stratum,
               row_number() OVER (PARTITION BY coalesce({sev('cvss_score')}, 'Unknown') ORDER BY md5(cve_id)) AS rn FROM dv_cve)
SELECT cve_id, round(cvss_score, 6) AS cvss_score, stratum FROM s WHERE rn <= 25""")

# ---------------------------------------------------------------- CVE record (P17-P21), intent
ORACLES["p17_flatten_cve"] = C("""
SELECT cve_id, round(cvss_score, 6) AS cvss_score,
       CASE WHEN cvss_score IS NOT NULL THEN 'CVSS:3.1/AV:' || substr(attack_vector, 1, 1) END AS cvss_vector,
       CASE WHEN cvss_score IS NOT NULL THEN attack_vector END AS attack_vector,
       CASE WHEN cvss_score IS NOT NULL THEN attack_complexity END AS attack_complexity,
       'Issue in ' || repository AS description, strftime(published_date, '%Y-%m-%dT%H:%M:%S.000') AS published_date
FROM dv_cve""")
ORACLES["p18_first_cwe"] = C("SELECT cve_id, CASE WHEN cve_key % 2 = 0 THEN cwe_id END AS cwe_id FROM dv_cve")
ORACLES["p19_norm_refs"] = W("""
SELECT cve_key, CAST(row_number() OVER (PARTITION BY cve_key ORDER BY pos) - 1 AS BIGINT) AS i, url,
       CASE WHEN page_id % 3 = 2 THEN '' ELSE array_to_string(tags, '|') END AS tags FROM dv_ref""", "dv_ref")
ORACLES["p20_github_summary"] = W(f"""
, g AS (SELECT cve_key, pos, url, contains(coalesce(url, ''), 'github.com') AS gh FROM dv_ref),
x AS (SELECT cve_key, pos, CASE WHEN gh THEN {gh_repo('url')} END AS repo, CASE WHEN gh THEN {gh_commit('url')} END AS cm,
             CASE WHEN gh AND ends_with(url, '.patch') THEN url END AS pu FROM g)
SELECT cve_key, arg_max(repo, pos) FILTER (WHERE repo IS NOT NULL) AS repository,
       arg_min(cm, pos) FILTER (WHERE cm IS NOT NULL AND cm <> '') AS fix_commit,
       coalesce(string_agg(cm, ',' ORDER BY pos) FILTER (WHERE cm IS NOT NULL), '') AS related_commits,
       arg_max(pu, pos) FILTER (WHERE pu IS NOT NULL) AS patch_url
FROM x GROUP BY cve_key""", "dv_ref")
ORACLES["p21_with_metadata"] = C("SELECT cve_id, '2024-01-01T00:00:00' AS collected_at, 'raw' AS processing_status FROM dv_cve")
ORACLES["x10_intent_prompt"] = W("""
, s AS (SELECT cve_key, url, 'page ' || CAST(page_id AS VARCHAR) AS scraped_text FROM dv_ref WHERE page_id % 2 = 0),
l AS (SELECT r.cve_key, r.pos, '- URL: ' || coalesce(r.url, 'N/A') || ', Tags: [' || array_to_string(coalesce(r.tags, []), ', ') || ']' || chr(10)
             || CASE WHEN s.scraped_text IS NOT NULL THEN chr(10) || '---' || chr(10) || 'Scraped Content from ' || coalesce(r.url, 'N/A')
                     || ':' || chr(10) || s.scraped_text || chr(10) || '---' || chr(10) ELSE '' END AS line
      FROM dv_ref r LEFT JOIN s ON r.cve_key = s.cve_key AND r.url = s.url),
per AS (SELECT cve_key, string_agg(line, '' ORDER BY pos) AS refs FROM l GROUP BY cve_key)
SELECT d.doc_id AS cve_key,
       'Decide whether this vulnerability was likely introduced on purpose.' || chr(10) || chr(10) || 'CVE Description: ' ||
       coalesce(d.description, '') || '.' || chr(10) || chr(10) || 'References:' || chr(10) || coalesce(p.refs, '') ||
       'Look for words such as backdoor, sabotage or malicious code, and tags such as exploit, malware or backdoor. ' ||
       'Reply with ```json {"malicious_intent_likely": true/false, "reason": "..."} ```.' AS prompt
FROM dv_desc d LEFT JOIN per p ON d.doc_id = p.cve_key""", "dv_ref", "dv_desc")
ORACLES["x11_intent_signals"] = W("""
, h AS (SELECT doc_id AS cve_key,
               list_filter(['backdoor', 'sabotage', 'malicious code'], lambda w: contains(lower(coalesce(description, '')), w)) AS words,
               CASE WHEN doc_id % 3 = 1 THEN ['exploit'] ELSE CAST([] AS VARCHAR[]) END AS tags FROM dv_desc)
SELECT cve_key, len(list_distinct(words || tags)) > 0 AS malicious_intent_likely,
       array_to_string(list_distinct(words || tags), ', ') AS reason FROM h""", "dv_desc")
ORACLES["t03_stream_weekly"] = W("""
SELECT CAST(CAST(date_trunc('week', published_date) AS DATE) AS VARCHAR) AS bucket, count(*) AS n_all, count_if(has_commit) AS n_with
FROM dv_cve GROUP BY 1""", "dv_cve")

ORACLES["j13_resolve_path"] = S("""
, snap AS (SELECT repo_name, path FROM dv_snapshot WHERE doc_id % 3 <> 0
         UNION ALL SELECT repo_name, 'g' || CAST(doc_id AS VARCHAR) || '.txt' FROM dv_snapshot WHERE doc_id % 3 = 0 AND doc_id % 9 <> 0),
corr AS (SELECT cve_id, file_path, 'g' || CAST(doc_id AS VARCHAR) || '.txt' AS c_path, [4] AS c_lines,
                CASE WHEN doc_id % 4 = 0 THEN 'ok' ELSE 'empty' END AS c_status FROM f WHERE doc_id % 2 = 0),
pp AS (SELECT DISTINCT 'CVE-2024-' || printf('%07d', doc_id) AS cve_id, unnest(['f', 'g']) || CAST(doc_id AS VARCHAR) || '.txt' AS path,
              unnest([0, 9]) AS first_pos FROM documents),
fbk AS (SELECT pp.cve_id, s.repo_name, arg_min(pp.path, pp.first_pos) AS fallback FROM pp JOIN snap s ON pp.path = s.path
       GROUP BY 1, 2),
x AS (SELECT f.cve_id, f.repo_name, f.file_path, f.line_numbers, s1.path IS NOT NULL AS in_snap,
             coalesce(c.c_status = 'ok', false) AS has_corr,
             coalesce(c.c_status = 'ok' AND c.c_path IS NOT NULL AND len(c.c_lines) > 0, false) AS complete,
             s2.path IS NOT NULL AS c_in, c.c_path, c.c_lines, fbk.fallback
      FROM f LEFT JOIN snap s1 ON f.repo_name = s1.repo_name AND f.file_path = s1.path
      LEFT JOIN corr c ON f.cve_id = c.cve_id AND f.file_path = c.file_path
      LEFT JOIN snap s2 ON f.repo_name = s2.repo_name AND c.c_path = s2.path
      LEFT JOIN fbk ON f.cve_id = fbk.cve_id AND f.repo_name = fbk.repo_name)
SELECT cve_id, repo_name, file_path,
       CASE WHEN in_snap THEN file_path WHEN has_corr AND complete AND c_in THEN c_path WHEN has_corr THEN NULL
            ELSE fallback END AS resolved_path,
       CASE WHEN in_snap THEN array_to_string(line_numbers, ',') WHEN has_corr AND complete AND c_in THEN array_to_string(c_lines, ',')
            WHEN has_corr THEN NULL WHEN fallback IS NOT NULL THEN array_to_string(line_numbers, ',') END AS resolved_lines,
       CASE WHEN in_snap THEN 'model' WHEN has_corr AND complete AND c_in THEN 'corrected' WHEN has_corr THEN 'none'
            WHEN fallback IS NOT NULL THEN 'patch' ELSE 'none' END AS resolved_by
FROM x""")

# ---------------------------------------------------------------- policy / mode variants
ORACLES["j01_join_repo_left"] = W("""
SELECT c.cve_id, c.repository, r.size FROM dv_cve c
LEFT JOIN (SELECT repository, size FROM dv_repo WHERE c_custkey % 2 = 0) r ON c.repository = r.repository""",
                                  "dv_cve", "dv_repo")
ORACLES["j12_upsert_state_fill"] = W("""
, old AS (SELECT key, status FROM dv_state WHERE c_custkey % 3 <> 0),
d AS (SELECT replace(replace(repository, '/', '_'), '_', '/') AS key, 'success' AS status FROM dv_repo WHERE c_custkey % 5 = 0)
SELECT coalesce(old.key, d.key) AS key, coalesce(old.status, d.status) AS status
FROM old FULL OUTER JOIN d ON old.key = d.key""", "dv_state", "dv_repo")
ORACLES["p22_severity_null"] = C(f"SELECT cve_id, {sev('cvss_score')} AS severity FROM dv_cve")

# ---------------------------------------------------------------- I/O and streaming round trips (what is read back)
ORACLES["w01_write_cves"] = C("SELECT cve_id, repository FROM dv_cve")
ORACLES["s02_read_cves"] = C("SELECT cve_id, round(cvss_score, 6) AS cvss_score FROM dv_cve")
ORACLES["s03_read_cves_glob"] = C("SELECT cve_id FROM dv_cve")
ORACLES["t01_stream_cves"] = C("SELECT cve_id, repository FROM dv_cve")
ORACLES["t02_stream_dedupe"] = C("SELECT cve_id, published_date FROM dv_cve")
ORACLES["s01_read_cve_feed"] = C("""
SELECT CAST(floor(cve_key / 2000) * 2000 AS BIGINT) AS page,
       CAST(row_number() OVER (PARTITION BY floor(cve_key / 2000) ORDER BY cve_key) - 1 AS BIGINT) AS pos,
       cve_id, CASE WHEN cvss_score IS NOT NULL THEN round(cvss_score, 6) END AS cvss_score FROM dv_cve""")
ORACLES["s04_read_payloads"] = W("""
SELECT owner, split_part(repository, '/', 2) AS repo, size, lower(license) AS license FROM dv_repo""", "dv_repo")
ORACLES["s05_read_patches"] = W("SELECT file_name, md5(text) AS text_md5 FROM dv_patch", "dv_patch")
ORACLES["s09_read_snapshots"] = W("SELECT path, md5(content || chr(10)) AS content_md5 FROM dv_snapshot",
                                  "dv_snapshot")
ORACLES["s10_read_pages"] = "SELECT page_id, md5(html) AS html_md5 FROM pages"
ORACLES["w02_write_repos"] = R("SELECT DISTINCT repository, size FROM j")
ORACLES["w03_write_csv"] = R("SELECT repo_size, vulnerabilities, round(avg_cvss, 6) AS avg_cvss FROM m22")
ORACLES["w07_write_snippets"] = S("SELECT cve_id, file_path, 'vulnerable' AS label, md5(code) AS code_md5 FROM sn")
_STATE_UP = """SELECT o.key, CASE WHEN o.c_custkey % 5 = 0 THEN 'success' ELSE o.status END AS status FROM dv_state o"""
ORACLES["w08_write_state"] = W(_STATE_UP, "dv_state")
ORACLES["s07_read_state"] = W("""
SELECT key, status, unnest(['table', 'object']) AS form FROM dv_state
UNION ALL SELECT key, 'done', 'names' FROM dv_state WHERE c_custkey % 2 = 0""", "dv_state")
ORACLES["e03_union_done"] = W("SELECT DISTINCT key FROM dv_state WHERE status IN ('success', 'failed') OR c_custkey % 3 = 0", "dv_state")
_FINDINGS_BACK = S("""
, g AS (SELECT cve_id, repo_name, count(*) AS n FROM f GROUP BY cve_id, repo_name)
SELECT cve_id, repo_name AS repo_name_from_patch, n FROM g""")
ORACLES["w06_write_findings"] = _FINDINGS_BACK
ORACLES["s06_read_findings"] = """
SELECT 'CVE-' || doc_id AS cve_id, source AS repo_name_from_patch, 'f' || doc_id || '.c' AS file_path, doc_id AS line,
       md5(CAST(doc_id AS VARCHAR)) AS sha FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0"""
_KINDS = {
    "commit": "SELECT o_custkey AS k, concat_ws('|', md5(CAST(o_orderkey AS VARCHAR)), count(*)) AS detail FROM orders"
              " JOIN dv_commit_file ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey",
    "repo": "SELECT c_custkey AS k, concat_ws('|', CASE c_custkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'main' ELSE 'develop' END,"
            " CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) END) AS detail FROM customer",
    "activity": "SELECT user_id AS k, count(*) || '|' || count(*) AS detail FROM events GROUP BY user_id, date_trunc('week', ts)",
    "branches": "SELECT o_custkey AS k, concat_ws('|', 'b' || o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderstatus = 'F' AS VARCHAR) END)"
                " AS detail FROM orders",
    "languages": "SELECT c_custkey AS k, CAST(c_custkey * 13 % 5000 AS VARCHAR) AS detail FROM customer WHERE c_custkey % 4 <> 0",
    "policy": "SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN '0' ELSE '1|' || c_name END AS detail FROM customer WHERE c_custkey % 2 = 0",
}
ORACLES["s04_read_payload_kinds"] = W("\nUNION ALL\n".join(
    f"SELECT '{kind}' AS kind, 'org' || (k % 97) AS owner, 'repo' || k AS repo, detail FROM ({sql})" for kind, sql in _KINDS.items())
    + """\nUNION ALL
SELECT 'contributors', 'org', 'repo' || user_id, 'user' || user_id || '|' || count(*) FROM events GROUP BY user_id""", "dv_commit_file")
ORACLES["s08_read_scrape_index"] = J(f"""
SELECT cve_id, url, regexp_replace(regexp_extract(url, '{NETLOC_RE}', 1) || '_' ||
         replace(regexp_replace({upath('url')}, '^/', ''), '/', '_'), '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') || '.txt' AS filename
FROM refs""")
ORACLES["w05_append_results"] = W("""
, r AS (SELECT 'CVE-' || CAST(doc_id AS VARCHAR) AS cve_id,
               CASE WHEN doc_id % 3 IN (0, 1) THEN doc_id % 2 = 0 ELSE false END AS flag FROM dv_desc)
SELECT cve_id, flag FROM r UNION ALL SELECT cve_id, flag FROM r WHERE ends_with(cve_id, '7')""", "dv_desc")
ORACLES["u02_score"] = W("""
, ex AS (SELECT DISTINCT cve_key FROM dv_ref WHERE list_contains(tags, 'Exploit'))
SELECT d.doc_id AS cve_key, ex.cve_key IS NOT NULL AS malicious_intent_likely
FROM dv_desc d LEFT JOIN ex ON d.doc_id = ex.cve_key""", "dv_desc", "dv_ref")
ORACLES["u03_score_until"] = W("""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'not_list'
                   WHEN 4 THEN 'item_not_dict' ELSE 'ok' END AS status FROM dv_reply""", "dv_reply")
ORACLES["s02_read_cves_rejects"] = "SELECT '{broken ' || CAST(doc_id AS VARCHAR) AS _corrupt_record FROM documents"


_J09 = ORACLES["j09_introducing_commits"]
ORACLES["j09_attribution_share"] = "WITH x AS (" + _J09 + """)
SELECT count(*) AS n_lines, count_if(introducing_commit <> 'blame_error') AS n_matched,
       round(count_if(introducing_commit = 'blame_error') * CAST(100 AS DOUBLE) / count(*), 6) AS pct_unmatched FROM x"""
ORACLES["p23_parse_ts_strict"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS parsed FROM events"
ORACLES["f07_has_commit_details"] = C("SELECT cve_id FROM dv_cve WHERE has_commit")
ORACLES["w04_write_report"] = R("""
, r AS (SELECT count(*) AS size_groups, CAST(sum(vulnerabilities) AS BIGINT) AS total_vulnerabilities,
               median(CAST(repo_size AS DOUBLE)) AS median_size,
               corr(CAST(repo_size AS DOUBLE), CAST(vulnerabilities AS DOUBLE)) AS corr_size_count FROM m23)
SELECT 'Statistical Analysis Report' AS line FROM r
UNION ALL SELECT printf('Total Repositories Analyzed: %d', size_groups) FROM r
UNION ALL SELECT printf('Total Vulnerabilities: %d', total_vulnerabilities) FROM r
UNION ALL SELECT printf('Median Size: %.0f KB', round(median_size, 0)) FROM r
UNION ALL SELECT printf('Size-Vulnerability Correlation: %.3f', round(corr_size_count, 3)) FROM r""")

# The page's strings (script, style, template, comments and declarations excluded), each
# stripped, empty ones dropped, joined by one space; entity references decoded (those the pages use).
_HTML = r"""c AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                  '(?is)<(script|style|template)\b[^>]*>.*?</(script|style|template)\s*>', '', 'g') AS h FROM pages),
s AS (SELECT page_id, unnest(regexp_split_to_array(h, '<[^>]*>')) AS seg,
             generate_subscripts(regexp_split_to_array(h, '<[^>]*>'), 1) AS k FROM c),
t AS (SELECT page_id, k, regexp_replace(replace(replace(replace(replace(seg, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'),
                                '&amp;', '&'), '^\s+|\s+$', '', 'g') AS s FROM s),
x AS (SELECT p.page_id, p.url, coalesce(string_agg(t.s, ' ' ORDER BY t.k) FILTER (WHERE t.s <> ''), '') AS text
      FROM pages p LEFT JOIN t ON p.page_id = t.page_id GROUP BY p.page_id, p.url)"""
ORACLES["p15_html_text"] = "WITH " + _HTML + " SELECT page_id, text FROM x"
ORACLES["u01_html_text"] = "WITH " + _HTML + " SELECT page_id, url, text FROM x"
