"""Explicit schemas: JSON is never read with inference."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def arr(t):
    return T.ArrayType(t)


def st(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


REFERENCE = st(("url", S), ("source", S), ("tags", arr(S)))

RAW_CVE = st(
    ("id", S), ("published", S), ("lastModified", S),
    ("descriptions", arr(st(("lang", S), ("value", S)))),
    ("references", arr(REFERENCE)),
    ("metrics", st(("cvssMetricV31", arr(st(("cvssData", st(
        ("baseScore", D), ("vectorString", S), ("attackVector", S), ("attackComplexity", S)))))))),
    ("weaknesses", arr(st(("description", arr(st(("lang", S), ("value", S))))))),
)

FEED_PAGE = st(("startIndex", L), ("vulnerabilities", arr(st(("cve", RAW_CVE)))))

CVE = st(
    ("cve_id", S),
    ("github_data", st(("repository", S), ("fix_commit", S), ("related_commits", arr(S)), ("patch_url", S))),
    ("vulnerability_details", st(("cvss_score", D), ("cvss_vector", S), ("cwe_id", S), ("description", S),
                                 ("attack_vector", S), ("attack_complexity", S))),
    ("temporal_data", st(("published_date", S), ("last_modified", S), ("fix_date", S))),
    ("references", arr(REFERENCE)),
    ("collection_metadata", st(("collected_at", S), ("processing_status", S))),
    ("_corrupt_record", S),
)

FINDING = st(("cve_id", S), ("repo_name_from_patch", S),
             ("vulnerable_snippets", arr(st(("file_path", S), ("line_numbers", arr(I)),
                                            ("introducing_commits", T.MapType(S, S))))))

PAYLOADS = {
    "commit": st(("owner", S), ("repo", S), ("sha", S),
                 ("commit", st(("message", S), ("author", st(("date", S))))),
                 ("author", st(("login", S), ("type", S))),
                 ("stats", st(("additions", L), ("deletions", L), ("total", L))),
                 ("files", arr(st(("filename", S), ("status", S), ("additions", L), ("deletions", L), ("patch", S))))),
    "repo": st(("owner", S), ("repo", S), ("name", S), ("created_at", S), ("updated_at", S), ("pushed_at", S),
               ("size", L), ("stargazers_count", L), ("forks_count", L), ("open_issues_count", L),
               ("watchers_count", L), ("default_branch", S), ("has_wiki", B), ("has_issues", B),
               ("allow_forking", B), ("is_template", B), ("license", st(("key", S)))),
    "contributors": st(("owner", S), ("repo", S), ("author", st(("login", S))),
                       ("weeks", arr(st(("c", L), ("a", L), ("d", L))))),
    "activity": st(("owner", S), ("repo", S), ("total", L), ("days", arr(L))),
    "branches": st(("owner", S), ("repo", S), ("name", S), ("protected", B)),
    "languages": st(("owner", S), ("repo", S), ("languages", T.MapType(S, L))),
    "policy": st(("owner", S), ("repo", S), ("policy", T.MapType(S, S))),
}

STATE = st(("key", S), ("status", S))
