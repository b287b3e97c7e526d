"""Every branch an operator can take occurs in what its registered query is compared on (sf0.01)."""

import duckdb
import pytest

from vulnlake.plans.oracles import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "part", "events", "documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key, test", [
    ("p01_is_github", "bool_or(is_github) AND bool_or(NOT is_github)"),
    ("j13_resolve_path", "count(DISTINCT resolved_by) = 4"),
    ("j14_join_patch_cve", "count(repository) > 0 AND count(repository) < count(*)"),
    ("a34_snippets_per_cve", "min(n_snippets) = 0 AND max(n_snippets) > 1"),
    ("a35_snippets_per_extension", "count(*) = 3"),
    ("a36_list_snippets", "max(rank) > 1"),
    ("p29_changed_files", "count(DISTINCT status) = 3 AND count(patch) < count(*)"),
    ("p32_repo_features", "bool_or(has_wiki) AND bool_or(is_template) AND NOT bool_and(allow_forking) AND bool_or(has_security_policy)"
                          " AND NOT bool_and(has_protected_branches) AND count(license) < count(*)"),
    ("p33_commit_features", "count(login) < count(*) AND count(total_commits) < count(login) AND bool_or(references_issue)"),
    ("s07_read_state", "count(DISTINCT form) = 3"),
    ("s04_read_payload_kinds", "count(DISTINCT kind) = 7"),
])
def test_branch_occurs(con, key, test):
    assert con.execute(f"SELECT {test} FROM ({ORACLES[key]})").fetchone()[0]
