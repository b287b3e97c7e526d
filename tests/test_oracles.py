"""Every registered query against its DuckDB oracle (row count, column names,
order-insensitive values) at sf0.001 - the driver does the same at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "month" in df.columns


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    """One row (or more) for every document or page, and the pipeline keeps some of them."""
    out = E.queries()[name](spark, SF)
    ids = spark.read.parquet(f"{SF}/{'pages' if 'page_id' in out.columns else 'documents'}.parquet")
    key = "page_id" if "page_id" in out.columns else "doc_id"
    found, every = out.select(key).distinct(), ids.select(key).distinct()
    assert found.join(every, key, "left_anti").count() == 0 and found.count() > 0
    assert name == "pipeline" or found.count() == every.count()
