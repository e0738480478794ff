"""Queries against their SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from webquarry.plans import catalog, live

QUERIES, ORACLE_SQL = catalog.QUERIES | live.QUERIES, catalog.ORACLE_SQL | live.ORACLE_SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(got)


@pytest.mark.parametrize("name", ["site_business", "site_selected", "html_tree"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


#: Titles that end within a reference, as those cut to a length do.
CUT = [(1, "https://a.io/x", "<html lang=\"en\"><head><title>Tools &amp; drills &amp</title></head><body><article><h1>Tools &amp; drills &amp</h1><p>One</p></article></body></html>")]


@pytest.mark.parametrize("name", ["page_items", "page_evidence_counts", "page_headings", "page_metadata", "page_title_lang"])
def test_agrees_with_sql_on_cut_references(spark, tmp_path, name):
    spark.createDataFrame(CUT, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    assert plain(got) == plain(want) and "Tools & drills &amp" in got[got.page_id == 1].astype(str).to_numpy()


def test_phones_agree_with_sql_beside_other_digits(spark, tmp_path):
    texts = ["at +1 (608) 555-2280 37.92.178.161 in", 'token = "9885103314b39ed955fd"', "+1 (884) 555-3918", "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["phone_extract"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL["phone_extract"]).fetchdf()
    assert plain(got) == plain(want) == [(0, "+16085552280"), (2, "+18845553918")]
