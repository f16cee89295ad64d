"""A quick slice of the registered queries against their SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = [
    "p05_clean_text_legacy", "w01_sentence_segment", "w03_windows_of_turns", "w05_token_chunks", "x06_extract_triples",
    "m01_cue_mapping", "d06_top_connected", "a01_graph_summary", "m11_canonical_resolve", "a08_relation_dedup",
    "m14_constraint_specs", "g17_geo_edges", "a16_gelman_rubin", "a11_score_per_type", "d09_rolling_eta", "t04_stream_counts",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert "entity" in df.columns and df.count() == 10
