"""The entry module, and each engine query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from millrace.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = ["strip_sentinels", "parse_numbers", "dedup_first", "fill_mode", "forward_fill", "outlier_flag", "cluster_fingerprint", "rules_finance", "clean_balanced"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    relation = con.sql(ORACLES[name])
    key = lambda cols, row: [round(v, 4) if isinstance(v, float) else v for _, v in sorted(zip(cols, row))]
    mine = sorted((key(df.columns, r) for r in df.collect()), key=repr)
    theirs = sorted((key(relation.columns, r) for r in relation.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(relation.columns) and mine == theirs
