"""The registry, and a few of its queries beside DuckDB on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodeframe.catalog.base import TABLES
from tools.verify import canon

FOLDER = "/root/testdata/sf0.001"
PICKED = ("q8_query_spec", "p13_and_or_groups", "j4_full", "a4_median", "w2_ntile_split", "o4_top_per_group", "t10_growth", "c12_interpolate", "d9_iqr", "f20_cramers_v", "h5_anova", "i9_ks_2samp", "s5_strict")


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 350


def test_queries_are_listed_without_a_session():
    listing = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", listing], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert got.stdout.split() == [str(len(entry.queries())), str(len(entry.oracle_sql()))]


def test_the_flagship_runs(spark):
    assert entry.entry(spark).columns == ["c_mktsegment", "revenue", "average", "orders"]


@pytest.mark.parametrize("name", PICKED)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: tuple(repr(v) for v in row)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(canon(v) for v in r) for r in res.fetchall()), key=key)
