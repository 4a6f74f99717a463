"""Registered queries over whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodeframe.catalog.base import TABLES
from lodeframe.operators import tests as T
from lodeframe.operators.detect import structure, types
from lodeframe.operators.clean import balance
from lodeframe.operators.profile import semantics
from tools.verify import canon

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c28_text_features_documents", "c52_smote", "u1_merge_tables_all", "u2_merge_sheets_all", "h3_mann_whitney_all", "h4_t_test_all"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found, want = entry.queries()[name](spark, FOLDER), con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    key = lambda row: tuple(repr(v) for v in row)
    got = sorted((tuple(canon(r[c]) for c in names) for r in found.collect()), key=key)
    assert got == sorted((tuple(canon(v) for v in r) for r in want.fetchall()), key=key)


def test_text_queries_read_each_table_whole(spark, monkeypatch):
    seen = []
    for module, name in ((semantics, "semantic_types"), (types, "text_columns")):
        run = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, run=run: (seen.append(df.count()), run(df))[1])
    size = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count()
    for name in ("f3_semantic_types_text", "d24_text_columns", "d24_text_columns_documents"):
        entry.queries()[name](spark, FOLDER).collect()
    assert seen == [size(t) for t in ("pages", "documents", "benchmark", "pages", "documents")]


def noted(monkeypatch, module, name):
    """Columns and further arguments of each call."""
    seen, run = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *a: (seen.append((len(df.columns), a)), run(df, *a))[1])
    return seen


def test_lists_are_whole(spark, monkeypatch):
    seen = noted(monkeypatch, structure, "nullity_matrix"), noted(monkeypatch, T, "discover")
    n = [entry.queries()[name](spark, FOLDER).count() for name in ("d8_nullity_matrix_all", "h10_discover_all")]
    assert n[0] > structure.MATRIX_ROWS and n[1] > 0
    assert [x[0][1] for x in seen] == [(None,), (None,)]


def test_smote_uses_every_dimension(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(balance, "smote", lambda df, *a: (seen.append(len(df.columns)), df.withColumn("_new", df.y > 1))[1])
    entry.queries()["c52_smote"](spark, FOLDER)
    assert seen == [66]
