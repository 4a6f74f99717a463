"""Long documents cut into records, against the standard parser, with pieces, stretches and file splits of any size."""

import json
import os
import random

import pytest

from lodeframe.catalog import catalog
from lodeframe.sources import documents as D
from lodeframe.sources import readers as R
from lodeframe.sources import writers as W


def _put(spark, folder, *texts):
    for i, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{folder}/json")
    return f"{folder}/json"


def _objects(n):
    rng = random.Random(n)
    odd = ["", "}", '"},{"', "a,b]", "\\", '\\"', "[{", "é}\n", "x ,"]
    one = lambda i: {"id": i, "t": "".join(rng.choices(odd, k=rng.randrange(6))), "in": {"k": [rng.randrange(9) for _ in range(rng.randrange(3))], "s": rng.choice(odd)}}
    return [one(i) for i in range(n)]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("stretch, indent", [(7, None), (100_000, 1)])
def test_arrays_of_objects_are_cut_by_many_tasks(spark, folder, small_splits, stretch, indent):
    objects = _objects(60)
    path = _put(spark, folder, json.dumps(objects, indent=indent, ensure_ascii=False))
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 2
    got = sorted(D.json_records(spark, path, stretch=stretch).collect(), key=lambda r: r["record"])
    assert [r["record"] for r in got] == list(range(60)) and all(r["array"] for r in got)
    assert [json.loads(r["value"]) for r in got] == objects


@pytest.mark.parametrize("stretch", [2])
def test_arrays_of_values_and_single_objects(spark, folder, small_splits, stretch):
    values = ["a,b", "]", '"', "[", "plain", ""] * 15 + [1, None, [1, [2, "x,"]], True]
    path = _put(spark, f"{folder}/v", json.dumps(values))
    got = sorted(D.json_records(spark, path, ",", stretch).collect(), key=lambda r: r["record"])
    assert [json.loads(r["value"]) for r in got] == values
    one = {"data": _objects(20), "n": 20}
    path = _put(spark, f"{folder}/o", json.dumps(one), json.dumps(one) + "\n" + json.dumps({"n": 1}))
    got = [json.loads(r["value"]) for r in D.json_records(spark, path, stretch=stretch).collect()]
    assert sorted(got, key=lambda r: r["n"]) == [{"n": 1}, one, one]


def test_tables_of_documents(spark, folder, small_splits):
    objects = _objects(40)
    path = _put(spark, f"{folder}/a", json.dumps(objects), "[]", " \n[ ]", json.dumps({"id": -1}))
    got = {r["id"]: r for r in R.read_json(spark, path).collect()}
    assert sorted(got) == list(range(-1, 40)) and got[-1]["t"] is None
    assert all(got[o["id"]]["t"] == o["t"] and got[o["id"]]["in"]["k"] == o["in"]["k"] for o in objects)
    path = _put(spark, f"{folder}/v", json.dumps(["x,1", None, "y"]), json.dumps(["z"]))
    assert sorted(str(r["value"]) for r in R.read_json(spark, path).collect()) == ["None", "x,1", "y", "z"]


def test_a_broken_record_leaves_the_others(spark, folder):
    path = _put(spark, folder, '[{"id": 1}, {"id": 2, "t" "x"}, {"id": 3}, {"id": 4, "t": [')
    got = R.read_json(spark, path).collect()
    assert sorted(r["id"] for r in got if r["_corrupt_record"] is None) == [1, 3]
    assert sum(r["_corrupt_record"] is not None for r in got) == 2


def test_partition_folders_and_empty_documents(spark, folder):
    lines = spark.createDataFrame([(1, '[{"id": 1}, {"id": 2}]'), (2, '{"id": 3}')], "chunk int, value string")
    lines.write.partitionBy("chunk").text(f"{folder}/p")
    assert sorted((r["chunk"], r["id"]) for r in R.read_json(spark, f"{folder}/p").collect()) == [(1, 1), (1, 2), (2, 3)]
    path = _put(spark, f"{folder}/e", "", "[]")
    assert R.read_json(spark, path).collect() == []


@pytest.mark.parametrize("stretch", [3])
def test_one_insert_with_many_rows_is_read_by_many_tasks(spark, folder, small_splits, stretch, monkeypatch):
    records = D.script_records
    monkeypatch.setattr(R, "script_records", lambda *a, **k: records(*a, **k, stretch=stretch))
    odd = ["it's", ");", "(", "a;\nb", "x, y", "insert into other (", ""]
    rows = [(str(i), None if i % 5 == 0 else odd[i % 7] + "/" + odd[i % 3], str(i / 4)) for i in range(50)]
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    tuples = lambda some: ",\n".join(f"({i}, {text(t)}, {x})" for i, t, x in some)
    script = (
        "-- a dump\nSET NAMES utf8;\nCREATE TABLE other (id INT);INSERT INTO other (id) VALUES (900),(901);\n"
        "CREATE TABLE IF NOT EXISTS `mine` (\n id INT, name VARCHAR(20), share DECIMAL(9, 2),\n PRIMARY KEY (id)\n) ENGINE=x;\n"
        f"INSERT INTO `mine` (id, name, share) VALUES {tuples(rows[:30])};INSERT INTO other VALUES (902); INSERT INTO mine VALUES {tuples(rows[30:])};\nINSERT INTO other VALUES (903);\n"
    )
    path = _put(spark, folder, script)
    got = R.read_sql_dump(spark, path, "mine")
    assert got.columns == ["id", "name", "share"]
    assert sorted(map(tuple, got.collect()), key=lambda r: int(r[0])) == rows
    assert sorted(r["id"] for r in R.read_sql_dump(spark, path, "other").collect()) == ["900", "901", "902", "903"]


def test_names_come_from_the_insert_without_a_create(spark, folder):
    path = _put(spark, folder, "INSERT INTO t (a, b) VALUES (1, 'x'), (2, NULL);\nINSERT INTO t (a, b) VALUES (3, 'f(1)');")
    assert sorted(map(tuple, R.read_sql_dump(spark, path, "t").collect())) == [("1", "x"), ("2", None), ("3", "f(1)")]


def test_one_file_is_written_by_many_tasks(spark, folder):
    texts = [f"{i} é" if i % 7 else None for i in range(200)]
    lines = spark.createDataFrame([(t,) for t in texts], "value string").repartition(5)
    want = ["" if r["value"] is None else r["value"] for r in lines.collect()]
    W.write_one_text(lines, f"{folder}/one", "[", "]")
    names = os.listdir(f"{folder}/one".removeprefix("file:"))
    with open(os.path.join(f"{folder}/one".removeprefix("file:"), *names), encoding="utf-8") as f:
        assert f.read().split("\n") == ["[", *want, "]", ""]
    W.write_one_text(lines.where("false"), f"{folder}/none", "[", "]")
    assert [r["value"] for r in spark.read.text(f"{folder}/none").collect()] == ["[", "]"]


def test_texts_are_not_cut_again_for_each_step(spark, folder):
    path = _put(spark, folder, "INSERT INTO t (a, b) VALUES (1, 'x'), (2, NULL);")
    plan = R.read_sql_dump(spark, path, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert " text" not in plan and "Relation" in plan


def test_records_of_a_partition_folder_are_written_together(spark, folder):
    spark.createDataFrame([(i % 3, f'[{{"id": {i}}}, {{"id": {i + 50}}}]') for i in range(40)], "chunk int, value string").repartition(6).write.partitionBy("chunk").text(f"{folder}/p")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        read = spark.read.text(D.json_lines(spark, f"{folder}/p"))
        assert len(read.inputFiles()) == 3 and read.count() == 80
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quoted_texts_are_written_by_as_many_tasks_as_they_need(spark, folder, monkeypatch):
    spark.range(3000).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), 9) AS text", "'en' AS lang").repartition(6).write.parquet(f"{folder}/documents.parquet")
    paths, read = [], R.read_delimited
    monkeypatch.setattr(R, "read_delimited", lambda s, path, *a, **k: paths.append(path) or read(s, path, *a, **k))
    small = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for name in small:
        spark.conf.set(name, "16k")
    try:
        assert catalog().queries["s1_quoted_texts"](spark, folder).count() == 3000
    finally:
        for name in small:
            spark.conf.unset(name)
    assert len(spark.read.text(paths[0]).inputFiles()) > 4
