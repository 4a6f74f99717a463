"""Quantiles, ranges, blocks and neighbours against brute force, on skewed and empty inputs."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import ordered, quantiles
from lodeframe.operators.clean import rows as basic
from lodeframe.operators.neighbours import grow, nearest, points, visits, within


def skewed(spark, n=40_000, hot=0.4):
    """A third or more of the rows share one value, the rest spread widely."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(n) < hot, 7.0, np.round(rng.normal(0, 100, n), 3))
    return pd.DataFrame({"id": np.arange(n), "x": x, "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 50, n).astype(str))})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = skewed(spark)
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_quantiles_match_numpy_on_a_hot_value(frame, monkeypatch):
    pdf, df = frame
    monkeypatch.setattr(quantiles, "SMALL", 100)
    probs = [0.0, 0.01, 0.25, 0.5, 0.613, 0.99, 1.0]
    got = quantiles.quantiles(df, ["x"], probs)["x"]
    assert got == pytest.approx(list(np.quantile(pdf["x"], probs)))


def test_quantiles_of_nothing_and_of_one(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5]) == {"x": [None]}
    assert quantiles.quantiles(spark.createDataFrame([(None,), (4.0,), (float("nan"),)], "x double"), ["x"], [0.1, 0.9]) == {"x": [4.0, 4.0]}


@pytest.mark.parametrize("small", [0, 10**6])
def test_group_quantiles_with_a_hot_group(frame, small):
    pdf, df = frame
    got = {r["g"]: (r["a"], r["b"]) for r in ordered.group_quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.9}, small).collect()}
    expected = pdf.groupby("g")["x"].quantile([0.5, 0.9]).unstack()
    assert len(got) == len(expected)
    for g, row in expected.iterrows():
        assert got[g] == pytest.approx((row[0.5], row[0.9]))


def test_many_quantiles(frame):
    pdf, df = frame
    probs = [i / 200 for i in range(201)]
    assert ordered.many_quantiles(df, "x", probs) == pytest.approx(list(np.quantile(pdf["x"], probs)))


def test_a_hot_value_is_cut_along_the_key(frame):
    pdf, df = frame
    sizes = ordered.with_ranges(df, "x", "id", ranges=16).groupBy("_range").count().toPandas()["count"]
    assert sizes.sum() == len(pdf)
    assert sizes.max() < len(pdf) / 8


def test_positions_are_dense_and_ordered(frame):
    pdf, df = frame
    got = ordered.with_position(df, "x", "id").select("id", "_pos").toPandas().set_index("id")["_pos"]
    order = pdf.sort_values(["x", "id"])["id"].to_numpy()
    assert (got.loc[order].to_numpy() == np.arange(len(pdf))).all()


def test_positions_with_null_order_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 1.0)], "id long, x double")
    got = {r["id"]: r["_pos"] for r in ordered.with_position(df, "x", "id").collect()}
    assert got == {4: 0, 2: 1, 1: 2, 3: 3}


def test_fill_both_ways_across_ranges(spark):
    n = 3000
    pdf = pd.DataFrame({"id": range(n), "t": [float(i // 3) for i in range(n)], "v": [float(i) if i % 700 == 5 else None for i in range(n)]})
    df = spark.createDataFrame(pdf).repartition(8)
    forward = basic.ffill(df, ["v"], "t", "id").toPandas().sort_values("id")["v"].to_numpy()
    backward = basic.bfill(df, ["v"], "t", "id").toPandas().sort_values("id")["v"].to_numpy()
    np.testing.assert_array_equal(forward, pdf["v"].ffill().to_numpy())
    np.testing.assert_array_equal(backward, pdf["v"].bfill().to_numpy())


def test_interpolation_keeps_leading_nulls(spark):
    pdf = pd.DataFrame({"id": range(8), "v": [None, 2.0, None, None, 8.0, None, 3.0, None]})
    got = basic.interpolate(spark.createDataFrame(pdf), ["v"], "id", "id").toPandas().sort_values("id")["v"].to_numpy()
    np.testing.assert_allclose(got, pdf["v"].interpolate().to_numpy())


def test_blocks_give_the_same_moving_mean(spark):
    n = 1000
    pdf = pd.DataFrame({"id": range(n), "v": np.random.default_rng(2).normal(size=n)})
    placed = ordered.with_position(spark.createDataFrame(pdf), "id", "id")
    spread, w = ordered.in_blocks(placed, 3, 2, rows=37)
    got = spread.withColumn("m", F.avg("v").over(w.rowsBetween(-3, 2))).where("_home").toPandas().sort_values("id")["m"]
    expected = [pdf["v"][max(0, i - 3) : i + 3].mean() for i in range(n)]
    np.testing.assert_allclose(got, expected)


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, 2.0, 5.0)], "x double")
    assert {r["v"]: r["rank"] for r in ordered.value_ranks(df, "x").collect()} == {1.0: 1.0, 2.0: 2.0, 5.0: 4.0}


def test_string_positions(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    assert {r["value"]: r["position"] for r in ordered.positions_of_values(df, "x").collect()} == {"a": 0, "b": 1, "c": 2}


def brute(v, k):
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return d, order


@pytest.mark.parametrize("leaf", [60, 1000])
def test_neighbours_are_exact_also_when_a_third_are_copies(spark, leaf):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 3))
    v[::3] = v[0]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "key long, vec array<double>")
    p = points(df, "key", F.col("vec"))
    got = nearest(p, p, 4, other=True, leaf=leaf, fan=3, chunk=50).toPandas()
    d, order = brute(v, 4)
    assert len(got) == 600 * 4
    for i, part in got.groupby("id"):
        part = part.sort_values("rank")
        np.testing.assert_allclose(part["distance"], np.sort(d[i])[:4], atol=1e-9)
        assert list(part["neighbour"]) == list(order[i])


@pytest.mark.parametrize("leaf", [40])
def test_counts_within_a_radius(spark, leaf):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "key long, vec array<double>")
    p = points(df, "key", F.col("vec"))
    got = within(p, p, 0.5, leaf=leaf, fan=4, chunk=40).toPandas().set_index("id")["n"]
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    assert list(got.sort_index()) == list((d <= 0.5).sum(axis=1))


def test_groups_of_neighbours_stay_apart(spark):
    rng = np.random.default_rng(5)
    v, g = rng.normal(size=(300, 2)), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, [float(x) for x in row], str(c)) for i, (row, c) in enumerate(zip(v, g))], "key long, vec array<double>, g string")
    p = points(df, "key", F.col("vec"), F.col("g"))
    got = nearest(p, p, 3, other=True, leaf=15, fan=3).toPandas()
    for i, part in got.groupby("id"):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[(g != g[i]) | (np.arange(300) == i)] = np.inf
        assert list(part.sort_values("rank")["neighbour"]) == list(np.argsort(d, kind="stable")[:3])


def test_visits_per_query_stay_the_same_as_rows_grow(spark):
    """Four times the rows make four times the leaves, but a query looks into about as many."""
    rng = np.random.default_rng(6)
    seen = []
    for n in (2_000, 8_000):
        df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rng.random((n, 2)))], "id long, v array<double>").withColumn("g", F.lit(0))
        tree = grow(df, 100, 8)
        bound = 2 / np.sqrt(n)  # about the fourth neighbour's distance
        found = visits(df.withColumn("bound", F.lit(float(bound))), tree)
        assert tree.donors.groupBy("node").count().agg(F.max("count")).first()[0] <= 100
        seen.append(found.count() / n)
    assert seen[1] < 1.3 * seen[0] and seen[1] < 6


def test_neighbours_without_donors(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [0.0])], "id long, v array<double>")
    assert nearest(some, empty, 2).count() == 0
    assert [r["n"] for r in within(some, empty, 1.0).collect()] == [0]


def test_within_stops_where_there_are_enough_and_is_exact_below(spark):
    rng = np.random.default_rng(8)
    v = [[round(float(x), 2) for x in rng.normal(0, 1, 2)] for _ in range(400)] + [[0.5, 0.5]] * 60
    p = spark.createDataFrame([(i % 450, x) for i, x in enumerate(v)], "id int, v array<double>")
    full = {(r["id"], r["n"]) for r in within(p, p, 0.3, leaf=30, fan=4, chunk=40).collect()}
    some = dict(tuple(r) for r in within(p, p, 0.3, leaf=30, fan=4, chunk=40, enough=6).collect())
    assert all(some[i] == n if n < 6 else 6 <= some[i] <= n for i, n in full) and sum(some.values()) < sum(n for _, n in full)


def test_small_groups_are_filled_without_ranges(spark):
    """Positions, fills and lines of whole groups are those of groups cut into ranges, with null groups and null times; no join is planned."""
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(20)]), rng.choice([None, None, float(k % 13)])) for k in range(600)]
    table = spark.createDataFrame(rows, "id long, g string, t long, v double").repartition(5)
    for make in (
        lambda bounded: ordered.with_position(table, "t", "id", ["g"], bounded),
        lambda bounded: ordered.fill(table, ["v"], "t", "id", ["g"], True, bounded),
        lambda bounded: ordered.fill(table, ["v"], "t", "id", ["g"], False, bounded),
    ):
        whole, ranged = make(None), make(False)
        assert whole.columns == ranged.columns
        assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, ranged.collect()))
    assert not ordered.bounded_groups(table, ["g"], 100) and not ordered.bounded_groups(table, None)
    plan = basic.interpolate(table, ["v"], "t", "id", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
