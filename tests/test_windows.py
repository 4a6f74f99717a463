"""Windows give one answer, whether groups are small enough for a task or cut into ranges."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodeframe.plans.windows import add_window

DECIMALS = [Decimal(2**53 + i) for i in range(6)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [
        (i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 2, 3]), rng.choice(["x", "é", "", None, "yy"]), rng.choice([*DECIMALS, None]), rng.choice([None, *range(-5, 9)]), {"k": rng.randint(0, 3)})
        for i in range(90)
    ]
    rows += rows[:5]
    return spark.createDataFrame(rows, "id long, g string, n int, t string, d decimal(38,0), v long, m map<string,int>").repartition(4).cache()


def answers(df, window):
    out = []
    for size in (5_000_000, 1):
        got = add_window(df, window, "w", size).withColumn("m", F.to_json("m"))
        out.append(sorted(map(repr, got.collect())))
    return out


ORDERS = [["d"], [{"column": "t", "direction": "DESC"}, "n"], [{"column": "n", "direction": "DESC"}]]
ROWS = ["ROWS BETWEEN 1 PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"]


@pytest.mark.parametrize("function", ["ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD"])
@pytest.mark.parametrize("order", range(3))
def test_ranking_and_shifts(table, function, order):
    small, split = answers(table, {"func": function, "column": "v", "offset": 2, "n": 7, "partition_by": ["g"] if order else [], "order_by": ORDERS[order]})
    assert small == split


@pytest.mark.parametrize("function", ["SUM", "AVG", "COUNT", "MIN", "MAX", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"])
@pytest.mark.parametrize("frame", [None, *ROWS])
def test_frames(table, function, frame):
    order = (len(frame or "") + len(function)) % 3
    window = {"func": function, "column": "v", "n": 3, "partition_by": ["g"] if order != 1 else [], "order_by": ORDERS[order]} | ({"frame": frame} if frame else {})
    small, split = answers(table, window)
    assert small == split


@pytest.mark.parametrize("function", ["SUM", "MAX", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"])
@pytest.mark.parametrize("frame", ["RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"])
def test_frames_to_the_end(table, function, frame):
    small, split = answers(table, {"func": function, "column": "v", "n": 4, "partition_by": [], "order_by": ORDERS[1], "frame": frame})
    assert small == split


def test_ranks_of_large_decimals_are_exact(spark):
    df = spark.createDataFrame([(x,) for x in DECIMALS[:4]], "d decimal(38,0)")
    for size in (5_000_000, 1):
        assert [r.w for r in add_window(df, {"func": "RANK", "order_by": ["d"]}, "w", size).orderBy("d").collect()] == [1, 2, 3, 4]


def test_empty_table(table):
    for function in ("RANK", "SUM", "NTH_VALUE", "LAG"):
        assert add_window(table.limit(0), {"func": function, "column": "v", "order_by": ["t"]}, "w", 0).count() == 0
