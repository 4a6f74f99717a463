"""Probabilities against published values, tests against hand-computed ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import special, stem, strings
from lodeframe.operators import drift, tests
from lodeframe.operators.clean import scale
from lodeframe.operators.profile import numeric, relations


@pytest.mark.parametrize(
    "got, expected",
    [
        (special.t_two_sided(2.228, 10), 0.05), (special.t_two_sided(12.706, 1), 0.05), (special.chi2_tail(3.841, 1), 0.05), (special.chi2_tail(18.307, 10), 0.05),
        (special.f_tail(4.965, 1, 10), 0.05), (special.f_tail(2.978, 10, 10), 0.05), (special.normal_two_sided(1.959964), 0.05), (special.kolmogorov_tail(1.3581), 0.05),
        (special.kolmogorov_tail(0.8276), 0.5),
    ],
)
def test_critical_values(got, expected):
    assert got == pytest.approx(expected, abs=2e-4)


def test_jaro_winkler_known_values():
    assert strings.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert strings.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert strings.jaro_winkler("abc", "") == 0.0


@pytest.mark.parametrize("word, root", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("conditional", "condit"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("happy", "happi")])
def test_porter(word, root):
    assert stem.stem(word) == root


def test_clusters_are_linked():
    assert strings.clusters_of([("b", "c"), ("a", "b"), ("x", "y")]) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


@pytest.fixture(scope="module")
def two(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [3.0, 4.0, 5.0, 6.0, 9.0]
    return spark.createDataFrame([(v, "a") for v in a] + [(v, "b") for v in b] + [(None, "a"), (2.0, None)], "v double, g string")


def test_t_test_by_hand(two):
    r = tests.t_test(two, "v", "g").first()
    assert r["statistic"] == pytest.approx(-2.4 / math.sqrt((10 + 21.2) / 8 * 0.4))
    assert r["df1"] == 8 and r["p_value"] == pytest.approx(0.0914, abs=2e-3)


def test_mann_whitney_by_hand(two):
    r = tests.mann_whitney(two, "v", "g").first()
    pairs = [(x > y) + 0.5 * (x == y) for x in (1, 2, 3, 4, 5) for y in (3, 4, 5, 6, 9)]
    assert r["statistic"] == pytest.approx(sum(pairs))
    assert 0.05 < r["p_value"] < 0.15


def test_anova_equals_squared_t(two):
    t, f = tests.t_test(two, "v", "g").first(), tests.anova(two, "v", "g").first()
    assert f["statistic"] == pytest.approx(t["statistic"] ** 2)
    assert f["p_value"] == pytest.approx(t["p_value"])


def test_unknown_test_and_constant_columns_are_refused(spark, two):
    with pytest.raises(ValueError):
        tests.run_test("nothing", two, "v")
    constant = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    with pytest.raises(ValueError):
        tests.pearson(constant, "x", "y")


def test_suggested_tests_run(two):
    for name, columns in tests.suggest_tests(two):
        assert tests.run_test(name, two, *columns).count() == 1


def test_psi_and_ks_of_equal_tables(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert drift.psi_value(df, df, "x") == pytest.approx(0.0)
    assert drift.ks_2samp_values(df, df, "x") == (0.0, 1.0)


def test_vif_of_copies_is_beyond_measure(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(2 * a + 1)) for a, b in rng.normal(size=(200, 2))]
    got = relations.vif_values(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert got["a"] is None and got["c"] is None and got["b"] == pytest.approx(1.0, abs=0.1)


def test_spearman_ranks_rows_that_know_both(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 20.0), (4.0, 5.0), (None, 7.0)], "x double, y double")
    (r, n) = relations.spearman_pairs(df, [("x", "y")])[("x", "y")]
    assert n == 3 and r == pytest.approx(-0.5)


def test_power_lambda_beats_its_neighbours(spark):
    rng = np.random.default_rng(6)
    x = np.exp(rng.normal(size=2000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = scale.power_lambda(df, "x", "boxcox")

    def score(g):
        y = np.log(x) if abs(g) < 1e-12 else (x**g - 1) / g
        return (g - 1) * np.log(x).mean() - 0.5 * math.log(y.var())

    assert abs(lam) < 0.1
    assert score(lam) >= max(score(lam - 1e-3), score(lam + 1e-3))


def test_quantile_transform_is_a_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,)], "x double")
    got = scale.scale(df, ["x"], "quantile_uniform").toPandas()["x"]
    assert got.dropna().tolist() == pytest.approx([i / 100 for i in range(101)])
    assert got.isna().sum() == 1
    normal = scale.scale(df, ["x"], "quantile_normal").toPandas()["x"].dropna().tolist()
    assert normal[50] == pytest.approx(0.0, abs=1e-9) and normal[0] == pytest.approx(-5.1993, abs=1e-3)


def test_components_explain_a_line(spark):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(3 * a + 2), float(b)) for a, b in rng.normal(size=(500, 2))]
    values, loadings, _ = scale.components(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert values[0] == pytest.approx(2.0, abs=0.1) and values[2] == pytest.approx(0.0, abs=1e-9)
    assert abs(loadings[0][0]) == pytest.approx(abs(loadings[0][1]), abs=1e-9)


def test_trimmed_mean_with_ties(spark):
    values = [0.0] * 10 + [5.0] * 70 + [100.0] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    expected = np.mean(sorted(values)[5:95])
    assert numeric.trimmed_means(df, ["x"], {"x": 100})["x"] == pytest.approx(expected)
