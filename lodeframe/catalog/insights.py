"""Hypothesis tests, quality, insight and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.catalog.base import Catalog
from lodeframe.catalog.templates import DIRTY_SQL, dirty
from lodeframe.operators import drift, insight, tests
from lodeframe.operators.profile import whole


def _tests(c: Catalog) -> None:
    pick = lambda d, *more: d.select("test", "statistic", *more)
    c.add("h1_normality", lambda t: pick(tests.normality(t.customer, "c_acctbal")),
          "WITH s AS (SELECT count(*) AS n, (avg(c_acctbal**3) - 3 * avg(c_acctbal) * avg(c_acctbal**2) + 2 * avg(c_acctbal)**3) / stddev_pop(c_acctbal)**3 AS s, kurtosis_pop(c_acctbal) AS k FROM customer) SELECT 'jarque_bera' AS test, n / 6 * (s * s + k * k / 4) AS statistic FROM s", {"statistic": 5})
    c.add("h2_ks_normal", lambda t: tests.ks_normal(t.events, "value"))
    two = lambda t: t.lineitem.where("l_returnflag in ('A', 'N')")
    group = "SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem {0} GROUP BY 1"
    c.add("h3_mann_whitney", lambda t: pick(tests.mann_whitney(two(t), "l_quantity", "l_returnflag")),
          "WITH x AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem WHERE l_returnflag IN ('A', 'N')) SELECT 'mann_whitney' AS test, sum(r) - count(*) * (count(*) + 1) / 2.0 AS statistic FROM x WHERE g = 'A'", {"statistic": 2})
    c.add("h4_t_test", lambda t: pick(tests.t_test(two(t), "l_extendedprice", "l_returnflag"), "df1"),
          "WITH g AS (" + group.format("WHERE l_returnflag IN ('A', 'N')") + "), a AS (SELECT * FROM g WHERE g = 'A'), b AS (SELECT * FROM g WHERE g = 'N') SELECT 't_test' AS test, (a.m - b.m) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS statistic, a.n + b.n - 2 AS df1 FROM a, b", {"statistic": 6})
    c.add("h3_mann_whitney_all", lambda t: pick(tests.mann_whitney(t.lineitem, "l_quantity", "l_linestatus")),
          "WITH x AS (SELECT l_linestatus AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem) SELECT 'mann_whitney' AS test, sum(r) - count(*) * (count(*) + 1) / 2.0 AS statistic FROM x WHERE g = 'F'", {"statistic": 2})
    c.add("h4_t_test_all", lambda t: pick(tests.t_test(t.lineitem, "l_extendedprice", "l_linestatus"), "df1"),
          "WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1), a AS (SELECT * FROM g WHERE g = 'F'), b AS (SELECT * FROM g WHERE g = 'O') SELECT 't_test' AS test, (a.m - b.m) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS statistic, a.n + b.n - 2 AS df1 FROM a, b", {"statistic": 6})
    f = "sum(n * (m - (SELECT sum(n * m) / sum(n) FROM g)) ** 2) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*)))"
    c.add("h5_anova", lambda t: pick(tests.anova(t.lineitem, "l_extendedprice", "l_returnflag"), "df1", "df2"),
          f"WITH g AS ({group.format('')}) SELECT 'anova' AS test, {f} AS statistic, (count(*) - 1)::DOUBLE AS df1, sum(n) - count(*) AS df2 FROM g", {"statistic": 6})
    c.add("h6_chi_square", lambda t: pick(tests.chi_square(t.orders, "o_orderstatus", "o_orderpriority"), "df1"),
          "WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS k FROM orders GROUP BY 1, 2), x AS (SELECT a, sum(k) AS ka FROM j GROUP BY 1), y AS (SELECT b, sum(k) AS kb FROM j GROUP BY 1) SELECT 'chi_square' AS test, sum(k) * (sum(k * k / (ka * kb)) - 1) AS statistic, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS df1 FROM j JOIN x USING (a) JOIN y USING (b)", {"statistic": 6})
    c.add("h6_chi_square_yates", lambda t: pick(tests.chi_square(t.labels, "quality", "toxic")),
          "WITH j AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS a, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS b, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS c, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS d, count(*)::DOUBLE AS n FROM labels) SELECT 'chi_square' AS test, n * greatest(0, abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) AS statistic FROM j", {"statistic": 6})
    c.add("h7_pearson", lambda t: pick(tests.pearson(t.lineitem, "l_quantity", "l_extendedprice")), "SELECT 'pearson' AS test, corr(l_quantity, l_extendedprice) AS statistic FROM lineitem", {"statistic": 8})
    c.add("h8_spearman", lambda t: pick(tests.spearman(dirty(t), "l_quantity", "l_tax")),
          f"WITH d AS (SELECT l_quantity AS a, l_tax AS b FROM {DIRTY_SQL} WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM d) SELECT 'spearman' AS test, corr(ra, rb) AS statistic FROM r", {"statistic": 8})
    c.add("h9_levene", lambda t: pick(tests.levene(t.lineitem, "l_extendedprice", "l_returnflag"), "df1"),
          "WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS mid FROM lineitem GROUP BY 1), z AS (SELECT l_returnflag, abs(l_extendedprice - mid) AS z FROM lineitem JOIN m USING (l_returnflag)), g AS (SELECT count(*)::DOUBLE AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM z GROUP BY l_returnflag) "
          f"SELECT 'levene' AS test, {f} AS statistic, (count(*) - 1)::DOUBLE AS df1 FROM g", {"statistic": 6})
    c.add("h10_discover", lambda t: tests.discover(t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_discount")).alias("cut"), "l_returnflag", "l_linestatus")))
    c.add("h10_discover_all", lambda t: tests.discover(t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_discount")).alias("cut"), "l_returnflag", "l_linestatus"), None))


def _insights(c: Catalog) -> None:
    c.add("i1_quality_score", lambda t: insight.quality_score(t.customer).select("completeness", "uniqueness", "grade"),
          "SELECT 100.0::DOUBLE AS completeness, round(70 + 30 * (100.0 * count(DISTINCT c_custkey) / count(*)) / 100, 2)::DOUBLE AS uniqueness, 'A' AS grade FROM customer")
    c.add("i2_anomalies", lambda t: insight.anomalies(t.customer.select("c_mktsegment", F.lit(1).alias("one"), F.expr("CASE WHEN c_custkey % 5 < 2 THEN c_acctbal END").alias("half"), F.expr("CASE WHEN c_custkey % 50 = 0 THEN c_nationkey END").alias("few"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'Aa' WHEN c_custkey % 3 = 0 THEN 'aa' ELSE 'b' END").alias("mixed"))).select("severity", "category", "column"),
          "SELECT * FROM (VALUES ('high', 'missingness', 'few'), ('medium', 'missingness', 'half'), ('medium', 'variance', 'one'), ('low', 'formatting', 'mixed')) v(severity, category, \"column\") WHERE (SELECT count(*) > 0 FROM customer)")
    c.add("i3_rank_features", lambda t: insight.rank_features(t.part.select("p_brand", "p_type", "p_size", "p_retailprice"), "p_retailprice"))
    c.add("i4_hypotheses", lambda t: insight.hypotheses(t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.pow("l_quantity", 6).alias("power"), "l_returnflag")))
    c.add("i5_period_compare", lambda t: insight.period_compare(t.orders.withColumn("year", F.year("o_orderdate")), "o_orderpriority", "o_totalprice", "year"),
          "SELECT o_orderpriority AS metric, sum(o_totalprice) FILTER (year(o_orderdate) = y - 1) AS previous, sum(o_totalprice) FILTER (year(o_orderdate) = y) AS latest, round(100.0 * (sum(o_totalprice) FILTER (year(o_orderdate) = y) - sum(o_totalprice) FILTER (year(o_orderdate) = y - 1)) / abs(sum(o_totalprice) FILTER (year(o_orderdate) = y - 1)), 2) AS change_pct FROM orders, (SELECT max(year(o_orderdate)) AS y FROM orders) GROUP BY 1", {"previous": 2, "latest": 2})
    c.add("i6_ml_readiness", lambda t: insight.ml_readiness(t.documents.join(t.labels, "doc_id").select("lang", "source", "n_chars", "toxic", "quality")))
    c.add("i6_readiness_components", lambda t: insight.readiness_components(t.documents.join(t.labels, "doc_id").select("lang", "source", "n_chars", "toxic", "quality")).where("measure <> 'signal'"),
          "WITH j AS (SELECT lang, source, n_chars, toxic, quality FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n, 5 * count(*) - count(lang) - count(source) - count(n_chars) - count(toxic) - count(quality) AS gaps, count(*) - count(quality) AS own FROM j), "
          "k AS (SELECT max(c)::DOUBLE / min(c) AS r FROM (SELECT count(*) AS c FROM j WHERE quality IS NOT NULL GROUP BY quality)), m AS (SELECT 'missing_pct' AS measure, 100.0::DOUBLE * gaps / (5 * n) AS value FROM n UNION ALL SELECT 'target_missing_pct', 100.0::DOUBLE * own / n FROM n "
          "UNION ALL SELECT 'imbalance', r FROM k UNION ALL SELECT 'ratio', n / 4.0::DOUBLE FROM n) SELECT measure, value, CASE measure WHEN 'missing_pct' THEN -least(value, 20) WHEN 'target_missing_pct' THEN -least(2 * value, 40) WHEN 'imbalance' THEN -least(greatest(value - 10, 0) * 0.5, 20) "
          "WHEN 'ratio' THEN CASE WHEN value < 10 THEN -20 WHEN value < 50 THEN -10 ELSE 0 END END::DOUBLE AS points FROM m", {"value": 6, "points": 6})
    c.add("i12_summary_facts", lambda t: insight.summary_facts(dirty(t).select("l_quantity", "l_tax", "l_returnflag")).where("section <> 'correlations'"),
          " UNION ALL ".join(f"SELECT 'nulls' AS section, '{x}' AS \"column\", 'share' AS metric, 1 - count({x}) / count(*) AS value FROM {DIRTY_SQL} UNION ALL SELECT 'numbers', '{x}', 'mean', avg({x}) FROM {DIRTY_SQL} UNION ALL SELECT 'numbers', '{x}', 'sd', stddev_samp({x}) FROM {DIRTY_SQL}" for x in ("l_quantity", "l_tax")), {"value": 5})
    c.add("f0_profile", lambda t: whole.profile(t.orders).select("column", "rows", "null_count", "distinct"),
          " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) AS rows, 0 AS null_count, count(DISTINCT {x}) AS \"distinct\" FROM orders" for x in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
    c.add("f0_profile_frames", lambda t: whole.profile_frames(t.part)[0]["keys"], "SELECT 'p_partkey' AS columns, 1 AS width, 1.0::DOUBLE AS uniqueness WHERE (SELECT count(*) = count(DISTINCT p_partkey) FROM part)")
    c.add("f29_column_quality", lambda t: whole.column_quality(dirty(t).select("l_quantity", "l_tax", "l_linenumber")).drop("issues"),
          " UNION ALL ".join(f"SELECT '{x}' AS \"column\", 100.0::DOUBLE - CASE WHEN p > 50 THEN 30 WHEN p > 20 THEN 15 WHEN p > 5 THEN 5 ELSE 0 END AS quality_score FROM (SELECT 100.0 * (count(*) - count({x})) / count(*) AS p FROM {DIRTY_SQL})" for x in ("l_quantity", "l_tax", "l_linenumber")))
    c.add("f30_explain_column", lambda t: whole.explain_column(t.lineitem.select("l_quantity", "l_extendedprice", "l_tax"), "l_extendedprice").where("fact in ('mean', 'median', 'std', 'skewness', 'kurtosis', 'unique')").drop("text"),
          " UNION ALL ".join(f"SELECT '{k}' AS fact, round(CAST({e} AS DOUBLE), 4) AS value FROM lineitem" for k, e in (("mean", "avg(l_extendedprice)"), ("median", "median(l_extendedprice)"), ("std", "stddev_samp(l_extendedprice)"), ("skewness", "skewness(l_extendedprice)"), ("kurtosis", "kurtosis(l_extendedprice)"), ("unique", "count(DISTINCT l_extendedprice)"))), {"value": 3})


def _drift(c: Catalog) -> None:
    old, new = "o_orderdate < timestamp'1998-01-01'", "o_orderdate >= timestamp'1998-01-01'"
    a, b = f"(SELECT o_totalprice AS x FROM orders WHERE {old.replace('timestamp', 'TIMESTAMP ')})", f"(SELECT o_totalprice * 1.2 AS x FROM orders WHERE {new.replace('timestamp', 'TIMESTAMP ')})"

    def sides(t):
        return t.orders.where(old).select(F.col("o_totalprice").alias("x")), t.orders.where(new).select((F.col("o_totalprice") * 1.2).alias("x"))

    c.add("i7_schema_drift", lambda t: drift.schema_drift(t.orders, t.orders.where(new).drop("o_custkey").withColumn("o_orderpriority", F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END")).withColumn("extra", F.lit(1))).where("change in ('added', 'removed', 'rows')"),
          f"SELECT 'rows' AS change, NULL AS \"column\", CAST(count(*) AS VARCHAR) AS before, CAST(count(*) FILTER ({new.replace('timestamp', 'TIMESTAMP ')}) AS VARCHAR) AS after FROM orders UNION ALL SELECT 'added', 'extra', NULL, 'int' UNION ALL SELECT 'removed', 'o_custkey', 'bigint', NULL")
    c.add("i8_psi", lambda t: drift.psi(*sides(t), "x"),
          f"WITH e AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT x FROM {a} UNION ALL SELECT x FROM {b})), k AS (SELECT unnest(range(10)) AS i), p AS (SELECT least(floor((x - lo) / (hi - lo) * 10), 9) AS i, count(*) / (SELECT count(*) FROM {a}) AS p FROM {a}, e GROUP BY 1), q AS (SELECT least(floor((x - lo) / (hi - lo) * 10), 9) AS i, count(*) / (SELECT count(*) FROM {b}) AS q FROM {b}, e GROUP BY 1), "
          "j AS (SELECT greatest(coalesce(p, 0), 1e-6) AS p, greatest(coalesce(q, 0), 1e-6) AS q FROM k LEFT JOIN p ON p.i = k.i LEFT JOIN q ON q.i = k.i) SELECT 'x' AS \"column\", sum((q - p) * ln(q / p)) AS psi FROM j", {"psi": 8})
    ks = f"WITH v AS (SELECT x, 1 AS a, 0 AS b FROM {a} UNION ALL SELECT x, 0, 1 FROM {b}), c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1), r AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM c) SELECT 'x' AS \"column\", max(abs(fa - fb)) AS statistic FROM r"
    c.add("i9_ks_2samp", lambda t: drift.ks_2samp(*sides(t), "x").drop("p_value"), ks, {"statistic": 8})
    c.add("i10_distribution_drift", lambda t: drift.distribution_drift(*sides(t)).select("column", "drift_detected", "mean_a", "mean_b"),
          f"SELECT 'x' AS \"column\", TRUE AS drift_detected, (SELECT avg(x) FROM {a}) AS mean_a, (SELECT avg(x) FROM {b}) AS mean_b", {"mean_a": 3, "mean_b": 3})
    c.add("i10_drift_report", lambda t: drift.drift_report(t.orders.where(old), t.orders.where(new)))


def register(c: Catalog) -> None:
    for part in (_tests, _insights, _drift):
        part(c)
