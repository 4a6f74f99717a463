"""Detectors, repairs and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.catalog.base import Catalog
from lodeframe.catalog.templates import DIRTY_SQL, dirty
from lodeframe.operators.detect import consistency as K
from lodeframe.operators.detect import features as X
from lodeframe.operators.detect import leaks as L
from lodeframe.operators.detect import outlying as O
from lodeframe.operators.detect import structure as S
from lodeframe.operators.detect import types as Y
from lodeframe.operators.detect.findings import as_frame
from lodeframe.operators.detect.plan import auto_clean, cleaning_plan

# Part names with planted slips of the pen, in both dialects.
SLIPS = "CASE WHEN p_partkey = 7 THEN concat(p_name, 'x') WHEN p_partkey = 11 THEN upper(p_name) ELSE p_name END"
SPIKES = "CASE WHEN l_orderkey % 997 = 0 THEN l_quantity * 100 ELSE l_quantity END"


def _structure(c: Catalog) -> None:
    cols = "l_partkey, l_quantity, l_returnflag"
    c.add("d1_duplicates", lambda t: as_frame(t.spark, S.find_duplicates(t.lineitem.select("l_partkey", "l_quantity", "l_returnflag"))).select("action", "rows_affected"),
          f"SELECT 'remove_exact_duplicates' AS action, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM lineitem)) AS rows_affected FROM lineitem")
    c.add("d2_duplicate_columns", lambda t: S.duplicate_columns(t.orders.select("o_orderkey", "o_custkey", F.expr("CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE o_custkey END").alias("customer"))),
          "SELECT 'o_custkey' AS col1, 'customer' AS col2, round(avg((o_custkey = CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE o_custkey END)::INT), 4) AS similarity, 'customer' AS \"drop\" FROM orders")
    c.add("d3_derived_columns", lambda t: S.derived_columns(t.part.select("p_size", "p_retailprice", (F.col("p_retailprice") * 2.5 + 1).alias("gross"))),
          "SELECT 'p_retailprice' AS col1, 'gross' AS col2, 2.5::DOUBLE AS slope, 1.0::DOUBLE AS intercept, 1.0::DOUBLE AS r_squared", {"slope": 6, "intercept": 5, "r_squared": 6})
    c.add("d4_near_pairs", lambda t: S.near_pairs(t.part.select(F.expr(SLIPS).alias("n")), "n"),
          f"WITH v AS (SELECT DISTINCT {SLIPS} AS n FROM part) SELECT a.n AS a, b.n AS b, jaro_winkler_similarity(a.n, b.n) AS similarity FROM v a, v b WHERE a.n < b.n AND jaro_winkler_similarity(a.n, b.n) >= 0.85", {"similarity": 9})
    c.add("d4_near_duplicates", lambda t: S.near_duplicates(t.part.select(F.expr(SLIPS).alias("n")), "n"),
          f"WITH RECURSIVE v AS (SELECT {SLIPS} AS n, count(*) AS k FROM part GROUP BY 1), e AS (SELECT a.n AS a, b.n AS b FROM v a, v b WHERE a.n <> b.n AND jaro_winkler_similarity(a.n, b.n) >= 0.85), "
          "r AS (SELECT a AS root, b AS n FROM e UNION SELECT r.root, e.b FROM r JOIN e ON r.n = e.a) SELECT min(root) AS cluster, r.n AS value, any_value(k) AS rows FROM r JOIN v ON r.n = v.n GROUP BY r.n")
    # More distinct values than fit a list on the driver.
    many = "substr(md5(c_name), 1, 10)"
    pairs = f"WITH v AS (SELECT DISTINCT {many} AS n FROM customer), e AS (SELECT a.n AS a, b.n AS b, jaro_winkler_similarity(a.n, b.n) AS similarity FROM v a, v b WHERE a.n < b.n AND jaro_winkler_similarity(a.n, b.n) >= 0.85)"
    c.add("d4_near_pairs_many", lambda t: S.near_pairs(t.customer.select(F.expr(many).alias("n")), "n"), f"{pairs} SELECT * FROM e", {"similarity": 9})
    c.add("d4_near_duplicates_many", lambda t: S.near_duplicates(t.customer.select(F.expr(many).alias("n")), "n"),
          pairs.replace("WITH v", "WITH RECURSIVE v") + f", u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS root, b AS n FROM u UNION SELECT r.root, u.b FROM r JOIN u ON r.n = u.a) "
          f"SELECT min(root) AS cluster, r.n AS value, any_value(k) AS rows FROM r JOIN (SELECT {many} AS n, count(*) AS k FROM customer GROUP BY 1) USING (n) GROUP BY r.n")
    c.add("d5_missing_plan", lambda t: S.missing_plan(dirty(t).drop("l_shipdate", "l_returnflag")).select("column", "null_count", "null_pct"),
          " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) - count({x}) AS null_count, round(100.0 * (count(*) - count({x})) / count(*), 2) AS null_pct FROM {DIRTY_SQL}" for x in ("l_quantity", "l_tax", "l_discount")))
    c.add("d6_mcar_test", lambda t: S.mcar_test(dirty(t).select("l_extendedprice", "l_tax", "l_linenumber")))
    numbers = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    signals = " UNION ALL ".join(f"SELECT '{a}' AS \"column\", '{b}' AS correlated_with, corr(({a} IS NULL)::INT, coalesce({b}, 0)) AS correlation FROM {DIRTY_SQL}" for a in ("l_quantity", "l_tax", "l_discount") for b in numbers if a != b)
    c.add("d7_mar_signals", lambda t: S.mar_signals(dirty(t), 0.02), f"SELECT * FROM ({signals}) WHERE abs(correlation) > 0.02", {"correlation": 8})
    c.add("d8_nullity_matrix", lambda t: S.nullity_matrix(dirty(t)))
    c.add("d8_nullity_matrix_all", lambda t: S.nullity_matrix(dirty(t), None))
    c.add("d8_null_overlap", lambda t: S.null_overlap(dirty(t)),
          " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS both FROM {DIRTY_SQL}" for a, b in (("l_quantity", "l_tax"), ("l_quantity", "l_discount"), ("l_tax", "l_discount"))))


def _outliers(c: Catalog) -> None:
    def x(t):
        return dirty(t).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("x"))

    d = f"WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity AS value FROM {DIRTY_SQL}), s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, median(value) AS mid, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM d), m AS (SELECT median(abs(value - mid)) AS mad FROM d, s)"
    c.add("d9_iqr", lambda t: O.outliers(x(t), "x", "iqr", "k"),
          f"{d} SELECT key, value, CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN 'iqr_extreme' ELSE 'iqr_mild' END AS method, abs(value - mid) / (q3 - q1) AS score FROM d, s WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)", {"score": 2})
    c.add("d10_zscore", lambda t: O.outliers(x(t), "x", "zscore", "k"), f"{d} SELECT key, value, 'zscore' AS method, (value - m) / sd AS score FROM d, s WHERE abs((value - m) / sd) > 3", {"score": 2})
    c.add("d11_mad", lambda t: O.outliers(x(t), "x", "mad", "k"), f"{d} SELECT key, value, 'modified_zscore' AS method, 0.6745 * (value - mid) / mad AS score FROM d, s, m WHERE abs(0.6745 * (value - mid) / mad) > 3.5", {"score": 2})
    c.add("d12_envelope", lambda t: O.outliers(t.events, "value", "envelope", "event_id", "ts", window=500).drop("score"),
          "WITH w AS (SELECT event_id AS key, value, median(value) OVER r AS mid, stddev_samp(value) OVER r AS sd FROM events WINDOW r AS (ORDER BY ts, event_id ROWS BETWEEN 250 PRECEDING AND 249 FOLLOWING)) SELECT key, value, 'envelope' AS method FROM w WHERE value > mid + 2.5 * sd OR value < mid - 2.5 * sd")
    usual = (
        "WITH n AS (SELECT *, greatest(7, count(*) OVER () // 20) AS n FROM events WHERE value IS NOT NULL), "
        "w AS (SELECT event_id AS key, value, median(value) OVER r AS mid, stddev_samp(value) OVER r AS sd FROM n "
        "WINDOW r AS (ORDER BY ts, event_id ROWS BETWEEN n // 2 PRECEDING AND (n - 1) // 2 FOLLOWING)) "
        "SELECT key, value, 'envelope' AS method FROM w WHERE value > mid + 2.5 * sd OR value < mid - 2.5 * sd"
    )
    # The window of a twentieth of the rows, in tasks of the usual size and in cells far smaller than the window.
    c.add("d12_envelope_default", lambda t: O.envelope(t.events, "value", "event_id", "ts").drop("score"), usual)
    c.add("d12_envelope_split", lambda t: O.envelope(t.events, "value", "event_id", "ts", rows=50).drop("score"), usual)
    c.add("d13_business_rule", lambda t: O.outliers(t.customer.select("c_custkey", (F.col("c_acctbal")).alias("amount")), "amount", "business_rule", "c_custkey").drop("score"),
          "SELECT c_custkey AS key, c_acctbal AS value, 'business_rule' AS method FROM customer WHERE c_acctbal < 0")

    def parts(t):
        return t.part.select("p_partkey", F.expr("CASE WHEN p_partkey % 400 = 3 THEN p_size * 8 ELSE p_size END").alias("size"), "p_retailprice", (F.col("p_partkey") % 31).alias("m"))

    cols = ["size", "p_retailprice", "m"]
    z = ("WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 400 = 3 THEN p_size * 8 ELSE p_size END AS a, p_retailprice AS b, p_partkey % 31 AS c FROM part), v AS (SELECT id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c FROM p), "
         "j AS (SELECT x.id, y.id AS o, sqrt((x.a - y.a)^2 + (x.b - y.b)^2 + (x.c - y.c)^2) AS d FROM v x, v y)")
    c.add("d14_isolation_forest", lambda t: O.isolation_forest(parts(t), cols, "p_partkey"))
    c.add("d15_lof", lambda t: O.lof(parts(t), cols, "p_partkey"),
          f"{z}, n AS (SELECT id, o, d FROM j WHERE id <> o QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, o) <= 20), k AS (SELECT id AS o, max(d) AS kd FROM n GROUP BY 1), l AS (SELECT id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k USING (o) GROUP BY 1), "
          "f AS (SELECT n.id, avg(b.lrd) / any_value(a.lrd) AS score FROM n JOIN l b ON n.o = b.id JOIN l a ON n.id = a.id GROUP BY 1) SELECT id, score FROM f WHERE score > (SELECT quantile_cont(score, 0.95) FROM f)", {"score": 6})
    c.add("d16_dbscan_noise", lambda t: O.dbscan_noise(parts(t), cols, "p_partkey"),
          f"{z}, n AS (SELECT id, count(*) AS n FROM j WHERE d <= 2 GROUP BY 1) SELECT id FROM n WHERE n < 5 AND id NOT IN (SELECT j.id FROM j JOIN n m ON j.o = m.id WHERE d <= 2 AND m.n >= 5)")
    c.add("d17_multivariate", lambda t: O.multivariate_outliers(parts(t), cols, "p_partkey"))
    c.add("d18_score_outliers", lambda t: O.score_outliers(x(t), "x", "k").drop("methods"))
    c.add("d18_outlier_plan", lambda t: O.outlier_plan(t.part, "p_partkey"))


def _types(c: Catalog) -> None:
    wild = {
        "d": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"), "m": ("concat('$', cast(o_custkey AS string))", "'$' || o_custkey"),
        "b": ("CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END", ""), "j": ("concat('{\"a\": ', cast(o_custkey AS string), '}')", ""),
        "p": ("CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' ELSE o_orderstatus END", ""), "x": ("CASE WHEN o_orderkey % 4 = 0 THEN 'abc' ELSE cast(o_custkey AS string) END", ""),
    }
    c.add("d19_detect_types", lambda t: Y.detect_types(t.orders.select(*[F.expr(e[0]).alias(k) for k, e in wild.items()], (F.col("o_orderkey") % 7).alias("code"))).drop("share"),
          "SELECT 'd' AS \"column\", 'datetime' AS detected, count(*) AS rows_affected FROM orders UNION ALL SELECT 'm', 'currency', count(*) FROM orders UNION ALL SELECT 'b', 'boolean', count(*) FROM orders UNION ALL SELECT 'j', 'json', count(*) FROM orders "
          "UNION ALL SELECT 'p', 'pseudo_null', count(*) FILTER (o_orderkey % 9 = 0) FROM orders UNION ALL SELECT 'x', 'currency', count(*) FROM orders WHERE (SELECT count(*) FILTER (o_orderkey % 4 <> 0) > 0.7 * count(*) FROM orders) HAVING count(*) > 0 "
          "UNION ALL SELECT 'x', 'mixed', count(*) FILTER (o_orderkey % 4 = 0) FROM orders UNION ALL SELECT 'code', 'integer_category', 7")
    c.add("d20_structured_text", lambda t: Y.detect_types(t.pages.select("url", F.expr("concat('u', cast(page_id AS string), '@mail.org')").alias("mail"), F.expr("concat('10.0.0.', cast(page_id % 256 AS string))").alias("ip"))).select("column", "detected"),
          "SELECT * FROM (VALUES ('url', 'url'), ('mail', 'email'), ('ip', 'ip_address')) v(\"column\", detected)")
    c.add("d21_integer_categories", lambda t: Y.detect_types(t.lineitem.select("l_linenumber", "l_orderkey")).drop("share"), "SELECT 'l_linenumber' AS \"column\", 'integer_category' AS detected, count(DISTINCT l_linenumber) AS rows_affected FROM lineitem")
    c.add("d22_pseudo_nulls", lambda t: Y.detect_types(t.part.select(F.expr("CASE WHEN p_size % 10 = 0 THEN ' n/a' ELSE p_type END").alias("v"))).where("detected = 'pseudo_null'"),
          "SELECT 'v' AS \"column\", 'pseudo_null' AS detected, round(avg((p_size % 10 = 0)::INT), 3) AS share, count(*) FILTER (p_size % 10 = 0) AS rows_affected FROM part")
    c.add("d23_mixed_types", lambda t: Y.detect_types(t.part.select(F.expr("CASE WHEN p_size % 5 = 0 THEN p_type ELSE cast(p_size AS string) END").alias("v"))).where("detected = 'mixed'"),
          "SELECT 'v' AS \"column\", 'mixed' AS detected, round(avg((p_size % 5 = 0)::INT), 3) AS share, count(*) FILTER (p_size % 5 = 0) AS rows_affected FROM part")
    c.add("d24_text_columns", lambda t: Y.text_columns(t.benchmark.select("text")).unionByName(Y.text_columns(t.pages.select("html"))))
    c.add("d24_text_columns_documents", lambda t: Y.text_columns(t.documents.select("text")))


def _features(c: Catalog) -> None:
    c.add("d25_encoding_plan", lambda t: X.encoding_plan(t.part.select("p_name", "p_brand", "p_type", (F.col("p_partkey") % 12).cast("int").alias("month"), F.expr("CASE WHEN p_size > 20 THEN 'a' ELSE 'b' END").alias("two"))),
          "SELECT 'p_name' AS \"column\", count(DISTINCT p_name) AS cardinality, 'frequency_encode' AS strategy, NULL::INT AS period FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), 'frequency_encode', NULL FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type), 'ordinal_encode', NULL FROM part UNION ALL SELECT 'month', 12, 'cyclical_encode', 12 UNION ALL SELECT 'two', 2, 'label_encode', NULL")
    names = ("year", "month", "quarter", "week", "day", "dayofweek")
    c.add("d26_datetime_plan", lambda t: X.datetime_plan(t.orders),
          "SELECT 'o_orderdate' AS \"column\", * FROM (VALUES " + ", ".join(f"('part', '{n}')" for n in (*names, "month_name", "day_name")) + ", " + ", ".join(f"('flag', '{f}')" for f in ("is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end")) + ") v(kind, name)")
    c.add("d27_delta_plan", lambda t: X.delta_plan(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", "l_shipdate")),
          "WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT avg(date_diff('second', o_orderdate, l_shipdate)) / 86400 AS m, min(o_orderdate) <= min(l_shipdate) AS first FROM j) SELECT CASE WHEN first THEN 'o_orderdate' ELSE 'l_shipdate' END AS earlier, CASE WHEN first THEN 'l_shipdate' ELSE 'o_orderdate' END AS later, CASE WHEN first THEN m ELSE -m END AS mean, 'days' AS unit FROM f", {"mean": 6})
    c.add("d28_is_time_series", lambda t: X.is_time_series(t.events, "ts").drop("cv"),
          "WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6 AS gap FROM events) SELECT 'ts' AS \"column\", TRUE AS time_series, count(*) AS n, count(*) FILTER (gap > 0) / (count(*) - 1) AS rising, CASE WHEN median(gap) < 120 THEN 'minutes' ELSE 'hours' END AS granularity, median(gap) AS median_step, FALSE AS regular FROM g", {"median_step": 5, "rising": 6})
    c.add("d29_scaling_plan", lambda t: X.scaling_plan(t.events.select("value", (F.col("value") / 500).alias("share"))).drop("strategy"),
          "WITH d AS (SELECT value AS x FROM events), s AS (SELECT skewness(x) AS skewness, kurtosis(x) AS kurtosis, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, count(*) AS n FROM d), o AS (SELECT 100.0 * count(*) / any_value(n) AS p FROM d, s WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) "
          "SELECT unnest(['value', 'share']) AS \"column\", skewness, kurtosis, p AS outlier_pct FROM s, o", {"skewness": 6, "kurtosis": 5, "outlier_pct": 6})
    c.add("d30_variance_plan", lambda t: X.variance_plan(t.lineitem.select("l_tax", F.lit(1).alias("one"), F.expr("CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END").alias("rare"))),
          "SELECT 'one' AS \"column\", 'drop_zero_variance' AS action, 100.0::DOUBLE AS top_pct UNION ALL SELECT 'rare', 'drop_near_zero_variance', round(100.0 * avg((l_orderkey % 50 <> 0)::INT), 1) FROM lineitem")
    c.add("d31_correlation_plan", lambda t: X.correlation_plan(t.lineitem.select("l_quantity", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_extendedprice")),
          "SELECT 'net' AS col1, 'l_extendedprice' AS col2, round(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 4) AS correlation, 'l_extendedprice' AS \"drop\" FROM lineitem")
    c.add("d32_vif_plan", lambda t: X.vif_plan(t.lineitem.select("l_quantity", "l_tax", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))).select("column"),
          "SELECT unnest(['l_extendedprice', 'net']) AS \"column\"")
    c.add("d33_mi_plan", lambda t: X.mi_plan(t.lineitem.select("l_linenumber", "l_tax", "l_discount", "l_returnflag"), "l_returnflag").select("column"), "SELECT unnest(['l_linenumber', 'l_tax', 'l_discount']) AS \"column\"")
    c.add("d34_pca_plan", lambda t: X.pca_plan(t.lineitem.select("l_quantity", "l_extendedprice", "l_tax", (F.col("l_extendedprice") * 2 + 1).alias("twice"))))
    c.add("d35_feature_clusters", lambda t: X.feature_clusters(t.lineitem.select("l_quantity", "l_tax", "l_discount", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))),
          "SELECT * FROM (VALUES (1, 'l_extendedprice', TRUE), (1, 'net', FALSE)) v(cluster, \"column\", representative)")
    c.add("d36_imbalance_plan", lambda t: X.imbalance_plan(t.labels, "quality"),
          "WITH k AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT round(max(n) / min(n), 2) AS r FROM k) SELECT 'quality' AS target, 2 AS classes, r AS ratio, CASE WHEN r < 1.5 THEN 'balanced' WHEN r < 5 THEN 'mild' WHEN r < 20 THEN 'moderate' ELSE 'severe' END AS severity, CASE WHEN r < 5 THEN 'class_weights' WHEN r < 20 THEN 'smote' ELSE 'smoteenn' END AS strategy FROM r")


def _consistency(c: Catalog) -> None:
    messy = "CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) WHEN p_partkey % 11 = 0 THEN concat(p_name, '  ') ELSE p_name END"
    c.add("d37_text_consistency", lambda t: K.text_consistency(t.part.select(F.expr(messy).alias("n"), "p_type")),
          f"WITH v AS (SELECT {messy} AS n FROM part), k AS (SELECT DISTINCT n FROM v) SELECT 'n' AS \"column\", 'casing' AS issue, least(count(*) FILTER (n = upper(n)), count(*) FILTER (n = lower(n))) AS count FROM k "
          "UNION ALL SELECT 'n', 'whitespace', 2 * count(*) FILTER (n LIKE '%  ') FROM v")
    place = "CASE c_custkey % 5 WHEN 0 THEN 'USA' WHEN 1 THEN 'u.s.a' WHEN 2 THEN 'UK' WHEN 3 THEN 'United Kingdom' ELSE 'Peru' END"
    c.add("d38_synonyms", lambda t: K.synonyms(t.customer.select(F.expr(place).alias("country")), "country"),
          f"WITH k AS (SELECT {place} AS v, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT *, CASE WHEN v IN ('USA', 'u.s.a') THEN 'a' WHEN v <> 'Peru' THEN 'b' END AS g FROM k) SELECT first_value(v) OVER (PARTITION BY g ORDER BY n DESC, v) AS canonical, v AS variant, n AS rows FROM g WHERE g IS NOT NULL")
    twice = "CASE WHEN p_partkey % 2 = 0 THEN upper(md5(p_brand || CAST(p_size AS VARCHAR(9)) || p_type)) ELSE md5(p_brand || CAST(p_size AS VARCHAR(9)) || p_type) END"
    c.add("d38_synonyms_many", lambda t: K.synonyms(t.part.select(F.expr(twice).alias("n")), "n"),
          f"WITH k AS (SELECT {twice} AS v, count(*) AS n FROM part GROUP BY 1), g AS (SELECT *, count(*) OVER (PARTITION BY lower(v)) AS k FROM k) SELECT first_value(v) OVER (PARTITION BY lower(v) ORDER BY n DESC, v) AS canonical, v AS variant, n AS rows FROM g WHERE k > 1")
    phone = "CASE c_custkey % 3 WHEN 0 THEN '+15551234567' WHEN 1 THEN '(555) 123-4567' ELSE '555-123-4567' END"
    c.add("d39_phone_formats", lambda t: K.format_mix(t.customer.select(F.expr(phone).alias("phone")), "phone"),
          "SELECT CASE c_custkey % 3 WHEN 0 THEN 'e164' WHEN 1 THEN 'us_parens' ELSE 'us_dashed' END AS format, count(*) AS count FROM customer GROUP BY 1")
    c.add("d39_url_formats", lambda t: K.format_mix(t.pages, "url"),
          "SELECT format, count(*) AS count FROM (SELECT unnest([CASE WHEN starts_with(url, 'http://') THEN 'http' END, CASE WHEN starts_with(url, 'https://') THEN 'https' END, CASE WHEN suffix(url, '/') THEN 'trailing_slash' END, CASE WHEN contains(url, 'utm_') THEN 'tracking' END, CASE WHEN regexp_matches(url, '%[0-9a-fA-F]{2}') THEN 'encoded' END]) AS format FROM pages) WHERE format IS NOT NULL GROUP BY 1")
    c.add("d39_email_issues", lambda t: K.format_mix(t.customer.select(F.expr("CASE c_custkey % 4 WHEN 0 THEN 'A@b.org' WHEN 1 THEN 'x@mailinator.com' WHEN 2 THEN 'no mail' ELSE 'a@b.org' END").alias("email")), "email"),
          "SELECT 'upper_case' AS format, count(*) FILTER (c_custkey % 4 = 0) AS count FROM customer UNION ALL SELECT 'disposable', count(*) FILTER (c_custkey % 4 = 1) FROM customer UNION ALL SELECT 'invalid', count(*) FILTER (c_custkey % 4 = 2) FROM customer UNION ALL SELECT 'white_space', count(*) FILTER (c_custkey % 4 = 2) FROM customer")
    c.add("d39_currency_formats", lambda t: K.format_mix(t.customer.select(F.expr("CASE c_custkey % 2 WHEN 0 THEN '$5' ELSE '7 EUR' END").alias("paid")), "paid", "currency"),
          "SELECT CASE c_custkey % 2 WHEN 0 THEN '$' ELSE 'EUR' END AS format, count(*) AS count FROM customer GROUP BY 1")
    c.add("d40_precision_mix", lambda t: K.precision_mix(t.lineitem, "l_extendedprice"),
          "SELECT CASE WHEN l_extendedprice = round(l_extendedprice, 0) THEN 0 WHEN l_extendedprice = round(l_extendedprice, 1) THEN 1 ELSE 2 END AS decimals, count(*) AS count FROM lineitem GROUP BY 1")
    c.add("d41_unit_mix", lambda t: K.unit_mix(t.customer.select(F.expr("CASE c_custkey % 2 WHEN 0 THEN 70 + c_custkey % 9 ELSE (70 + c_custkey % 9) * 2.54 END").cast("double").alias("size")), "size").select("column", "peaks", "suspected"),
          "SELECT 'size' AS \"column\", 2 AS peaks, 'inches/cm' AS suspected")
    c.add("d45_repair_typos", lambda t: K.repair_typos(t.part.select("p_partkey", F.expr(SLIPS).alias("n")), "n", "p_partkey").drop("confidence"),
          f"WITH v AS (SELECT p_partkey, {SLIPS} AS n FROM part), k AS (SELECT n, count(*) AS c FROM v GROUP BY 1), j AS (SELECT p_partkey, v.n, f.n AS f, levenshtein(lower(v.n), lower(f.n)) AS d, f.c FROM v JOIN k ON v.n = k.n AND k.c = 1, k f WHERE f.c > 1) "
          "SELECT CAST(p_partkey AS VARCHAR) AS key, 'n' AS \"column\", n AS current, f AS suggested, 'typo' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, c DESC, f) AS r FROM j WHERE d <= greatest(2, greatest(length(n), length(f)) * 0.3)) WHERE r = 1 AND d > 0")
    slips = "CASE WHEN p_partkey % 97 = 5 THEN md5(CAST(p_partkey % 700 AS VARCHAR(9))) || 'x' ELSE md5(CAST(p_partkey % 700 AS VARCHAR(9))) END"
    c.add("d45_repair_typos_many", lambda t: K.repair_typos(t.part.select("p_partkey", F.expr(slips).alias("n")), "n", "p_partkey").drop("confidence"),
          f"WITH v AS (SELECT p_partkey, {slips} AS n FROM part), k AS (SELECT n, count(*) AS c FROM v GROUP BY 1), j AS (SELECT p_partkey, v.n, f.n AS f, levenshtein(v.n, f.n) AS d, f.c FROM v JOIN k ON v.n = k.n AND k.c = 1, k f WHERE f.c > 1) "
          "SELECT CAST(p_partkey AS VARCHAR) AS key, 'n' AS \"column\", n AS current, f AS suggested, 'typo' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, c DESC, f) AS r FROM j WHERE d <= greatest(2, greatest(length(n), length(f)) * 0.3)) WHERE r = 1 AND d > 0")
    c.add("d48_cell_repairs_all", lambda t: K.cell_repairs(t.part.select("p_partkey", F.expr(slips).alias("n")), "p_partkey", None).select("key", "current", "suggested"),
          f"WITH v AS (SELECT p_partkey, {slips} AS n FROM part), k AS (SELECT n, count(*) AS c FROM v GROUP BY 1), j AS (SELECT p_partkey, v.n, f.n AS f, levenshtein(v.n, f.n) AS d, f.c FROM v JOIN k ON v.n = k.n AND k.c = 1, k f WHERE f.c > 1) "
          "SELECT CAST(p_partkey AS VARCHAR) AS key, n AS current, f AS suggested FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, c DESC, f) AS r FROM j WHERE d <= greatest(2, greatest(length(n), length(f)) * 0.3)) WHERE r = 1 AND d > 0")
    c.add("d46_repair_numeric", lambda t: K.repair_numeric(t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.expr(SPIKES).alias("q")), "q", "k").select("key", F.col("suggested").cast("double").alias("suggested"), "confidence"),
          f"WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS k, {SPIKES} AS q FROM lineitem), s AS (SELECT avg(q) AS m, stddev_samp(q) AS sd FROM d) SELECT CAST(k AS VARCHAR) AS key, coalesce(CASE WHEN abs(q / 10 - m) < 2 * sd THEN round(q / 10, 2) END, CASE WHEN abs(q / 100 - m) < 2 * sd THEN round(q / 100, 2) END, round(m, 2)) AS suggested, round(greatest(0.5, 1 - sd / abs(q - m)), 2) AS confidence FROM d, s WHERE abs(q - m) / sd > 4")
    odd = "CASE WHEN o_orderkey % 20 = 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"
    c.add("d47_repair_dates", lambda t: K.repair_dates(t.orders.select("o_orderkey", F.expr(odd).alias("d")), "d", "o_orderkey").select("key", "suggested"), "SELECT CAST(o_orderkey AS VARCHAR) AS key, 'as iso' AS suggested FROM orders WHERE o_orderkey % 20 = 0")
    c.add("d48_cell_repairs", lambda t: K.cell_repairs(t.part.select("p_partkey", F.expr(SLIPS).alias("n"), "p_size", "p_type"), "p_partkey"))


def _leaks(c: Catalog) -> None:
    c.add("d42_perfect_predictors", lambda t: L.perfect_predictors(t.orders.select("o_totalprice", (F.col("o_totalprice") * 1.1).alias("gross"), "o_orderstatus", F.lower("o_orderstatus").alias("s")), "o_orderstatus"), "SELECT 's' AS \"column\", 'purity' AS kind, 1.0::DOUBLE AS score")
    c.add("d42_correlated", lambda t: L.perfect_predictors(t.orders.select("o_totalprice", (F.col("o_totalprice") * 1.1).alias("gross"), "o_custkey"), "o_totalprice"), "SELECT 'gross' AS \"column\", 'correlation' AS kind, 1.0::DOUBLE AS score")
    c.add("d43_temporal_proxies", lambda t: L.temporal_proxies(t.orders.select("o_orderdate", F.expr("o_orderdate + interval 3 days").alias("due"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("y")), "y"),
          "SELECT unnest(['o_orderdate', 'due']) AS \"column\", 'temporal' AS kind, 1.0::DOUBLE AS score")
    c.add("d44_id_leaks", lambda t: L.id_leaks(t.part.select(F.col("p_partkey").alias("part_id"), "p_retailprice", "p_size"), "p_retailprice"),
          "SELECT 'part_id' AS \"column\", 'id' AS kind, round(abs(corr(p_partkey, p_retailprice)), 4) AS score FROM part WHERE (SELECT abs(corr(p_partkey, p_retailprice)) > 0.3 FROM part)")
    c.add("d44_leakage", lambda t: L.leakage(t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("end_date"), "o_orderstatus"), "o_orderstatus").select("column", "kind"), "SELECT 'end_date' AS \"column\", 'future_name' AS kind")


def _plans(c: Catalog) -> None:
    c.add("d0_cleaning_plan", lambda t: cleaning_plan(t.part, "p_partkey"))
    mess = "CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' ELSE cast(o_custkey AS {0}) END"
    c.add("c65_auto_clean", lambda t: auto_clean(t.orders.select("o_orderkey", F.expr(mess.format("string")).alias("x"), F.lit(1).alias("one"))),
          "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey::DOUBLE END AS x FROM orders")


def register(c: Catalog) -> None:
    for part in (_structure, _outliers, _types, _features, _consistency, _leaks, _plans):
        part(c)
