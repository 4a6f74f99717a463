"""Profiles of columns, tables, relations and series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lodeframe.catalog.base import Catalog
from lodeframe.catalog.templates import DIRTY_SQL, dirty
from lodeframe.operators import keys
from lodeframe.operators.profile import columns as C
from lodeframe.operators.profile import numeric as N
from lodeframe.operators.profile import relations as R
from lodeframe.operators.profile import semantics as S
from lodeframe.operators.profile.series import decompose

NOW = dt.datetime(2000, 1, 1)


def _numbers(c: Catalog) -> None:
    def x(t):
        return dirty(t).select(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))

    d = f"WITH d AS (SELECT l_quantity AS x, l_tax AS y FROM {DIRTY_SQL})"
    metrics = {
        "n": "count({0})", "min": "min({0})", "max": "max({0})", "range": "max({0}) - min({0})", "sum": "sum({0})", "mean": "avg({0})", "sd": "stddev_samp({0})",
        "var": "var_samp({0})", "cv": "abs(stddev_samp({0}) / avg({0}))", "skew": "(avg({0}**3) - 3 * avg({0}) * avg({0}**2) + 2 * avg({0})**3) / stddev_pop({0})**3",
        "kurt": "kurtosis_pop({0})", "zero": "count(*) FILTER ({0} = 0)", "neg": "count(*) FILTER ({0} < 0)", "pos": "count(*) FILTER ({0} > 0)", "whole": "count(*) FILTER ({0} = floor({0}))",
        "iqr": "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)", **{f"p{p}": f"quantile_cont({{0}}, {p / 100})" for p in N.PERCENTILES},
    }
    union = " UNION ALL ".join(f"SELECT '{col}' AS \"column\", '{m}' AS metric, CAST({e.format(col)} AS DOUBLE) AS value FROM d" for col in "xy" for m, e in metrics.items())
    trims = " UNION ALL ".join(
        f"SELECT '{col}', 'trimmed_mean_5', avg({col}) FROM (SELECT {col}, row_number() OVER (ORDER BY {col}) - 1 AS r, floor(0.05 * count(*) OVER ()) AS k, count(*) OVER () AS n FROM d WHERE {col} IS NOT NULL) WHERE r >= k AND r < n - k" for col in "xy")
    means = "SELECT 'x', 'geometric_mean', exp(avg(ln(x))) FROM d UNION ALL SELECT 'x', 'harmonic_mean', 1 / avg(1 / x) FROM d"
    c.add("f5_numeric_profile", lambda t: N.numeric_profile(x(t), ["x", "y"]), f"{d} {union} UNION ALL {trims} UNION ALL {means}", {"value": 4})
    c.add("f5_modes", lambda t: N.numeric_modes(t.part, ["p_size"]), "SELECT 'p_size' AS \"column\", p_size::DOUBLE AS value FROM part GROUP BY p_size QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1 ORDER BY 2 LIMIT 5")
    box = "q AS (SELECT quantile_cont(x, 0.25) AS q1, median(x) AS m, quantile_cont(x, 0.75) AS q3 FROM d), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"
    c.add("f6_box_plot", lambda t: N.box_plot(x(t), ["x"]),
          f"{d}, {box} SELECT 'x' AS \"column\", any_value(q1) AS q1, any_value(m) AS median, any_value(q3) AS q3, min(x) FILTER (x >= lo) AS whisker_low, max(x) FILTER (x <= hi) AS whisker_high, count(*) FILTER (x < lo OR x > hi) AS outliers FROM d, f")
    c.add("f6_box_outliers", lambda t: N.box_outliers(x(t), "x", None),
          f"{d}, {box}, o AS (SELECT x FROM d, f WHERE x < lo OR x > hi) SELECT x AS value FROM o")
    h = "q AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM s), k AS (SELECT *, least(200, greatest(1, ceil((hi - lo) / (2 * iqr * n ** (-1.0 / 3)))))::INT AS bins FROM q)"
    c.add("f7_fd_histogram", lambda t: N.fd_histogram(t.orders, "o_totalprice"),
          f"WITH s AS (SELECT o_totalprice AS v FROM orders), {h}, c AS (SELECT least(floor((v - lo) / (hi - lo) * bins), bins - 1)::INT AS bin, count(*) AS n FROM s, k GROUP BY 1) "
          "SELECT b AS bin, lo + b * (hi - lo) / bins AS low, lo + (b + 1) * (hi - lo) / bins AS high, coalesce(c.n, 0) AS count FROM k, (SELECT unnest(range(200))::INT AS b) LEFT JOIN c ON c.bin = b WHERE b < bins", {"low": 3, "high": 3})
    c.add("f8_kde", lambda t: N.kde(t.customer, "c_acctbal").withColumn("density", F.col("density") * 1e5),
          "WITH s AS (SELECT c_acctbal AS v FROM customer), k AS (SELECT count(*) AS n, min(v) - 0.1 * (max(v) - min(v)) AS a, 1.2 * (max(v) - min(v)) / 199 AS w, stddev_samp(v) * count(*) ** (-0.2) AS h FROM s), "
          "p AS (SELECT unnest(range(200))::INT AS point) SELECT point, any_value(a + point * w) AS x, sum(exp(-0.5 * ((a + point * w - v) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())) * 1e5 AS density FROM p, k, s GROUP BY point", {"x": 4, "density": 4})
    c.add("f9_qq", lambda t: N.qq(t.events, "value").drop("theoretical"),
          "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rank FROM events) SELECT rank, value AS sample FROM s WHERE rank % greatest(1, (SELECT count(*) // 500 FROM events)) = 0")
    text = "CASE c_custkey % 3 WHEN 0 THEN '$' || c_acctbal WHEN 1 THEN '12,345' ELSE c_custkey || '%' END"
    c.add("f10_format_issues", lambda t: N.format_issues(t.customer.select(F.expr(text.replace("c_acctbal", "cast(c_acctbal AS string)").replace("c_custkey ||", "cast(c_custkey AS string) ||")).alias("v")), ["v"]),
          "SELECT 'v' AS \"column\", 'currency symbols' AS issue, count(*) FILTER (c_custkey % 3 = 0) AS count FROM customer UNION ALL SELECT 'v', 'thousand separators', count(*) FILTER (c_custkey % 3 = 1) FROM customer UNION ALL SELECT 'v', 'percentage signs', count(*) FILTER (c_custkey % 3 = 2) FROM customer")


def _columns(c: Catalog) -> None:
    c.add("f1_table_meta", lambda t: C.table_meta(dirty(t)),
          "SELECT count(*) AS rows, 9 AS columns, round(100.0 * (6 * count(*) + count(l_quantity) + count(l_tax) + count(l_discount)) / (9 * count(*)), 2) AS completeness, 'l_shipdate' AS time_column, min(l_shipdate) AS earliest, max(l_shipdate) AS latest, date_diff('day', min(l_shipdate), max(l_shipdate)) AS span_days FROM " + DIRTY_SQL)
    mixed = "CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE {0} END"
    c.add("f2_type_consistency", lambda t: C.type_consistency(t.orders.select("o_orderkey", F.expr(mixed.format("cast(o_custkey AS string)")).alias("m"), "o_orderstatus")),
          "SELECT 'o_orderkey' AS \"column\", 'bigint' AS kind, 100.0::DOUBLE AS consistency_pct UNION ALL SELECT 'm', 'integer', 100.0 * count(*) FILTER (o_orderkey % 10 <> 0) / count(*) FROM orders UNION ALL SELECT 'o_orderstatus', 'text', 100.0", {"consistency_pct": 6})
    c.add("f3_semantic_types", lambda t: S.semantic_types(t.orders),
          "SELECT \"column\", semantic_type, confidence::DOUBLE AS confidence FROM (VALUES ('o_orderkey', 'id_key', 0.85), ('o_custkey', 'numeric_discrete', 0.75), ('o_orderstatus', 'categorical_nominal', 0.4), ('o_totalprice', 'numeric_continuous', 0.8), ('o_orderdate', 'datetime', 0.95), ('o_orderpriority', 'categorical_nominal', 0.4)) v(\"column\", semantic_type, confidence)")
    c.add("f3_semantic_types_text", lambda t: S.semantic_types(t.pages.select("url")).unionByName(S.semantic_types(t.documents.select("text", F.concat("lang", F.lit("@x.org")).alias("contact"), F.concat(F.lit("$"), "n_chars").alias("cost"), F.expr("case when doc_id % 2 = 0 then 'Yes' else 'no' end").alias("ok")))))
    cols = ("l_returnflag", "l_linestatus", "l_linenumber")
    part = ("SELECT '{0}' AS \"column\", count(*) - count({0}) AS null_count, count({0}) AS non_null, count(DISTINCT {0}) AS \"distinct\", (SELECT v FROM (SELECT CAST({0} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS most_frequent, "
            "(SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {0})) AS most_count, (SELECT v FROM (SELECT CAST({0} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n, v LIMIT 1) AS least_frequent, (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {0})) AS least_count, "
            "0.0::DOUBLE AS null_pct, round(100.0 * count(DISTINCT {0}) / count({0}), 2) AS distinct_pct, round(100.0 * (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {0})) / count({0}), 2) AS most_pct, round(100.0 * (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {0})) / count({0}), 2) AS least_pct FROM lineitem")
    c.add("f4_column_profile", lambda t: C.column_profile(t.lineitem.select(*cols)), " UNION ALL ".join(part.format(x) for x in cols))
    c.add("f4_sample_values", lambda t: C.sample_values(t.part, "p_name"))
    c.add("f11_categorical_profile", lambda t: C.categorical_profile(t.part, "p_name"),
          "WITH k AS (SELECT p_name AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM part), 2) AS pct FROM part GROUP BY 1) (SELECT *, 'top' AS part FROM k ORDER BY count DESC, value LIMIT 20) UNION ALL (SELECT *, 'bottom' FROM k ORDER BY count, value DESC LIMIT 5)")
    c.add("f11_word_counts", lambda t: C.word_counts(t.part, "p_name"),
          "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1 HAVING length(word) > 1 ORDER BY count DESC, word LIMIT 100")
    cased = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN concat(p_name, ' ') ELSE p_name END"
    c.add("f11_case_variants", lambda t: C.case_variants(t.part.select(F.expr(cased).alias("n")), "n").select("normalized", "variant_count"),
          f"SELECT lower(trim(v)) AS normalized, count(*) AS variant_count FROM (SELECT DISTINCT {cased} AS v FROM part) GROUP BY 1 HAVING count(*) > 1")
    c.add("f11_categorical_issues", lambda t: C.categorical_issues(t.part.select(F.expr(cased).alias("n"), F.expr("case p_size % 3 when 0 then 'low' when 1 then 'Medium' else 'high' end").alias("o")), ["n", "o"]),
          f"WITH k AS (SELECT lower(trim(v)) AS x, count(*) AS n FROM (SELECT DISTINCT {cased} AS v FROM part) GROUP BY 1) "
          f"SELECT 'n' AS \"column\", (SELECT count(DISTINCT {cased}) FROM part) AS \"distinct\", 'high' AS cardinality, count(*) FILTER (n > 1) AS case_variants, 0 AS leading, (SELECT count(*) FROM part WHERE p_partkey % 3 = 1) AS trailing, 0 AS control, 0 AS replacement, NULL::VARCHAR[] AS ordinal FROM k "
          "UNION ALL SELECT 'o', 3, 'low', 0, 0, 0, 0, 0, ['low', 'medium', 'high']")
    c.add("f12_datetime_profile", lambda t: C.datetime_profile(t.orders, "o_orderdate", NOW),
          "WITH s AS (SELECT o_orderdate AS v FROM orders), g AS (SELECT epoch(v) - epoch(lag(v) OVER (ORDER BY v)) AS gap FROM s), f AS (SELECT count(*) AS n, epoch(min(v)) AS lo, epoch(max(v)) AS hi, count(*) FILTER (v > TIMESTAMP '2000-01-01') AS future FROM s), "
          "m AS (SELECT count(*) AS k FROM s GROUP BY month(v)) SELECT 'o_orderdate' AS \"column\", n, lo AS earliest, hi AS latest, (hi - lo) / 86400 AS span_days, n / ((hi - lo) / 86400) AS density, (SELECT median(gap) FROM g) AS median_step, (SELECT CASE WHEN median(gap) < 5400 AND avg((abs(gap - 3600) < 1080)::INT) > 0.2 THEN 'hourly' WHEN median(gap) < 129600 AND avg((abs(gap - 86400) < 25920)::INT) > 0.2 THEN 'daily' WHEN median(gap) < 907200 AND avg((abs(gap - 604800) < 181440)::INT) > 0.2 THEN 'weekly' ELSE 'irregular' END FROM g) AS frequency, "
          "(SELECT count(*) FROM g WHERE gap > 3 * (SELECT median(gap) FROM g)) AS gaps, future, 0 AS implausible, (SELECT sum((k - n / 12) ** 2 / (n / 12)) FROM m) AS month_chi2, (SELECT sum((k - n / 12) ** 2 / (n / 12)) FROM m) > 21 AS seasonal FROM f", {"density": 6, "month_chi2": 6})
    c.add("f12_gaps", lambda t: C.datetime_gaps(t.events, "ts").select(F.col("start").alias("a"), F.col("end").alias("b")),
          "WITH g AS (SELECT epoch_us(lag(ts) OVER (ORDER BY ts)) / 1e6 AS a, epoch_us(ts) / 1e6 AS b FROM events) SELECT a, b FROM g WHERE b - a > 3 * (SELECT median(b - a) FROM g)")
    c.add("f12_date_formats", lambda t: C.date_formats(t.orders.select(F.expr("case when o_orderkey % 4 = 0 then date_format(o_orderdate, 'dd.MM.yyyy') else date_format(o_orderdate, 'yyyy/MM/dd') end").alias("d")), "d"),
          "SELECT 'DD.MM.YYYY' AS format, count(*) FILTER (o_orderkey % 4 = 0) AS count FROM orders UNION ALL SELECT 'YYYY/MM/DD', count(*) FILTER (o_orderkey % 4 <> 0) FROM orders")
    c.add("f13_boolean_profile", lambda t: C.boolean_profile(t.labels.select(F.expr("case quality when 1 then 'Yes' else ' no' end").alias("q")), "q"),
          "SELECT 'q' AS \"column\", 'yes' AS true_value, 'no' AS false_value, count(*) FILTER (quality = 1) AS true_count, count(*) FILTER (quality = 0) AS false_count, round(avg(quality), 4) AS true_ratio, round(1 - avg(quality), 4) AS false_ratio, TRUE AS disguised FROM labels")
    c.add("f13_boolean_numeric", lambda t: C.boolean_profile(t.labels, "toxic"),
          "SELECT 'toxic' AS \"column\", '1.0' AS true_value, '0.0' AS false_value, count(*) FILTER (toxic = 1) AS true_count, count(*) FILTER (toxic = 0) AS false_count, round(avg(toxic), 4) AS true_ratio, round(1 - avg(toxic), 4) AS false_ratio, TRUE AS disguised FROM labels")
    c.add("f15_text_profile", lambda t: C.text_profile(t.benchmark, ["text"]).select("column", "n", "avg_length", "min_length", "max_length", "avg_tokens", "language", "html"),
          "SELECT 'text' AS \"column\", count(*) AS n, avg(length(text)) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length, avg(len(regexp_extract_all(text, '\\S+'))) AS avg_tokens, 'English' AS language, FALSE AS html FROM benchmark", {"avg_length": 6, "avg_tokens": 6})
    c.add("f15_text_profile_all", lambda t: C.text_profile(t.documents, ["text"]))
    pii = r"(?:\+?\d{1,3}[\s\-]?)?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}"
    c.add("f16_pii_scan", lambda t: C.pii_scan(t.documents, ["text"]).where("kind in ('email', 'phone', 'ssn')").select("kind", "count", "pct"),
          "WITH k AS (SELECT 'email' AS kind, count(*) FILTER (regexp_matches(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS count, count(*) AS n FROM documents UNION ALL "
          f"SELECT 'phone', count(*) FILTER (regexp_matches(text, '{pii}')), count(*) FROM documents UNION ALL SELECT 'ssn', count(*) FILTER (regexp_matches(text, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b')), count(*) FROM documents) SELECT kind, count, round(100.0 * count / n, 2) AS pct FROM k WHERE count > 0")
    c.add("f17_primary_keys", lambda t: keys.primary_keys(t.orders), "SELECT 'o_orderkey' AS columns, 1 AS width, 1.0::DOUBLE AS uniqueness WHERE (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders)")
    c.add("f17_primary_key_pairs", lambda t: keys.primary_keys(t.conversations.select("conv_id", "turn", "role")), "SELECT 'conv_id, turn' AS columns, 2 AS width, 1.0::DOUBLE AS uniqueness WHERE (SELECT count(*) = count(DISTINCT (conv_id, turn)) FROM conversations)")
    c.add("f18_id_columns", lambda t: keys.id_columns(t.orders).select("column", "uniqueness"), "SELECT 'o_orderkey' AS \"column\", count(DISTINCT o_orderkey) / count(*) AS uniqueness FROM orders")
    c.add("f26_detect_domain", lambda t: S.detect_domain(t.orders))
    c.add("f28_geo_regions", lambda t: S.geo_regions(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"))),
          "SELECT list_reduce(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS region, count(*) AS count FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY count DESC, region LIMIT 50")
    c.add("f28_bounding_box", lambda t: S.bounding_box(t.customer.select((F.col("c_acctbal") / 120).alias("lat"), (F.col("c_custkey") / 20 - 30).alias("lon"))),
          "SELECT min(c_acctbal / 120) AS min_lat, max(c_acctbal / 120) AS max_lat, min(c_custkey / 20 - 30) AS min_lon, max(c_custkey / 20 - 30) AS max_lon FROM customer", {k: 8 for k in ("min_lat", "max_lat", "min_lon", "max_lon")})
    c.add("f31_column_tags", lambda t: S.column_tags(t.orders),
          "SELECT \"column\", dtype, tag, confidence::DOUBLE AS confidence FROM (VALUES ('o_orderkey', 'bigint', 'id', 0.9), ('o_custkey', 'bigint', 'id', 0.9), ('o_orderstatus', 'string', 'categorical', 0.85), ('o_totalprice', 'double', 'feature', 0.8), ('o_orderdate', 'timestamp_ntz', 'datetime', 0.9), ('o_orderpriority', 'string', 'categorical', 0.85)) v(\"column\", dtype, tag, confidence)")


def _relations(c: Catalog) -> None:
    four = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

    def lines(t):
        return t.lineitem.select(*four)

    c.add("f14_mutual_information", lambda t: R.mutual_information(t.orders, ["o_orderstatus", "o_orderpriority"]),
          "WITH n AS (SELECT count(*)::DOUBLE AS n FROM orders), j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS k FROM orders GROUP BY 1, 2), x AS (SELECT a, sum(k) AS ka FROM j GROUP BY 1), y AS (SELECT b, sum(k) AS kb FROM j GROUP BY 1) "
          "SELECT 'o_orderstatus' AS col1, 'o_orderpriority' AS col2, greatest(0, sum(k / n * ln(k * n / (ka * kb)))) AS score FROM j JOIN x USING (a) JOIN y USING (b), n", {"score": 8})
    c.add("f14_mutual_information_all", lambda t: R.mutual_information(t.lineitem, [*four, "l_returnflag", "l_linestatus"]))
    pairs = [(a, b) for i, a in enumerate(four) for b in four[i + 1 :]]
    ranked = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {x}" for x in four) + " FROM lineitem"
    c.add("f19_correlations", lambda t: R.correlations(lines(t), list(four)).drop("p_value"),
          f"WITH r AS ({ranked}) " + " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, 'pearson' AS metric, corr({a}, {b}) AS score, count(*) AS n FROM lineitem UNION ALL SELECT '{a}', '{b}', 'spearman', corr({a}, {b}), count(*) FROM r" for a, b in pairs), {"score": 8})
    chi = "WITH j AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS k FROM {t} GROUP BY 1, 2), x AS (SELECT a, sum(k) AS ka FROM j GROUP BY 1), y AS (SELECT b, sum(k) AS kb FROM j GROUP BY 1), s AS (SELECT sum(k * k / (ka * kb)) - 1 AS p, sum(k) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM j JOIN x USING (a) JOIN y USING (b))"
    c.add("f20_cramers_v", lambda t: R.cramers_v(t.orders, "o_orderstatus", "o_orderpriority"), chi.format(a="o_orderstatus", b="o_orderpriority", t="orders") + " SELECT 'o_orderstatus' AS col1, 'o_orderpriority' AS col2, sqrt(p / (least(r, c) - 1)) AS score FROM s", {"score": 8})
    c.add("f21_eta_squared", lambda t: R.eta_squared(t.part, "p_retailprice", "p_brand"),
          "WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1) SELECT 'p_retailprice' AS col1, 'p_brand' AS col2, (SELECT sum(n * (m - (SELECT avg(p_retailprice) FROM part)) ** 2) FROM g) / (var_pop(p_retailprice) * count(*)) AS score FROM part", {"score": 8})
    c.add("f22_point_biserial", lambda t: R.point_biserial(t.lineitem, "l_extendedprice", "l_linestatus").drop("p_value"),
          "SELECT 'l_extendedprice' AS col1, 'l_linestatus' AS col2, corr(l_extendedprice, (l_linestatus = 'O')::INT) AS score FROM lineitem", {"score": 8})
    c.add("f23_vif", lambda t: R.vif(t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_discount")).alias("cut"))),
          "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_extendedprice * l_discount) AS b, corr(l_extendedprice, l_extendedprice * l_discount) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r), "
          "v AS (SELECT 'l_quantity' AS \"column\", (1 - c * c) / det AS vif FROM d UNION ALL SELECT 'l_extendedprice', (1 - b * b) / det FROM d UNION ALL SELECT 'cut', (1 - a * a) / det FROM d) SELECT *, vif > 5 AS high FROM v", {"vif": 6})
    c.add("f24_strongest_pairs", lambda t: R.strongest_pairs(t.part.select("p_size", "p_retailprice", "p_brand", "p_type"), None))
    c.add("f25_detect_target", lambda t: S.detect_target(t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "n_chars", "toxic", "quality")).select("target", "problem", "score"),
          "SELECT 'quality' AS target, 'binary_classification' AS problem, 7.5::DOUBLE AS score")
    c.add("f32_graph", lambda t: R.relationship_graph(t.lineitem.select(*four, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))),
          "WITH l AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem), e AS (" + " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, round(corr({a}, {b}), 3) AS value FROM l" for a, b in [*pairs, *[(x, "net") for x in four]]) + ") SELECT * FROM e WHERE abs(value) >= 0.3")
    c.add("f32_nodes", lambda t: R.relationship_nodes(t.customer),
          " UNION ALL ".join(f"SELECT '{x}' AS node, '{k}' AS category, count({x}) AS value, 10 + 40.0 * count(DISTINCT {x}) / count(*) AS size FROM customer" for x, k in (("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical"))), {"size": 8})
    days = ("WITH m AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS p, avg(o_totalprice) AS value FROM orders GROUP BY 1), c AS (SELECT unnest(generate_series((SELECT min(p) FROM m), (SELECT max(p) FROM m), INTERVAL 1 DAY)) AS p), "
            "j AS (SELECT c.p, value, row_number() OVER (ORDER BY c.p) - 1 AS i FROM c LEFT JOIN m ON c.p = m.p), k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ia, last_value(value IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va, "
            "first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib, first_value(value IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM j), "
            "s AS (SELECT p, i, coalesce(value, va + (vb - va) * (i - ia) / (ib - ia)) AS value FROM k), t AS (SELECT *, avg(value) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM s), "
            "h AS (SELECT i % 7 AS ph, avg(value - trend) AS s FROM t GROUP BY 1) SELECT p, value, trend, s - (SELECT avg(s) FROM h) AS seasonal, value - trend - s + (SELECT avg(s) FROM h) AS residual FROM t JOIN h ON i % 7 = ph")
    c.add("f27_decompose", lambda t: decompose(t.orders, "o_orderdate", "o_totalprice").withColumn("p", F.col("p").cast("timestamp_ntz")), days, {k: 7 for k in ("value", "trend", "seasonal", "residual")})


def register(c: Catalog) -> None:
    for part in (_numbers, _columns, _relations):
        part(c)
