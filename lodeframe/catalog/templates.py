"""Prepared analysis queries and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.catalog.base import Catalog
from lodeframe.operators import templates as T
from lodeframe.plans.charts import chart_data

# Lineitem with holes and spikes derived from its keys, in both dialects.
DIRTY = {
    "l_quantity": "CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN l_quantity * 1000 ELSE l_quantity END",
    "l_tax": "CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_tax END",
    "l_discount": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END",
}
KEPT = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
DIRTY_SQL = "(SELECT " + ", ".join([*KEPT, *[f"{e} AS {n}" for n, e in DIRTY.items()]]) + " FROM lineitem)"


def dirty(t):
    return t.lineitem.select(*KEPT, *[F.expr(e).alias(n) for n, e in DIRTY.items()])


def register(c: Catalog) -> None:
    cols = [*KEPT, *DIRTY]
    c.add("t1_null_counts", lambda t: T.null_counts(dirty(t)),
          "SELECT count(*) AS total_rows, " + ", ".join(f"count(*) - count({x}) AS {x}_nulls" for x in cols) + f" FROM {DIRTY_SQL}")
    c.add("t2_duplicate_rows", lambda t: T.duplicate_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"), 100),
          "SELECT l_returnflag, l_linestatus, l_quantity, l_linenumber, count(*) AS dup_count FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(*) > 1 ORDER BY dup_count DESC, 1, 2, 3, 4 LIMIT 100")
    for unit in ("day", "week", "month", "quarter", "year"):
        c.add(f"t3_count_by_{unit}", lambda t, u=unit: T.count_by_period(t.orders, "o_orderdate", u),
              f"SELECT CAST(date_trunc('{unit}', o_orderdate) AS TIMESTAMP) AS period, count(*) AS record_count FROM orders GROUP BY 1")
    c.add("t4_value_range", lambda t: T.value_range(dirty(t), "l_quantity"),
          f"SELECT min(l_quantity) AS min_val, quantile_cont(l_quantity, 0.25) AS p25, median(l_quantity) AS median, avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS max_val, stddev(l_quantity) AS std_dev FROM {DIRTY_SQL}",
          {"mean": 5, "std_dev": 4})
    c.add("t5_value_frequency", lambda t: T.value_frequency(t.part, "p_brand"),
          "SELECT p_brand, count(*) AS frequency, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM part GROUP BY 1")
    c.add("t6_histogram", lambda t: T.histogram(t.orders, "o_totalprice", 20),
          "WITH b AS (SELECT min(o_totalprice) mn, max(o_totalprice) mx FROM orders) SELECT CAST(floor((o_totalprice - mn) / nullif((mx - mn) / 20, 0)) AS BIGINT) AS bucket, count(*) AS freq FROM orders, b GROUP BY 1")
    nulls = " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in cols)
    c.add("t7_rows_missing", lambda t: T.rows_missing(dirty(t), 2, None), f"SELECT * FROM (SELECT *, {nulls} AS null_count FROM {DIRTY_SQL}) WHERE null_count >= 2")
    c.add("t8_completeness", lambda t: T.completeness(dirty(t)),
          "SELECT count(*) AS total_rows, " + ", ".join(f"round(100.0 * (count(*) - count({x})) / count(*), 2) AS {x}" for x in cols) + f" FROM {DIRTY_SQL}")
    c.add("t9_trend", lambda t: T.trend(t.orders, "o_orderdate", "o_totalprice"),
          "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS total, avg(o_totalprice) AS average, count(*) AS records FROM orders GROUP BY 1", {"total": 2, "average": 4})
    c.add("t10_growth", lambda t: T.growth(t.orders, "o_orderdate", "o_totalprice"),
          "WITH p AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS p, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT p, total, lag(total) OVER (ORDER BY p) AS prev_total, round(100.0 * (total - prev_total) / nullif(prev_total, 0), 2) AS growth_pct FROM p",
          {"total": 2, "prev_total": 2})
    c.add("t11_rolling", lambda t: T.rolling(t.events, "ts", "value", "day", 7),
          "WITH d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS p, avg(value) AS avg_val FROM events GROUP BY 1) SELECT p, avg_val, avg(avg_val) OVER (ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS rolling_avg FROM d",
          {"avg_val": 6, "rolling_avg": 6})
    c.add("t12_scorecard", lambda t: T.scorecard(t.customer, "c_mktsegment", "c_acctbal"),
          "SELECT c_mktsegment, count(*) AS count, sum(c_acctbal) AS total, avg(c_acctbal) AS average, min(c_acctbal) AS min_val, max(c_acctbal) AS max_val FROM customer GROUP BY 1", {"total": 2, "average": 5})
    c.add("t13_funnel", lambda t: T.funnel(t.events, "event_type", "user_id"), "SELECT event_type, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1")
    c.add("t14_did_not", lambda t: T.did_not(t.events.withColumn("user_id", F.expr("user_id * 1000 + event_id div 100")), "event_type", "user_id", "purchase", "signup", None),
          "WITH e AS (SELECT user_id * 1000 + event_id // 100 AS user_id, event_type FROM events) SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'signup')")
    c.add("t15_cohort_retention", lambda t: T.cohort_retention(t.orders, "o_custkey", "o_orderdate"),
          "WITH co AS (SELECT o_custkey AS u, CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP) AS cohort_month FROM orders GROUP BY 1), a AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate) AS m FROM orders) "
          "SELECT cohort_month, date_diff('month', cohort_month, m) AS months_since, count(DISTINCT u) AS active_users FROM co JOIN a USING (u) GROUP BY 1, 2")
    c.add("t16_zscore_outliers", lambda t: T.zscore_outliers(dirty(t), "l_quantity", 3, None),
          f"WITH d AS (SELECT * FROM {DIRTY_SQL}), s AS (SELECT avg(l_quantity) AS mu, stddev(l_quantity) AS sd FROM d) SELECT d.*, round(abs((l_quantity - mu) / sd), 2) AS z_score FROM d, s WHERE abs((l_quantity - mu) / sd) > 3")
    c.add("t17_segment", lambda t: T.segment(t.customer, "c_nationkey", "c_acctbal", 50),
          "SELECT c_nationkey, count(*) AS count, sum(c_acctbal) AS total, avg(c_acctbal) AS average FROM customer GROUP BY 1 ORDER BY count DESC, c_nationkey LIMIT 50", {"total": 2, "average": 5})
    c.add("t18_rank_groups", lambda t: T.rank_groups(t.part, "p_type", "p_retailprice", 20),
          "SELECT p_type, sum(p_retailprice) AS total, avg(p_retailprice) AS average, rank() OVER (ORDER BY sum(p_retailprice) DESC) AS rank FROM part GROUP BY 1 ORDER BY rank, p_type LIMIT 20", {"total": 2, "average": 5})

    def chart(name, config, sql, digits=None, table="orders", **kw):
        c.add(name, lambda t: chart_data(t.spark, config, table, t.all(table), **kw), sql, digits)

    for f in ("sum", "avg", "count", "min", "max", "median"):
        chart(f"t19_bar_{f}", {"type": "bar", "x": "o_orderpriority", "series": "o_orderstatus", "y": "o_totalprice", "aggregation": f},
              f"SELECT o_orderpriority, o_orderstatus, {f}(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2", {"o_totalprice": 3} if f != "count" else None)
    chart("t19_line", {"type": "line", "x": "o_orderdate", "y": "o_totalprice", "y2": "o_custkey", "aggregation": "max", "filters": [{"column": "o_orderstatus", "op": "in", "values": ["F", "P"]}]},
          "SELECT o_orderdate, max(o_totalprice) AS o_totalprice, max(o_custkey) AS o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 1000 GROUP BY 1", global_filters=[{"column": "o_totalprice", "op": ">", "value": 1000}])
    chart("t19_scatter", {"type": "scatter", "x": "p_size", "y": "p_retailprice", "size": "p_partkey", "sort_by": "p_partkey", "limit": 500},
          "SELECT p_size, p_retailprice, p_partkey FROM part ORDER BY p_partkey LIMIT 500", table="part")
    chart("t20_kpi", {"type": "kpi", "y": "o_totalprice", "aggregation": "avg"}, "SELECT avg(o_totalprice) AS value FROM orders", {"value": 4})
    chart("t20_kpi_count", {"type": "kpi"}, "SELECT count(*) AS value FROM orders")
    chart("t21_table", {"type": "table", "x": "o_orderpriority", "y": "o_totalprice", "series": "o_orderstatus", "aggregation": "sum"},
          "SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2", {"o_totalprice": 2})
    c.add("t22_column_stats", lambda t: T.column_stats(dirty(t), "l_tax"),
          f"SELECT count(*) AS count, count(l_tax) AS non_null, count(*) - count(l_tax) AS null_count, count(DISTINCT l_tax) AS \"unique\", min(l_tax) AS min, max(l_tax) AS max, avg(l_tax) AS mean, median(l_tax) AS median, stddev(l_tax) AS std FROM {DIRTY_SQL}",
          {"mean": 8, "std": 8, "median": 8})
    c.add("j14_orphans", lambda t: T.orphans(t.customer, t.orders.where("o_orderstatus = 'P'"), "c_custkey", "o_custkey", None), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
    c.add("j15_natural_join", lambda t: T.natural_join(t.customer.select(F.col("c_nationkey").alias("nationkey"), "c_name"), t.nation.select(F.col("n_nationkey").alias("nationkey"), "n_name"), None),
          "SELECT c_nationkey AS nationkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
