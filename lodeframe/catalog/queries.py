"""Query specs, joins, aggregates, windows, order, set operations and the workspace."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lodeframe.catalog.base import Catalog, Tables
from lodeframe.operators import keys, setops
from lodeframe.plans.spec import join_tables, run_spec
from lodeframe.workspace import Workspace, column_info, column_values, override_type, preview, run_sql, run_template

AS_OF = dt.date(1998, 6, 17)


def _spec(spec: dict, *tables: str, **kw):
    return lambda t: run_spec(t.spark, spec, t.all(*tables), **kw)


def _orders(where: list[dict], columns: tuple[str, ...] = ("o_orderkey", "o_totalprice")) -> dict:
    return {"from": "orders", "columns": [{"column": c} for c in columns], "where": where}


def _predicates(c: Catalog) -> None:
    c.add(
        "p1_columns_and_aliases",
        _spec({"from": {"table": "orders", "alias": "o"}, "columns": [{"column": "o_orderkey", "table": "o", "alias": "id"}, {"column": "o_orderpriority"}]}, "orders"),
        "SELECT o.o_orderkey AS id, o_orderpriority FROM orders o",
    )
    c.add("p1_all_columns", _spec({"from": "customer"}, "customer"), "SELECT * FROM customer")
    c.add(
        "p2_expression",
        _spec({"from": "lineitem", "columns": [{"column": "l_orderkey"}, {"column": "l_linenumber"}, {"expression": "l_extendedprice * (1 - l_discount)", "alias": "net"}]}, "lineitem"),
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", {"net": 4},
    )
    comparisons = {
        "equal": ("=", "o_orderstatus", "F", "o_orderstatus = 'F'"),
        "not_equal": ("≠", "o_orderstatus", "F", "o_orderstatus <> 'F'"),
        "greater": (">", "o_totalprice", 250000.0, "o_totalprice > 250000"),
        "at_most": ("≤", "o_totalprice", 50000.0, "o_totalprice <= 50000"),
        "before": ("BEFORE", "o_orderdate", "1996-01-01", "o_orderdate < TIMESTAMP '1996-01-01'"),
        "after": ("AFTER", "o_orderdate", "1997-01-01", "o_orderdate > TIMESTAMP '1997-01-01'"),
    }
    for name, (op, column, value, sql) in comparisons.items():
        spec = _orders([{"column": column, "op": op, "value": value}])
        c.add(f"p3_{name}", _spec(spec, "orders"), f"SELECT o_orderkey, o_totalprice FROM orders WHERE {sql}")
    texts = {
        "p4_like": ("LIKE", "%e%r%", "p_name LIKE '%e%r%'"),
        "p4_not_like": ("NOT LIKE", "%r%", "p_name NOT LIKE '%r%'"),
        "p5_starts_with": ("STARTS WITH", "re", "starts_with(p_name, 're')"),
        "p5_ends_with": ("ENDS WITH", "t", "suffix(p_name, 't')"),
        "p5_contains": ("CONTAINS", "ol", "contains(p_name, 'ol')"),
        "p5_does_not_contain": ("DOES NOT CONTAIN", "ol", "NOT contains(p_name, 'ol')"),
        "p6_matches_regex": ("MATCHES REGEX", "[aeiou]{2}|t$", "regexp_matches(p_name, '[aeiou]{2}|t$')"),
    }
    for name, (op, value, sql) in texts.items():
        spec = {"from": "part", "columns": [{"column": "p_partkey"}], "where": [{"column": "p_name", "op": op, "value": value}]}
        c.add(name, _spec(spec, "part"), f"SELECT p_partkey FROM part WHERE {sql}")

    def holes(t: Tables):
        return t.lineitem.withColumn("tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))).withColumn("even", F.col("l_orderkey") % 2 == 0)

    holes_sql = "(SELECT *, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS tax, l_orderkey % 2 = 0 AS even FROM lineitem)"
    for name, op, sql in (
        ("p7_is_null", "IS NULL", "tax IS NULL"), ("p7_is_not_null", "IS_NOT_NULL", "tax IS NOT NULL"),
        ("p8_is_true", "IS TRUE", "even = TRUE"), ("p8_is_false", "IS FALSE", "even = FALSE"),
    ):
        column = "even" if "TRUE" in op or "FALSE" in op else "tax"
        spec = {"from": "h", "columns": [{"column": "l_orderkey"}, {"column": "l_linenumber"}], "where": [{"column": column, "op": op}]}
        c.add(name, lambda t, spec=spec: run_spec(t.spark, spec, {"h": holes(t)}), f"SELECT l_orderkey, l_linenumber FROM {holes_sql} WHERE {sql}")
    c.add(
        "p9_between", _spec(_orders([{"column": "o_totalprice", "op": "BETWEEN", "values": [100000, 200000]}]), "orders"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
    )
    c.add(
        "p10_in", _spec(_orders([{"column": "o_orderpriority", "op": "IN", "values": ["1-URGENT", "5-LOW"]}]), "orders"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    )
    c.add(
        "p10_not_in", _spec(_orders([{"column": "o_orderstatus", "op": "NOT IN", "values": ["F", "O"]}]), "orders"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    )
    relative = {
        "p11_in_last_n_days": ("IN LAST N DAYS", 400, "DATE '1998-06-17' - INTERVAL 400 DAY"),
        "p11_in_last_n_months": ("IN LAST N MONTHS", 13, "DATE '1998-06-17' - INTERVAL 13 MONTH"),
        "p12_this_week": ("THIS WEEK", None, "DATE_TRUNC('week', DATE '1998-06-17')"),
        "p12_this_month": ("THIS MONTH", None, "DATE_TRUNC('month', DATE '1998-06-17')"),
        "p12_this_year": ("THIS YEAR", None, "DATE_TRUNC('year', DATE '1998-06-17')"),
    }
    for name, (op, value, sql) in relative.items():
        spec = _orders([{"column": "o_orderdate", "op": op, "value": value}])
        c.add(name, _spec(spec, "orders", as_of=AS_OF), f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= {sql}")
    c.add(
        "p13_and_or_groups",
        _spec(_orders([
            {"column": "o_orderstatus", "value": "F"},
            {"logic": "OR", "column": "o_orderpriority", "value": "1-URGENT"},
            {"logic": "AND", "group": [{"column": "o_totalprice", "op": ">", "value": 200000}, {"logic": "OR", "column": "o_custkey", "op": "<", "value": 100}]},
        ]), "orders"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AND (o_totalprice > 200000 OR o_custkey < 100)",
    )
    average = {"from": "orders", "columns": [{"aggregate": "AVG", "column": "o_totalprice", "alias": "a"}]}
    c.add(
        "p14_scalar_subquery", _spec(_orders([{"column": "o_totalprice", "op": ">", "subquery": average}]), "orders"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    )
    rich = {"from": "customer", "columns": [{"column": "c_custkey"}], "where": [{"column": "c_acctbal", "op": ">", "value": 5000}]}
    for name, op in (("p15_in_subquery", "IN"), ("p15_not_in_subquery", "NOT IN")):
        c.add(
            name, _spec(_orders([{"column": "o_custkey", "op": op, "subquery": rich}]), "orders", "customer"),
            f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey {op} (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
        )
    c.add(
        "p15_in_subquery_or",
        _spec(_orders([{"column": "o_custkey", "op": "IN", "subquery": rich}, {"logic": "OR", "column": "o_orderstatus", "value": "P"}]), "orders", "customer"),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR o_orderstatus = 'P'",
    )
    c.add(
        "p16_common_table_expression",
        _spec({
            "ctes": [{"name": "spend", "query": {"from": "orders", "columns": [{"column": "o_custkey"}, {"aggregate": "SUM", "column": "o_totalprice", "alias": "total"}], "group_by": ["o_custkey"]}}],
            "from": "spend", "columns": [{"column": "c_mktsegment"}, {"aggregate": "AVG", "column": "total", "alias": "mean_spend"}],
            "joins": [{"type": "INNER", "table": "customer", "on": [{"left": "spend.o_custkey", "right": "customer.c_custkey"}]}],
            "group_by": ["c_mktsegment"],
        }, "orders", "customer"),
        "WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_mktsegment, AVG(total) AS mean_spend FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        {"mean_spend": 3},
    )
    c.add(
        "p17_global_filters",
        _spec(_orders([{"column": "o_orderstatus", "value": "O"}]), "orders", global_filters=[{"column": "o_totalprice", "op": ">", "value": 100000}, {"column": "o_custkey", "op": "between", "values": [10, 900]}]),
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_custkey BETWEEN 10 AND 900",
    )


def _flagship(c: Catalog) -> None:
    spec = {
        "from": {"table": "orders", "alias": "o"},
        "joins": [{"type": "INNER", "table": "customer", "alias": "c", "on": [{"left": "o.o_custkey", "right": "c.c_custkey"}]}],
        "columns": [
            {"column": "c_mktsegment"},
            {"aggregate": "SUM", "column": "o_totalprice", "alias": "revenue"},
            {"aggregate": "AVG", "column": "o_totalprice", "alias": "average"},
            {"aggregate": "COUNT", "column": "*", "alias": "orders"},
        ],
        "where": [{"column": "o_orderdate", "op": "AFTER", "value": "1994-12-31"}, {"column": "o_orderstatus", "op": "IN", "values": ["F", "O"]}],
        "group_by": ["c_mktsegment"],
        "having": [{"column": "orders", "op": ">", "value": 10}],
        "order_by": [{"column": "revenue", "direction": "DESC"}],
        "limit": 4, "offset": 1,
    }
    c.add(
        "q8_query_spec", _spec(spec, "orders", "customer"),
        "SELECT c_mktsegment, SUM(o_totalprice) AS revenue, AVG(o_totalprice) AS average, COUNT(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
        "WHERE o_orderdate > TIMESTAMP '1994-12-31' AND o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING COUNT(*) > 10 ORDER BY revenue DESC LIMIT 4 OFFSET 1",
        {"revenue": 2, "average": 4},
    )


def _joins(c: Catalog) -> None:
    def some_customers(t: Tables):
        return t.customer.where("c_custkey % 3 <> 0")

    def early_orders(t: Tables):
        return t.orders.where("o_orderdate < timestamp'1997-01-01'")

    co = "(SELECT * FROM customer WHERE c_custkey % 3 <> 0) c"
    oo = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01') o"
    for key, kind, word in (("j1_inner", "INNER", "JOIN"), ("j2_left", "LEFT", "LEFT JOIN"), ("j3_right", "RIGHT", "RIGHT JOIN"), ("j4_full", "FULL OUTER", "FULL JOIN")):
        spec = {
            "from": {"table": "o"}, "joins": [{"type": kind, "table": "c", "on": [{"left": "o.o_custkey", "right": "c.c_custkey"}]}],
            "columns": [{"column": "o_orderkey"}, {"column": "c_custkey"}, {"column": "c_name"}],
        }
        c.add(key, lambda t, spec=spec: run_spec(t.spark, spec, {"o": early_orders(t), "c": some_customers(t)}),
              f"SELECT o_orderkey, c_custkey, c_name FROM {oo} {word} {co} ON o_custkey = c_custkey")
    c.add(
        "j1_inner_two_keys",
        lambda t: join_tables(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), t.lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("n")), "INNER", [("l_orderkey", "l_orderkey"), ("l_linenumber", "n")]),
        "SELECT a.l_orderkey, a.l_linenumber, l_suppkey, n FROM lineitem a JOIN (SELECT l_orderkey, min(l_linenumber) AS n FROM lineitem GROUP BY 1) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = n",
    )
    kinds = lambda t: {"p": t.orders.select("o_orderpriority").distinct(), "f": t.lineitem.select("l_returnflag", "l_linestatus").distinct()}
    c.add("j5_cross", lambda t: run_spec(t.spark, {"from": "p", "joins": [{"type": "CROSS", "table": "f"}]}, kinds(t)),
          "SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
    for key, kind, word in (("j6_semi", "SEMI", "IN"), ("j7_anti", "ANTI", "NOT IN")):
        spec = {"from": "customer", "joins": [{"type": kind, "table": "o", "on": [{"left": "customer.c_custkey", "right": "o.o_custkey"}]}], "columns": [{"column": "c_custkey"}]}
        c.add(key, lambda t, spec=spec: run_spec(t.spark, spec, {"customer": t.customer, "o": t.orders.where("o_totalprice > 400000")}),
              f"SELECT c_custkey FROM customer WHERE c_custkey {word} (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")

    def named(df, prefix):
        return df.select(F.col(f"{prefix}_nationkey").alias("nationkey"), F.col(f"{prefix}_name").alias("name"), F.col(f"{prefix}_acctbal").alias("acctbal"))

    c.add("j8_suffixes", lambda t: join_tables(named(t.supplier, "s"), named(t.customer, "c"), "INNER", [("nationkey", "nationkey")]),
          "SELECT s_nationkey AS nationkey, s_name AS name_left, s_acctbal AS acctbal_left, c_name AS name_right, c_acctbal AS acctbal_right FROM supplier JOIN customer ON s_nationkey = c_nationkey")

    def same_name(t):
        left = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
        return keys.suggest_joins(left, t.customer.select(F.col("c_custkey").alias("custkey"), "c_nationkey"))

    c.add("j9_suggest_same_name", lambda t: same_name(t).where("match_type = 'exact_name'").select("left_column", "right_column", "overlap_count", "left_unique", "right_unique", "relationship"),
          "SELECT 'custkey' AS left_column, 'custkey' AS right_column, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS overlap_count, "
          "(SELECT count(DISTINCT o_custkey) FROM orders) AS left_unique, (SELECT count(DISTINCT c_custkey) FROM customer) AS right_unique, 'N:1' AS relationship")
    c.add("j10_suggest_by_values", lambda t: keys.suggest_joins(t.orders.select("o_custkey", "o_orderpriority"), t.customer.select("c_custkey", "c_mktsegment")).select("left_column", "right_column", "match_type", "overlap_count"),
          "SELECT 'o_custkey' AS left_column, 'c_custkey' AS right_column, 'value_overlap' AS match_type, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS overlap_count")
    c.add("j11_cardinality", lambda t: keys.join_cardinality(t.orders, t.customer, "o_custkey", "c_custkey"),
          "SELECT CASE WHEN lu = ln THEN '1:' ELSE 'N:' END || CASE WHEN ru = rn THEN '1' ELSE 'N' END AS relationship, lu AS left_unique, ru AS right_unique, CASE WHEN lu * ru > 10000000 THEN 'Large product of distinct keys; the join may be slow.' END AS warning "
          "FROM (SELECT count(*) ln, count(DISTINCT o_custkey) lu FROM orders), (SELECT count(*) rn, count(DISTINCT c_custkey) ru FROM customer)")
    c.add("j12_foreign_keys", lambda t: keys.foreign_keys(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")),
          "WITH v AS (SELECT count(DISTINCT l_suppkey) AS n, count(DISTINCT l_suppkey) FILTER (l_suppkey IN (SELECT l_partkey FROM lineitem)) AS p, count(DISTINCT l_suppkey) FILTER (l_suppkey IN (SELECT l_orderkey FROM lineitem)) AS o, "
          "count(DISTINCT l_partkey) AS np, count(DISTINCT l_partkey) FILTER (l_partkey IN (SELECT l_orderkey FROM lineitem)) AS po FROM lineitem) "
          "SELECT 'l_partkey' AS \"column\", 'l_orderkey' AS \"references\", po / np AS containment FROM v WHERE po / np >= 0.95 UNION ALL SELECT 'l_suppkey', 'l_orderkey', o / n FROM v WHERE o / n >= 0.95 UNION ALL SELECT 'l_suppkey', 'l_partkey', p / n FROM v WHERE p / n >= 0.95")

    def saved(t):
        w = Workspace(t.spark)
        name = w.register(join_tables(t.orders, t.customer, "INNER", [("o_custkey", "c_custkey")]), "orders with customers.csv")
        return t.spark.table(name).select("o_orderkey", "c_name")

    c.add("j13_save_join", saved, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")


def _aggregates(c: Catalog) -> None:
    def add(name, columns, sql, digits=None, **more):
        c.add(name, _spec({"from": "lineitem", "columns": columns, **more}, "lineitem"), sql, digits)

    by = {"group_by": ["l_returnflag", "l_linestatus"]}
    keys_ = [{"column": "l_returnflag"}, {"column": "l_linestatus"}]
    g = "SELECT l_returnflag, l_linestatus, {} FROM lineitem GROUP BY 1, 2"
    add("a1_count", [{"aggregate": "COUNT", "column": "*", "alias": "n"}, {"aggregate": "COUNT", "column": "l_tax", "alias": "k"}], "SELECT count(*) AS n, count(l_tax) AS k FROM lineitem")
    add("a2_count_distinct", keys_ + [{"aggregate": "COUNT DISTINCT", "column": "l_suppkey", "alias": "a"}, {"aggregate": "COUNT", "distinct": True, "column": "l_partkey", "alias": "b"}],
        g.format("count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b"), **by)
    add("a3_sum_avg_min_max", keys_ + [{"aggregate": f, "column": "l_extendedprice", "alias": f.lower()} for f in ("SUM", "AVG", "MIN", "MAX")],
        g.format("sum(l_extendedprice) AS sum, avg(l_extendedprice) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max"), {"sum": 1, "avg": 4}, **by)
    add("a3_distinct_sum_avg", keys_ + [{"aggregate": f, "column": "l_quantity", "alias": f.lower(), "distinct": True} for f in ("SUM", "AVG")],
        g.format("sum(DISTINCT l_quantity) AS sum, avg(DISTINCT l_quantity) AS avg"), {"sum": 3, "avg": 5}, **by)
    add("a4_median", keys_ + [{"aggregate": "MEDIAN", "column": "l_extendedprice", "alias": "mid"}, {"aggregate": "COUNT", "column": "*", "alias": "n"}],
        g.format("median(l_extendedprice) AS mid, count(*) AS n"), {"mid": 4}, **by)
    add("a4_median_all", [{"aggregate": "MEDIAN", "column": "l_extendedprice", "alias": "mid"}, {"aggregate": "MIN", "column": "l_tax", "alias": "low"}],
        "SELECT median(l_extendedprice) AS mid, min(l_tax) AS low FROM lineitem", {"mid": 4})
    add("a5_mode", [{"column": "l_returnflag"}, {"aggregate": "MODE", "column": "l_quantity", "alias": "most"}],
        "SELECT l_returnflag, l_quantity AS most FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1", group_by=["l_returnflag"])
    add("a6_stddev_variance", keys_ + [{"aggregate": "STDDEV", "column": "l_quantity", "alias": "sd"}, {"aggregate": "VARIANCE", "column": "l_quantity", "alias": "var"}],
        g.format("stddev_samp(l_quantity) AS sd, var_samp(l_quantity) AS var"), {"sd": 6, "var": 5}, **by)
    add("a7_group_by", [{"column": "l_suppkey"}, {"aggregate": "COUNT", "column": "*", "alias": "n"}], "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1", group_by=["l_suppkey"])
    add("a8_having", [{"column": "l_partkey"}, {"aggregate": "COUNT", "column": "*", "alias": "n"}, {"aggregate": "MAX", "column": "l_tax", "alias": "top"}],
        "SELECT l_partkey, count(*) AS n, max(l_tax) AS top FROM lineitem GROUP BY 1 HAVING count(*) >= 35 AND (max(l_tax) < 0.08 OR count(*) > 38)", group_by=["l_partkey"],
        having=[{"column": "n", "op": ">=", "value": 35}, {"group": [{"column": "top", "op": "<", "value": 0.08}, {"logic": "OR", "column": "n", "op": ">", "value": 38}]}])

    from lodeframe.operators.ordered import group_quantiles
    from lodeframe.operators.templates import share_of_total

    c.add("a9_percentile_cont", lambda t: group_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p90": 0.9}, small=0),
          "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1", {"p10": 4, "p90": 4})
    add("a10_conditional_count", [{"column": "l_returnflag"}, {"expression": "SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)", "alias": "n"}],
        "SELECT l_returnflag, CAST(SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem GROUP BY 1", group_by=["l_returnflag"])
    c.add("a11_share_of_total", lambda t: share_of_total(t.orders, ["o_orderpriority", "o_orderstatus"], "n", "pct", 4),
          "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 1, 2")


def _windows(c: Catalog) -> None:
    base = [{"column": "event_id"}]
    order = [{"column": "ts"}, {"column": "event_id"}]
    over = "PARTITION BY user_id ORDER BY ts, event_id"

    def add(name, windows, sql, digits=None):
        columns = base + [{"window": w, "alias": a} for a, w in windows.items()]
        c.add(name, _spec({"from": "events", "columns": columns}, "events"), f"SELECT event_id, {sql} FROM events", digits)

    by_user = {"partition_by": ["user_id"], "order_by": order}
    by_type = {"partition_by": ["event_type"], "order_by": [{"column": "v", "direction": "DESC"}]}
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    ranks = [{"window": {"func": f, **by_type}, "alias": f.lower()} for f in ("RANK", "DENSE_RANK")]
    c.add("w1_ranking", lambda t: run_spec(t.spark, {"from": "e", "columns": base + ranks + [{"window": {"func": "ROW_NUMBER", **by_user}, "alias": "row_number"}]}, {"e": t.events.withColumn("v", F.round("value", 0))}),
          f"SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY v DESC) AS rank, dense_rank() OVER (PARTITION BY event_type ORDER BY v DESC) AS dense_rank, row_number() OVER ({over}) AS row_number FROM (SELECT *, round(value, 0) AS v FROM events)")
    add("w2_ntile", {"quarter": {"func": "NTILE", "n": 4, "partition_by": ["event_type"], "order_by": order}}, "ntile(4) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS quarter")
    add("w3_lag_lead", {"before": {"func": "LAG", "column": "value", "offset": 2, **by_user}, "after": {"func": "LEAD", "column": "value", "default_value": -1.0, **by_user}},
        f"lag(value, 2) OVER ({over}) AS before, lead(value, 1, -1.0) OVER ({over}) AS after")
    add("w4_first_last", {"first": {"func": "FIRST_VALUE", "column": "value", **by_user}, "last": {"func": "LAST_VALUE", "column": "value", "frame": whole, **by_user}},
        f"first_value(value) OVER ({over}) AS first, last_value(value) OVER ({over} {whole}) AS last")
    add("w5_nth_value", {"third": {"func": "NTH_VALUE", "column": "value", "n": 3, "frame": whole, **by_user}}, f"nth_value(value, 3) OVER ({over} {whole}) AS third")
    add("w6_aggregates", {"n": {"func": "COUNT", "column": "value", **by_user}, "total": {"func": "SUM", "column": "value", "partition_by": ["user_id"]}, "best": {"func": "MAX", "column": "value", **by_user}},
        f"count(value) OVER ({over}) AS n, sum(value) OVER (PARTITION BY user_id) AS total, max(value) OVER ({over}) AS best", {"total": 4})
    add("w6_distinct", {"kinds": {"func": "COUNT", "column": "event_type", "distinct": True, "partition_by": ["user_id"]}, "so_far": {"func": "COUNT", "column": "event_type", "distinct": True, **by_user}},
        f"count(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds, count(DISTINCT event_type) OVER ({over}) AS so_far")
    frames = {
        "running": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "near": "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING",
        "last7": "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW", "whole": whole,
    }
    add("w7_frames", {a: {"func": "AVG", "column": "value", "frame": f, **by_user} for a, f in frames.items()},
        ", ".join(f"avg(value) OVER ({over} {f}) AS {a}" for a, f in frames.items()), {a: 8 for a in frames})
    c.add("w7_range_frame", _spec({"from": "events", "columns": base + [{"window": {"func": "COUNT", "column": "value", "partition_by": ["event_type"], "order_by": ["user_id"], "frame": "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"}, "alias": "n"}]}, "events"),
          "SELECT event_id, count(value) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events")

    from lodeframe.plans.windows import add_window

    def split(window, name):
        return lambda t: add_window(t.events.select("event_id", "user_id", "event_type", "ts", "value"), window, name, group_rows=0).select("event_id", name)

    by_id = {"order_by": ["event_id"]}
    c.add("w1_row_number_split", split({"func": "ROW_NUMBER", "order_by": [{"column": "event_id", "direction": "DESC"}]}, "n"), "SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS n FROM events")
    c.add("w1_rank_split", split({"func": "RANK", "partition_by": ["event_type"], "order_by": ["user_id"]}, "n"), "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS n FROM events")
    c.add("w1_dense_rank_split", split({"func": "DENSE_RANK", "order_by": ["user_id"]}, "n"), "SELECT event_id, dense_rank() OVER (ORDER BY user_id) AS n FROM events")
    c.add("w2_ntile_split", split({"func": "NTILE", "n": 7, **by_id}, "n"), "SELECT event_id, ntile(7) OVER (ORDER BY event_id) AS n FROM events")
    c.add("w3_lag_split", split({"func": "LAG", "column": "user_id", "offset": 3, **by_id}, "n"), "SELECT event_id, lag(user_id, 3) OVER (ORDER BY event_id) AS n FROM events")
    c.add("w6_running_sum_split", split({"func": "SUM", "column": "value", "partition_by": ["event_type"], "order_by": ["event_id"]}, "n"), "SELECT event_id, sum(value) OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events", {"n": 4})
    c.add("w7_sliding_split", split({"func": "AVG", "column": "value", "frame": "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING", **by_id}, "n"), "SELECT event_id, avg(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM events", {"n": 5})
    by_text = {"order_by": [{"column": "event_type", "direction": "DESC"}, "user_id", "event_id"]}
    over_text = "OVER (ORDER BY event_type DESC, user_id, event_id"
    for function, call in (("FIRST_VALUE", "first_value(value)"), ("LAST_VALUE", "last_value(value)"), ("NTH_VALUE", "nth_value(value, 5)"), ("MIN", "min(value)"), ("MAX", "max(value)"), ("ROW_NUMBER", "row_number()"), ("RANK", "rank()")):
        c.add(f"w4_{function.lower()}_split_text", split({"func": function, "column": "value", "n": 5, **by_text}, "n"), f"SELECT event_id, {call} {over_text}) AS n FROM events")
    c.add("w7_running_rows_split", split({"func": "MAX", "column": "value", "partition_by": ["event_type"], "order_by": ["ts", "event_id"], "frame": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"}, "n"),
          "SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events")
    c.add("w8_qualify", lambda t: run_spec(t.spark, {
        "ctes": [{"name": "ranked", "query": {"from": "events", "columns": [{"column": "event_id"}, {"column": "user_id"}, {"window": {"func": "ROW_NUMBER", **by_user}, "alias": "r"}]}}],
        "from": "ranked", "where": [{"column": "r", "op": "<=", "value": 2}]}, {"events": t.events}),
        f"SELECT event_id, user_id, row_number() OVER ({over}) AS r FROM events QUALIFY r <= 2")


def _sorting(c: Catalog) -> None:
    holes = "CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size END"
    for name, direction, nulls in (("o1_order_nulls_default", "DESC", ""), ("o1_order_nulls_first", "ASC", "FIRST")):
        spec = {"from": "p", "columns": [{"column": "p_partkey"}, {"column": "size"}], "order_by": [{"column": "size", "direction": direction, "nulls": nulls}, {"column": "p_partkey * -1", "is_expression": True}], "limit": 40}
        c.add(name, lambda t, spec=spec: run_spec(t.spark, spec, {"p": t.part.withColumn("size", F.expr(holes))}),
              f"SELECT p_partkey, {holes} AS size FROM part ORDER BY size {direction} NULLS {nulls or 'LAST'}, p_partkey DESC LIMIT 40")
    c.add("o2_limit_offset", _spec({"from": "orders", "columns": [{"column": "o_orderkey"}], "order_by": [{"column": "o_totalprice"}, {"column": "o_orderkey"}], "limit": 25, "offset": 50}, "orders"),
          "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
    from lodeframe.operators.templates import top_per_group, top_rows

    c.add("o3_top_rows", lambda t: top_rows(t.lineitem, "l_extendedprice", 20, ("l_orderkey", "l_linenumber")), "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
    c.add("o4_top_per_group", lambda t: top_per_group(t.orders, "o_orderpriority", "o_totalprice", 5, ("o_orderkey",)),
          "SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5")


def _sets_and_workspace(c: Catalog) -> None:
    def halves(t):
        return {"f": t.orders.where("o_orderstatus = 'F'").drop("o_orderpriority"), "o": t.orders.where("o_orderstatus = 'O'").drop("o_totalprice")}

    union = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, NULL AS o_orderpriority, 'f' AS \"{0}\" FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, NULL, o_orderdate, o_orderpriority, 'o' FROM orders WHERE o_orderstatus = 'O'"
    c.add("u1_merge_tables", lambda t: setops.merge_tables(halves(t)), union.format("__source_file__"))
    c.add("u2_merge_sheets", lambda t: setops.merge_tables(halves(t), "__source_sheet__"), union.format("__source_sheet__"))

    def thirds(t):
        return halves(t) | {"p": t.orders.where("o_orderstatus = 'P'")}

    whole = union + " UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'p' FROM orders WHERE o_orderstatus = 'P'"
    c.add("u1_merge_tables_all", lambda t: setops.merge_tables(thirds(t)), whole.format("__source_file__"))
    c.add("u2_merge_sheets_all", lambda t: setops.merge_tables(thirds(t), "__source_sheet__"), whole.format("__source_sheet__"))

    def views(t, sql):
        for n in ("customer", "supplier", "orders", "lineitem"):
            getattr(t, n).createOrReplaceTempView(n)
        return run_sql(t.spark, sql)

    for name, word in (("u3_union", "UNION"), ("u3_union_all", "UNION ALL"), ("u3_intersect", "INTERSECT"), ("u3_except", "EXCEPT")):
        sql = f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 {word} SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000"
        c.add(name, lambda t, sql=sql: views(t, sql), sql)
    c.add("u4_compare_queries", lambda t: setops.compare_queries(t.orders.select("o_custkey"), t.orders.where("o_totalprice > 100000").select("o_custkey")),
          "SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS rows_b, (SELECT count(*) FROM orders WHERE NOT o_totalprice > 100000) AS only_a, CAST(0 AS BIGINT) AS only_b, TRUE AS same_columns")

    def registered(t):
        w = Workspace(t.spark)
        for n in ("nation", "orders"):
            w.register(getattr(t, n), f"{n} table.csv", file_id=n)
        w.unregister(w.register(t.region, "1region.csv"))
        return w.tables()

    c.add("q1_register_and_q3_list", registered,
          "SELECT 'nation_table' AS name, 'nation table.csv' AS original_name, 'raw' AS source, 'nation' AS file_id, count(*) AS n_rows, 3 AS n_cols FROM nation UNION ALL SELECT 'orders_table', 'orders table.csv', 'raw', 'orders', count(*), 6 FROM orders")

    def unregistered(t):
        w = Workspace(t.spark)
        gone = w.register(t.region, "gone.csv")
        w.register(t.orders, "kept.csv")
        w.unregister(gone)
        return w.tables().select("name", "n_rows")

    c.add("q2_unregister", unregistered, "SELECT 'kept' AS name, count(*) AS n_rows FROM orders")

    def info_sql(table, cols):
        parts = [f"SELECT '{n}' AS \"column\", '{k}' AS dtype, '{u}' AS ui_type, count(*) - count(\"{n}\") AS null_count, 0.0::DOUBLE AS null_pct, count(DISTINCT \"{n}\") AS \"distinct\" FROM {table}" for n, k, u in cols]
        return " UNION ALL ".join(parts)

    c.add("q4_column_info", lambda t: column_info(t.orders, samples=0), info_sql("orders", [
        ("o_orderkey", "bigint", "integer"), ("o_custkey", "bigint", "integer"), ("o_orderstatus", "string", "categorical"),
        ("o_totalprice", "double", "float"), ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "categorical")]))
    c.add("q5_column_values", lambda t: column_values(t.part, "p_type", 50), "SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 50")
    c.add("q6_preview", lambda t: preview(t.orders.orderBy("o_orderkey"), 10), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
    sql = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"
    c.add("q7_run_sql", lambda t: views(t, sql), sql, {"qty": 2})

    def view(t):
        t.orders.createOrReplaceTempView("orders")
        w = Workspace(t.spark)
        name = w.create_view("urgent orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
        found = t.spark.table(name)
        assert w.views().count() == 1
        w.drop_view(name)
        return found

    c.add("q9_view", view, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")

    def cached(t):
        t.orders.createOrReplaceTempView("orders")
        w = Workspace(t.spark)
        text = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"
        assert w.run_cached(text) is w.run_cached(text)
        return w.run_cached(text)

    c.add("q10_cached_result", cached, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
    c.add("q11_override_int", lambda t: override_type(t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p")), "p", "int"),
          "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p FROM orders")
    c.add("q11_override_datetime", lambda t: override_type(t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "d", "datetime"),
          "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS d FROM orders")
    c.add("q11_override_float", lambda t: override_type(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("x")), "x", "float"),
          "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS x FROM orders")

    def template(t):
        t.orders.createOrReplaceTempView("orders")
        return run_template(t.spark, "SELECT {{col}}, count(*) AS n FROM orders WHERE o_orderstatus = '{{status}}' AND o_totalprice > {{low}} GROUP BY {{col}}", {"col": ("identifier", "o_orderpriority"), "status": "F", "low": 150000})

    c.add("q12_template", template, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000 GROUP BY 1")


def register(c: Catalog) -> None:
    for part in (_flagship, _predicates, _joins, _aggregates, _windows, _sorting, _sets_and_workspace):
        part(c)
