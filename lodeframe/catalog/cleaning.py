"""Cleaning transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.catalog.base import Catalog
from lodeframe.catalog.templates import DIRTY_SQL, dirty
from lodeframe.operators.clean import balance, encode, outliers, recipe, scale, text, times, types
from lodeframe.operators.clean import rows as basic

KEYS = "l_orderkey, l_linenumber"
# Events with holes that depend on their keys.
HOLES = "CASE WHEN event_id % 3 = 0 OR event_id % 50 < 4 THEN NULL ELSE value END"
EVENTS_SQL = f"(SELECT event_id, user_id, ts, {HOLES} AS v FROM events)"


def events(t):
    return t.events.select("event_id", "user_id", "ts", F.expr(HOLES).alias("v"))


def lines(t):
    """One column that tells every line apart."""
    return dirty(t).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _rows(c: Catalog) -> None:
    cols = ("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    names = ", ".join(cols)
    c.add("c1_drop_duplicates", lambda t: basic.drop_duplicates(t.lineitem.select(*cols)), f"SELECT DISTINCT {names} FROM lineitem")
    for keep, way in (("first", ""), ("last", " DESC")):
        c.add(f"c1_keep_{keep}", lambda t, keep=keep: basic.drop_duplicates(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], keep),
              f"SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey{way}) = 1")
    c.add("c2_flag_duplicates", lambda t: basic.flag_duplicates(t.lineitem.select("l_partkey", "l_quantity", "l_returnflag")),
          "SELECT l_partkey, l_quantity, l_returnflag, count(*) OVER (PARTITION BY l_partkey, l_quantity, l_returnflag) > 1 AS _is_duplicate FROM lineitem")
    c.add("c3_drop_columns", lambda t: basic.drop_columns(t.orders, ["o_orderpriority", "o_orderstatus"]), "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
    c.add("c4_drop_null_rows", lambda t: basic.drop_null_rows(dirty(t), ["l_tax", "l_quantity"]), f"SELECT * FROM {DIRTY_SQL} WHERE l_tax IS NOT NULL AND l_quantity IS NOT NULL")
    sparse = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN NULL ELSE l_tax END AS a, CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_tax END AS b, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS c FROM lineitem)"
    c.add("c5_drop_sparse_rows", lambda t: basic.drop_sparse_rows(t.lineitem.select(
        F.expr("CASE WHEN l_linenumber > 3 THEN NULL ELSE l_tax END").alias("a"), F.expr("CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_tax END").alias("b"),
        F.expr("CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END").alias("c"), "l_orderkey")),
        f"SELECT a, b, c, l_orderkey FROM {sparse} WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT <= 2.4")


def _missing(c: Catalog) -> None:
    d = f"WITH d AS (SELECT * FROM {DIRTY_SQL})"
    pick = ("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    for key, method, value in (("c6_impute_mean", "mean", "avg({0})"), ("c7_impute_median", "median", "median({0})"), ("c9_impute_constant", "constant", "0.0")):
        found = "{1}" if method == "constant" else "(SELECT {0} FROM d)"
        fill = ", ".join(f"coalesce({x}, {found.format(value.format(x), value)}) AS {x}" for x in ("l_tax", "l_quantity"))
        c.add(key, lambda t, m=method: basic.impute(dirty(t).select(*pick), ["l_tax", "l_quantity"], m, 0.0), f"{d} SELECT {KEYS}, {fill} FROM d", {"l_tax": 8, "l_quantity": 6})
    c.add("c8_impute_mode", lambda t: basic.impute(dirty(t).select(*pick), ["l_tax", "l_quantity"], "mode"),
          d + f" SELECT {KEYS}, " + ", ".join(f"coalesce({x}, (SELECT {x} FROM d WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1)) AS {x}" for x in ("l_tax", "l_quantity")) + " FROM d")
    e = f"FROM {EVENTS_SQL}"
    for key, part, over in (("", None, "ORDER BY ts, event_id"), ("_partitioned", ["user_id"], "PARTITION BY user_id ORDER BY ts, event_id")):
        c.add(f"c10_ffill{key}", lambda t, part=part: basic.ffill(events(t), ["v"], "ts", "event_id", part),
              f"SELECT event_id, user_id, ts, last_value(v IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v {e}")
        c.add(f"c11_bfill{key}", lambda t, part=part: basic.bfill(events(t), ["v"], "ts", "event_id", part),
              f"SELECT event_id, user_id, ts, first_value(v IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v {e}")
        c.add(f"c12_interpolate{key}", lambda t, part=part: basic.interpolate(events(t), ["v"], "ts", "event_id", part),
              f"WITH p AS (SELECT *, row_number() OVER ({over}) AS r {e}), x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ra, "
              f"last_value(v IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rb, "
              f"first_value(v IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM p) "
              "SELECT event_id, user_id, ts, CASE WHEN v IS NOT NULL THEN v WHEN ra IS NULL THEN NULL WHEN rb IS NULL THEN va ELSE va + (vb - va) * (r - ra) / (rb - ra) END AS v FROM x", {"v": 6})
    c.add("c13_add_indicator", lambda t: basic.add_indicator(dirty(t).select(*pick), ["l_tax"]),
          f"{d} SELECT {KEYS}, l_quantity, coalesce(l_tax, (SELECT median(l_tax) FROM d)) AS l_tax, (l_tax IS NULL)::INT AS l_tax_was_null FROM d", {"l_tax": 8})
    c.add("c15_flag_nulls", lambda t: basic.flag_nulls(dirty(t).select(*pick), ["l_tax", "l_quantity"]),
          f"SELECT {KEYS}, l_tax, l_quantity, (l_tax IS NULL)::INT AS l_tax_is_null, (l_quantity IS NULL)::INT AS l_quantity_is_null FROM {DIRTY_SQL}")

    holes = "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_retailprice END"
    c.add("c14_impute_knn", lambda t: balance.impute_knn(t.part.select("p_partkey", "p_size", F.expr(holes).alias("price"), (F.col("p_partkey") % 97).alias("m")), ["price"], "p_partkey"),
          f"WITH p AS (SELECT p_partkey, p_size, {holes} AS price, p_partkey % 97 AS m FROM part), n AS (SELECT a.p_partkey, b.price, row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt((a.p_size - b.p_size)^2 + (a.m - b.m)^2), b.p_partkey) AS r "
          "FROM p a, p b WHERE a.price IS NULL AND b.price IS NOT NULL) SELECT p.p_partkey, p_size, coalesce(p.price, (SELECT avg(n.price) FROM n WHERE n.p_partkey = p.p_partkey AND r <= 5)) AS price, m FROM p", {"price": 6})


def _outliers(c: Catalog) -> None:
    d = f"WITH d AS (SELECT {KEYS}, l_quantity AS x FROM {DIRTY_SQL}), s AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.99) AS p99, min(x) AS mn FROM d), f AS (SELECT *, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM s)"

    def x(t):
        return dirty(t).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))

    c.add("c16_flag_outliers", lambda t: outliers.flag_outliers(x(t), ["x"]), f"{d} SELECT {KEYS}, x, coalesce(x < lo OR x > hi, FALSE)::INT AS x_is_outlier FROM d, f")
    c.add("c17_remove_outliers", lambda t: outliers.remove_outliers(x(t), ["x"]), f"{d} SELECT {KEYS}, x FROM d, f WHERE x BETWEEN lo AND hi")
    c.add("c18_winsorize", lambda t: outliers.winsorize(x(t), ["x"]), f"{d} SELECT {KEYS}, CASE WHEN x IS NOT NULL THEN least(greatest(x, p01), p99) END AS x FROM d, f", {"x": 6})
    c.add("c19_cap_outliers", lambda t: outliers.cap_outliers(x(t), ["x"]), f"{d} SELECT {KEYS}, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS x FROM d, f", {"x": 6})
    c.add("c20_log_transform", lambda t: outliers.log_transform(x(t), ["x"]), f"{d} SELECT {KEYS}, ln(1 + x + CASE WHEN mn <= 0 THEN abs(mn) + 1 ELSE 0 END) AS x FROM d, f", {"x": 8})
    c.add("c20_log_transform_shifted", lambda t: outliers.log_transform(t.customer.select("c_custkey", (F.col("c_acctbal") - 5000).alias("b")), ["b"]),
          "SELECT c_custkey, ln(1 + b + abs(mn) + 1) AS b FROM (SELECT c_custkey, c_acctbal - 5000 AS b FROM customer), (SELECT min(c_acctbal - 5000) AS mn FROM customer)", {"b": 8})
    c.add("c66_cap_by_rule", lambda t: outliers.cap_outliers(t.orders.select("o_orderkey", (F.col("o_totalprice") - 100000).alias("price"), (F.col("o_custkey") - 100).alias("age")), ["price", "age"], rule=True),
          "SELECT o_orderkey, greatest(o_totalprice - 100000, 0) AS price, least(greatest(o_custkey - 100, 0), 150)::DOUBLE AS age FROM orders")


def _types(c: Catalog) -> None:
    fmt = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN 'soon' END"
    spark_fmt = "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 3 THEN 'soon' END"
    c.add("c21_parse_dates", lambda t: types.parse_dates(t.orders.select("o_orderkey", F.expr(spark_fmt).alias("d")), ["d"]),
          f"SELECT o_orderkey, coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%Y/%m/%d')) AS d FROM (SELECT o_orderkey, {fmt} AS d FROM orders)")
    money = ("CASE c_custkey % 7 WHEN 0 THEN concat('$', {n}) WHEN 1 THEN concat('(', {n}, ')') WHEN 2 THEN concat({n}, ' €') WHEN 3 THEN concat({n}, '%') WHEN 4 THEN concat('-£', {n}) WHEN 5 THEN concat({n}, 'K') ELSE 'n/a' END")
    spark_n, duck_n = "format_number(c_custkey * 1234, 0)", "format('{:,}', c_custkey * 1234)"
    v = "(c_custkey * 1234)::DOUBLE"
    c.add("c22_parse_currency", lambda t: types.parse_currency(t.customer.select("c_custkey", F.expr(money.format(n=spark_n)).alias("p")), ["p"]),
          f"SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN {v} WHEN 1 THEN -{v} WHEN 2 THEN {v} WHEN 3 THEN {v} / 100 WHEN 4 THEN -{v} WHEN 5 THEN {v} * 1000 END AS p FROM (SELECT c_custkey, {money.format(n=duck_n)} AS p FROM customer)", {"p": 4})
    words = "CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'ACTIVE' END"
    c.add("c23_standardize_booleans", lambda t: types.standardize_booleans(t.orders.select("o_orderkey", F.expr(words).alias("b")), ["b"]),
          "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS b FROM orders")
    nulls = "CASE o_orderkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN ' unknown' ELSE CAST(o_custkey AS {s}) END"
    c.add("c24_replace_pseudo_nulls", lambda t: types.replace_pseudo_nulls(t.orders.select("o_orderkey", F.expr(nulls.format(s="STRING")).alias("x"), "o_orderstatus"), ["x", "o_orderstatus"]),
          "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN o_custkey::DOUBLE END AS x, o_orderstatus FROM orders")
    c.add("c25_as_category", lambda t: types.as_category(t.part.select("p_partkey", "p_size"), ["p_size"]), "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
    c.add("c26_expand_json", lambda t: types.expand_json(t.events.select("event_id", "props"), ["props"]), "SELECT event_id, CAST(props->>'k' AS BIGINT) AS props_k FROM events")


def _text(c: Catalog) -> None:
    squeeze = r"regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '\s+', ' ', 'g')"
    c.add("c27_normalize_light", lambda t: text.normalize_text(t.conversations.select("conv_id", "turn", "text"), ["text"], "light"),
          f"SELECT conv_id, turn, lower({squeeze.format('text')}) AS text FROM conversations")
    c.add("c27_normalize_full", lambda t: text.normalize_text(t.documents.select("doc_id", "text"), ["text"], "full"))
    c.add("c27_html_only", lambda t: text.normalize_text(t.pages.select("page_id", "html"), ["html"], "html_only"))
    feature = "CAST(len(regexp_extract_all(text, '{0}')) AS DOUBLE) / greatest(length(text), 1)"
    words = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
    c.add("c28_text_features", lambda t: text.text_features(t.benchmark, ["text"]),
          f"SELECT item_id, text, len({words}) AS text_token_count, length(text) AS text_char_count, coalesce(round(CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS DOUBLE) / nullif(len({words}), 0), 2), 0) AS text_avg_word_length, "
          f"round({feature.format(chr(92) + 'p{Lu}')}, 3) AS text_capitalization_ratio, round({feature.format('[0-9]')}, 3) AS text_digit_ratio, "
          + "round(" + feature.format(r"[.,;:!?\-()\[\]{}\"'']") + ", 3) AS text_punctuation_density, "
          "len(regexp_extract_all(text, '[.!?]+')) AS text_sentence_count FROM benchmark")
    c.add("c28_text_features_documents", lambda t: text.text_features(t.documents.select("doc_id", "text"), ["text"]),
          f"SELECT doc_id, text, len({words}) AS text_token_count, length(text) AS text_char_count, coalesce(round(CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS DOUBLE) / nullif(len({words}), 0), 2), 0) AS text_avg_word_length, "
          f"round({feature.format(chr(92) + 'p{Lu}')}, 3) AS text_capitalization_ratio, round({feature.format('[0-9]')}, 3) AS text_digit_ratio, "
          + "round(" + feature.format(r"[.,;:!?\-()\[\]{}\"'']") + ", 3) AS text_punctuation_density, "
          "len(regexp_extract_all(text, '[.!?]+')) AS text_sentence_count FROM documents")
    stops = ["the", "and", "of", "in", "der", "die", "de", "la", "le"]
    listed = ", ".join(f"'{w}'" for w in stops)
    c.add("c29_remove_stopwords", lambda t: text.remove_stopwords(t.conversations.select("conv_id", "turn", "text"), ["text"], stops=stops),
          f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}_]+'), lambda w: regexp_full_match(w, '\\p{{L}}+') AND w NOT IN ({listed})), ' ') AS text FROM conversations")
    c.add("c29_stemmed", lambda t: text.remove_stopwords(t.conversations.select("conv_id", "turn", "text"), ["text"], "en", True))
    grams = "list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]))"
    c.add("c30_tfidf_weights", lambda t: text.tfidf_weights(t.documents, "text", "doc_id", stops=stops),
          f"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}'), lambda x: x NOT IN ({listed})) AS u FROM documents), g AS (SELECT doc_id, unnest({grams}) AS term FROM w), n AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY 1, 2), "
          "v AS (SELECT term, sum(n) AS tf, count(*) AS df FROM n GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY tf DESC, term LIMIT 100), x AS (SELECT doc_id, term, n * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM n JOIN v USING (term)) "
          "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM x", {"weight": 8})
    c.add("c30_tfidf", lambda t: text.tfidf(t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "text", "id", 20))
    c.add("c54_casing", lambda t: text.casing(text.casing(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name"], "upper"), ["p_brand"], "lower"),
          "SELECT p_partkey, upper(p_name) AS p_name, lower(p_brand) AS p_brand FROM part")
    c.add("c54_title", lambda t: text.casing(t.part.select("p_partkey", "p_name"), ["p_name"], "title"),
          "SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) AS p_name FROM part")
    pad = "CASE WHEN p_partkey % 2 = 0 THEN concat('  ', replace(p_name, ' ', '   '), ' ') ELSE p_name END"
    c.add("c55_whitespace", lambda t: text.whitespace(t.part.select("p_partkey", F.expr(pad).alias("n")), ["n"]), "SELECT p_partkey, p_name AS n FROM part")
    c.add("c56_unicode_nfc", lambda t: text.unicode_nfc(t.documents.select("doc_id", "text"), ["text"]), "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
    clusters = [{"canonical": "urgent", "variants": ["1-URGENT", "urgent"]}, {"canonical": "other", "variants": ["4-NOT SPECIFIED", "5-LOW"]}]
    c.add("c57_map_values", lambda t: text.map_values(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", clusters),
          "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'other' ELSE o_orderpriority END AS o_orderpriority FROM orders")
    c.add("c58_standardize_email", lambda t: text.standardize_email(t.customer.select("c_custkey", F.expr("concat('  ', c_name, '@Example.COM ')").alias("e")), ["e"]),
          "SELECT c_custkey, lower(c_name || '@example.com') AS e FROM customer")
    c.add("c59_precision", lambda t: text.precision(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("x")), ["x"], 0),
          "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS x FROM lineitem")


def _encode(c: Catalog) -> None:
    def o(t):
        return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")

    c.add("c31_label_encode", lambda t: encode.label_encode(o(t), ["o_orderpriority"]), "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority, o_totalprice FROM orders")
    c.add("c31_label_encode_numeric", lambda t: encode.label_encode(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"]), "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS o_custkey FROM orders")
    levels = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    for name, kept in (("c32_one_hot", levels), ("c32_one_hot_drop_first", levels[1:])):
        c.add(name, lambda t, first=len(kept) < 6: encode.one_hot(t.part.select("p_partkey", "p_type"), ["p_type"], first),
              "SELECT p_partkey, " + ", ".join(f"(p_type = '{x}')::INT AS \"p_type_{x}\"" for x in kept) + " FROM part")
    c.add("c33_frequency_encode", lambda t: encode.frequency_encode(o(t), ["o_orderpriority"]), "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS o_orderpriority, o_totalprice FROM orders")
    c.add("c33_proportion_encode", lambda t: encode.frequency_encode(o(t), ["o_orderpriority"], True),
          "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) / (count(*) OVER ())::DOUBLE AS o_orderpriority, o_totalprice FROM orders", {"o_orderpriority": 8})
    c.add("c34_ordinal_encode", lambda t: encode.ordinal_encode(o(t), ["o_orderpriority"], ["5-LOW", "3-MEDIUM", "1-URGENT"]),
          "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 END AS o_orderpriority, o_totalprice FROM orders")
    c.add("c35_target_encode_loo", lambda t: encode.target_encode(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice"),
          "SELECT o_orderkey, coalesce((sum(o_totalprice) OVER w - o_totalprice) / nullif(count(*) OVER w - 1, 0), avg(o_totalprice) OVER ()) AS o_custkey, o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey)", {"o_custkey": 6})
    c.add("c35_target_encode_kfold", lambda t: encode.target_encode(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "kfold", "o_orderkey"))
    code = "(dense_rank() OVER (ORDER BY p_brand) - 1)"
    c.add("c36_binary_encode", lambda t: encode.binary_encode(t.part.select("p_partkey", "p_brand"), ["p_brand"]),
          "SELECT p_partkey, " + ", ".join(f"(({code} >> {b}) & 1)::INT AS p_brand_bit{b}" for b in range(5)) + " FROM part")
    c.add("c37_hash_encode", lambda t: encode.hash_encode(t.part.select("p_partkey", "p_brand"), ["p_brand"], 16))
    c.add("c38_cyclical_encode", lambda t: encode.cyclical_encode(t.orders.select("o_orderkey", F.month("o_orderdate").alias("m")), "m", 12),
          "SELECT o_orderkey, sin(2 * pi() * month(o_orderdate) / 12) AS m_sin, cos(2 * pi() * month(o_orderdate) / 12) AS m_cos FROM orders", {"m_sin": 9, "m_cos": 9})


def _times(c: Catalog) -> None:
    parts = {
        "year": "year({0})", "month": "month({0})", "month_name": "monthname({0})", "quarter": "quarter({0})", "week": "weekofyear({0})", "day": "day({0})",
        "dayofweek": "isodow({0}) - 1", "day_name": "dayname({0})", "hour": "hour({0})", "minute": "minute({0})", "second": "second({0})",
    }
    c.add("c39_extract_datetime", lambda t: times.extract_datetime(t.events.select("event_id", "ts"), ["ts"]),
          "SELECT event_id, ts, " + ", ".join(f"{e.format('ts')} AS ts_{p}" for p, e in parts.items()) + " FROM events")
    d, n = "o_orderdate", "(o_orderdate + INTERVAL 1 DAY)"
    flags = {
        "is_weekend": f"isodow({d}) >= 6", "is_month_start": f"day({d}) = 1", "is_month_end": f"day({n}) = 1", "is_quarter_start": f"day({d}) = 1 AND month({d}) % 3 = 1",
        "is_quarter_end": f"day({n}) = 1 AND month({n}) % 3 = 1", "is_year_start": f"dayofyear({d}) = 1", "is_year_end": f"dayofyear({n}) = 1",
    }
    c.add("c40_datetime_flags", lambda t: times.datetime_flags(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"]),
          "SELECT o_orderkey, o_orderdate, " + ", ".join(f"({e})::INT AS o_orderdate_{f}" for f, e in flags.items()) + " FROM orders")
    for unit, div in (("days", 86400), ("hours", 3600), ("minutes", 60)):
        c.add(f"c41_elapsed_{unit}", lambda t, u=unit: times.elapsed(t.events.select("event_id", "ts"), "ts", u),
              f"SELECT event_id, ts, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 / {div} AS ts_elapsed_{unit} FROM events")
    c.add("c42_time_delta", lambda t: times.time_delta(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate"), "o_orderdate", "l_shipdate", "hours"),
          "SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate, date_diff('second', o_orderdate, l_shipdate) / 3600.0 AS l_shipdate_minus_o_orderdate_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey", {"l_shipdate_minus_o_orderdate_hours": 6})

    def features(over):
        lags = ", ".join(f"lag(value, {k}) OVER ({over}) AS value_lag{k}" for k in (1, 3, 7))
        means = ", ".join(f"avg(value) OVER ({over} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS value_roll_mean_{k}" for k in (7, 14, 30))
        return f"SELECT event_id, user_id, ts, value, {lags}, {means}, lead(value, 1) OVER ({over}) AS value_lead1 FROM events"

    digits = {f"value_roll_mean_{k}": 8 for k in (7, 14, 30)}
    c.add("c43_ts_features", lambda t: times.ts_features(t.events.select("event_id", "user_id", "ts", "value"), "ts", ["value"], "event_id"), features("ORDER BY ts, event_id"), digits)
    c.add("c43_ts_features_partitioned", lambda t: times.ts_features(t.events.select("event_id", "user_id", "ts", "value"), "ts", ["value"], "event_id", partition=["user_id"]), features("PARTITION BY user_id ORDER BY ts, event_id"), digits)


def _scale(c: Catalog) -> None:
    def x(t):
        return dirty(t).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))

    d = f"WITH d AS (SELECT {KEYS}, l_quantity AS x FROM {DIRTY_SQL}), s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx, median(x) AS mid, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM d)"
    for key, method, e in (
        ("c44_standard", "standard", "(x - m) / sd"), ("c44_minmax", "minmax", "(x - mn) / (mx - mn)"), ("c44_maxabs", "maxabs", "x / greatest(abs(mn), abs(mx))"),
        ("c44_robust", "robust", "(x - mid) / (q3 - q1)"), ("c45_log1p", "log1p", "ln(1 + x)"), ("c48_binarize", "binarize", "coalesce(x >= mid, FALSE)::INT"),
    ):
        c.add(key, lambda t, m=method: scale.scale(x(t), ["x"], m), f"{d} SELECT {KEYS}, {e} AS x FROM d, s", None if method == "binarize" else {"x": 7})
    c.add("c46_boxcox", lambda t: scale.scale(t.customer.select("c_custkey", (F.col("c_acctbal") + 2000).alias("x")), ["x"], "boxcox"))
    c.add("c46_yeojohnson", lambda t: scale.scale(t.customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("x")), ["x"], "yeojohnson"))
    c.add("c47_quantile_uniform", lambda t: scale.scale(t.events.select("event_id", "value"), ["value"], "quantile_uniform"))
    c.add("c47_quantile_normal", lambda t: scale.scale(t.events.select("event_id", "value"), ["value"], "quantile_normal"))
    c.add("c49_pca", lambda t: scale.pca(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2))


def _balance(c: Catalog) -> None:
    hashed = "('0x' || left(md5(concat_ws(':', {}, '{}')), 15))::BIGINT"
    ranked = f"SELECT *, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY {hashed.format('doc_id', 42)}, doc_id) - 1 AS p FROM labels"
    c.add("c50_oversample", lambda t: balance.oversample(t.labels, "quality", "doc_id").groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("copies")),
          f"WITH r AS ({ranked}), m AS (SELECT max(n) AS m FROM r) SELECT doc_id, quality, m // n + (p < m % n)::BIGINT AS copies FROM r, m")
    c.add("c51_undersample", lambda t: balance.undersample(t.labels, "quality", "doc_id"),
          f"WITH r AS ({ranked}) SELECT * EXCLUDE (n, p) FROM r WHERE p < (SELECT min(n) FROM r)")

    def vectors(t):
        return t.embeddings.select("vec_id", (F.col("label") == 0).cast("int").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)])

    c.add("c52_smote", lambda t: balance.smote(vectors(t), "y", "vec_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("_new").alias("made")),
          "WITH k AS (SELECT (label = 0)::INT AS y, count(*) AS n FROM embeddings GROUP BY 1) SELECT y, max(n) OVER () AS n, max(n) OVER () - n AS made FROM k")
    c.add("c52_smote_points", lambda t: balance.smote_points(vectors(t), "y", "vec_id", [f"x{i}" for i in range(64)]).select("class", "id", "i", "neighbour", "u", F.aggregate("point", F.lit(0.0), lambda s, x: s + x).alias("total"), F.col("point")[63].alias("last")),
          f"WITH e AS (SELECT vec_id AS id, (label = 0)::INT AS y, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT y, count(*) AS n FROM e GROUP BY 1), m AS (SELECT max(n) AS m FROM s), "
          f"r AS (SELECT e.*, n, m, row_number() OVER (PARTITION BY y ORDER BY {hashed.format('id', 42)}, id) - 1 AS p FROM e JOIN s USING (y), m WHERE n < m), "
          "near AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM r a JOIN r b ON a.y = b.y AND a.id <> b.id), "
          "d AS (SELECT *, unnest(range(1, (m - n) // n + (p < (m - n) % n)::BIGINT + 1)) AS i FROM r), "
          f"w AS (SELECT d.*, {hashed.format('d.id, i', 42)} % 5 + 1 AS rank, ({hashed.format('d.id, i', 43)} % (1 << 30)) / (1 << 30)::DOUBLE AS u FROM d) "
          "SELECT w.y AS class, w.id, w.i, near.neighbour, u, list_sum(w.v) + u * (list_sum(b.v) - list_sum(w.v)) AS total, w.v[64] + u * (b.v[64] - w.v[64]) AS last FROM w JOIN near ON near.id = w.id AND near.rank = w.rank JOIN e b ON b.id = near.neighbour", {"total": 6, "last": 9})
    c.add("c53_class_weights", lambda t: balance.class_weights(t.orders, "o_orderstatus"),
          "SELECT o_orderstatus AS class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 4) AS weight FROM orders GROUP BY 1")


def _recipe(c: Catalog) -> None:
    steps = [
        {"action": "impute_median", "column": "tax"}, {"action": "cap_outliers", "columns": ["l_quantity"]},
        {"action": "drop_rows", "column": "l_quantity"}, {"action": "minmax_scale", "column": "l_quantity"},
    ]
    base = ("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    made = (f"WITH d AS (SELECT {KEYS}, l_quantity AS x, l_tax FROM {DIRTY_SQL}), f AS (SELECT quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo, quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS hi, median(l_tax) AS mid FROM d), "
            f"e AS (SELECT {KEYS}, least(greatest(x, lo), hi) AS x, coalesce(l_tax, mid) AS l_tax FROM d, f WHERE x IS NOT NULL) SELECT {KEYS}, (x - (SELECT min(x) FROM e)) / ((SELECT max(x) FROM e) - (SELECT min(x) FROM e)) AS l_quantity, l_tax FROM e")
    c.add("c60_apply_recipe", lambda t: recipe.apply_recipe(dirty(t).select(*base), steps, {"tax": "l_tax"}), made, {"l_quantity": 8, "l_tax": 8})
    c.add("c60_recipe_report", lambda t: recipe.recipe_report(dirty(t).select(*base), steps, {"tax": "l_tax"}),
          f"WITH d AS (SELECT count(*) AS n, count(l_quantity) AS k FROM {DIRTY_SQL}) SELECT 0 AS step, 'impute_median' AS action, n AS rows_before, n AS rows_after, 4 AS columns_before, 4 AS columns_after FROM d "
          "UNION ALL SELECT 1, 'cap_outliers', n, n, 4, 4 FROM d UNION ALL SELECT 2, 'drop_rows', n, k, 4, 4 FROM d UNION ALL SELECT 3, 'minmax_scale', k, k, 4, 4 FROM d")
    what_if = [{"action": "fill_nulls", "column": "l_tax", "params": {"strategy": "median"}}, {"action": "drop_duplicates"}, {"action": "standardize", "column": "l_quantity"}]
    c.add("c61_simulate", lambda t: recipe.simulate(dirty(t), what_if, 10))
    c.add("c61_commit", lambda t: recipe.commit(dirty(t).select(*base), [{"action": "fill_nulls", "column": "l_tax", "params": {"strategy": "zero"}}, {"action": "normalize", "column": "l_quantity"}]),
          f"WITH d AS (SELECT * FROM {DIRTY_SQL}) SELECT {KEYS}, (l_quantity - (SELECT min(l_quantity) FROM d)) / ((SELECT max(l_quantity) FROM d) - (SELECT min(l_quantity) FROM d)) AS l_quantity, coalesce(l_tax, 0) AS l_tax FROM d", {"l_quantity": 8})
    cols = ("l_returnflag", "l_tax", "l_discount", "l_linenumber")
    c.add("c62_readiness", lambda t: recipe.readiness(dirty(t).select(*cols)).drop("null_pct"),
          f"WITH d AS (SELECT {', '.join(cols)} FROM {DIRTY_SQL}), k AS (SELECT count(*) AS n, 2 * count(*) - count(l_tax) - count(l_discount) AS nulls FROM d), u AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM d)) "
          "SELECT n AS rows, 4 AS columns, nulls AS null_total, n - u AS duplicates, 3 AS numeric_cols, CAST(floor(100 - least(nulls * 200.0 / (n * 4), 30) - least((n - u) * 100.0 / n, 15)) AS INT) AS score FROM k, u")

    def changed(t):
        return t.customer.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_acctbal + 1 ELSE c_acctbal END")).withColumnRenamed("c_name", "name")

    c.add("c63_table_diff", lambda t: recipe.table_diff(t.customer, changed(t), "c_custkey").where("change not like 'column%'"),
          "WITH s AS (SELECT count(*) FILTER (c_custkey % 5 = 0) AS gone, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 <> 2) AS ch, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 = 0) AS nu FROM customer), "
          "z AS (SELECT unnest(['c_custkey', 'c_nationkey', 'c_mktsegment', 'c_acctbal']) AS k) "
          "SELECT NULL AS \"column\", 'rows_removed' AS change, gone AS n FROM s UNION ALL SELECT NULL, 'rows_added', 0 UNION ALL SELECT k, 'values_changed', CASE WHEN k = 'c_acctbal' THEN ch ELSE 0 END FROM z, s "
          "UNION ALL SELECT k, 'nulls_before', 0 FROM z UNION ALL SELECT k, 'nulls_after', CASE WHEN k = 'c_acctbal' THEN nu ELSE 0 END FROM z, s")

    def repairs(t):
        return t.customer.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("key"), F.lit("c_acctbal").alias("column"), F.lit("12.5").alias("value")).union(
            t.customer.where("c_custkey % 10 = 4").select("c_custkey", F.lit("c_name"), F.concat(F.lit("fixed "), "c_custkey")))

    c.add("c64_apply_repairs", lambda t: recipe.apply_repairs(t.customer, repairs(t), "c_custkey"),
          "SELECT c_custkey, CASE WHEN c_custkey % 10 = 4 THEN 'fixed ' || c_custkey ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 10 = 3 THEN 12.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")


def register(c: Catalog) -> None:
    for part in (_rows, _missing, _outliers, _types, _text, _encode, _times, _scale, _balance, _recipe):
        part(c)
