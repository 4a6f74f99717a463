"""Specs, workspace, recipes and sources: errors, nulls, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.strings import clusters_of, jaro_winkler
from lodeframe.operators import keys, links, setops, templates
from lodeframe.operators.clean import balance, encode, recipe, text, types
from lodeframe.operators.clean import rows as basic
from lodeframe.operators.detect import features, structure
from lodeframe.operators.detect.plan import auto_clean, cleaning_plan, steps_from_plan
from lodeframe.operators.insight import quality_facts, quality_score
from lodeframe.operators.profile import columns, semantics, whole
from lodeframe.plans.spec import SpecError, join_tables, run_spec
from lodeframe.plans.windows import add_window, frame_bounds
from lodeframe.sources import readers, writers
from lodeframe.workspace import ReadOnlyError, Workspace, column_info, run_sql, run_template, safe_name


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", "A", 30.0), (2, "Bob", "B", None), (3, "Cid", "A", 50.0), (4, None, "B", 20.0), (5, "Eve", None, 40.0)]
    return spark.createDataFrame(rows, "id int, name string, team string, age double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def where(spark, people, *conditions):
    return ids(run_spec(spark, {"from": "p", "columns": [{"column": "id"}], "where": list(conditions)}, {"p": people}))


def test_nulls_in_conditions(spark, people):
    assert where(spark, people, {"column": "team", "op": "NOT IN", "values": ["A"]}) == [2, 4]
    assert where(spark, people, {"column": "age", "op": "!=", "value": 30}) == [3, 4, 5]
    assert where(spark, people, {"column": "name", "op": "IS NULL"}) == [4]
    assert where(spark, people, {"column": "name", "op": "CONTAINS", "value": "%"}) == []


def test_not_in_subquery_follows_three_valued_logic(spark, people):
    teams = lambda cond: {"from": "p", "columns": [{"column": "team"}], "where": [cond]}
    cond = lambda sub: {"column": "team", "op": "NOT IN", "subquery": sub}
    assert where(spark, people, cond(teams({"column": "id", "op": "=", "value": 1}))) == [2, 4]
    assert where(spark, people, cond(teams({"column": "id", "op": ">=", "value": 4}))) == []
    assert where(spark, people, cond(teams({"column": "id", "op": ">", "value": 99}))) == [1, 2, 3, 4, 5]
    either = [cond(teams({"column": "id", "op": ">=", "value": 4})), {"logic": "OR", "column": "id", "value": 1}]
    assert where(spark, people, *either) == [1]


def test_spec_errors(spark, people):
    with pytest.raises(SpecError):
        run_spec(spark, {"columns": []})
    with pytest.raises(SpecError):
        run_spec(spark, {"from": "p", "where": [{"column": "id", "op": "NEARLY", "value": 1}]}, {"p": people})
    with pytest.raises(SpecError):
        run_spec(spark, {"from": "p", "columns": [{"column": "name"}, {"aggregate": "COUNT", "column": "*"}], "group_by": ["team"]}, {"p": people})
    wide = spark.range(400)
    with pytest.raises(SpecError):
        join_tables(wide, wide, "CROSS")


def test_median_and_mode_without_and_with_groups(spark, people):
    spec = {"from": "p", "columns": [{"column": "team"}, {"aggregate": "MEDIAN", "column": "age", "alias": "m"}, {"aggregate": "MODE", "column": "age", "alias": "o"}], "group_by": ["team"]}
    got = {r["team"]: (r["m"], r["o"]) for r in run_spec(spark, spec, {"p": people}).collect()}
    assert got == {"A": (40.0, 30.0), "B": (20.0, 20.0), None: (40.0, 40.0)}
    spec = {"from": "p", "columns": [{"aggregate": "MEDIAN", "column": "age", "alias": "m"}, {"aggregate": "MODE", "column": "team", "alias": "o"}]}
    assert tuple(run_spec(spark, spec, {"p": people}).first()) == (35.0, "A")


def test_relative_dates_use_the_given_day(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 5, 1) + dt.timedelta(days=i)) for i in range(31)], "id int, t timestamp")
    spec = {"from": "d", "columns": [{"column": "id"}], "where": [{"column": "t", "op": "THIS WEEK"}]}
    assert ids(run_spec(spark, spec, {"d": df}, as_of=dt.date(2024, 5, 30))) == [26, 27, 28, 29, 30]


def test_semi_join_does_not_multiply(spark, people):
    right = spark.createDataFrame([("A",), ("A",)], "team string")
    assert ids(join_tables(people, right, "SEMI", [("team", "team")])) == [1, 3]
    assert ids(join_tables(people, right, "ANTI", [("team", "team")])) == [2, 4, 5]


def test_full_join_keeps_one_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    got = sorted(tuple(r) for r in join_tables(a, b, "FULL", [("k", "k")]).select("k", F.coalesce("v_left", F.lit("")), F.coalesce("v_right", F.lit(""))).collect())
    assert got == [(1, "x", ""), (2, "y", "z"), (3, "", "w")]


def test_join_of_few_keys_is_dealt_by_its_result(spark, monkeypatch):
    """Two keys with many pairs: the same pairs as any join, in more tasks than there are keys; nulls join nothing."""
    from lodeframe.plans import spec

    monkeypatch.setattr(spec, "JOINED_ROWS", 2000, raising=False)
    a = spark.createDataFrame([(i % 2 if i % 9 else None, i // 2, "same") for i in range(300)], "k int, v int, w string")
    b = spark.createDataFrame([(i % 2, i) for i in range(200)], "k int, v int")
    for left, right in ((a, b), (b, a)):
        got = join_tables(left, right, "INNER", [("k", "k")])
        plain = left.alias("x").join(right.alias("y"), F.col("x.k") == F.col("y.k")).select("x.k", F.col("x.v").alias("v_left"), F.col("y.v").alias("v_right"))
        assert sorted(got.select("k", "v_left", "v_right").collect()) == sorted(plain.collect())
        assert got.columns == ["k"] + [{"v": f"v_{side}"}.get(c, c) for side, df in (("left", left), ("right", right)) for c in df.columns if c != "k"]
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 4 and max(parts) < sum(parts) / 3


def test_text_facts_equal_plain_patterns(spark):
    """Counts that pass texts by, or are made outside the patterns, are those of the patterns; nulls count nothing."""
    from lodeframe.functions import words

    texts = ["a b\x0bc d é ü 中文 かな 한국 привет", None, "", "   ", "call 555-123-4567 or (555) 123 4567", "a@b.com.x@y.org me@x.de", "<b>x</b> [l](u)", "# h\n## k", "Jan 5, 2020 1/2/2020", "$ 5 €7,000 £3.5 ₹1", "123-45-6789 1234 5678-9012 3456 10.0.0.1 12345-6789", "John Smith 𝒳 ſ ÀÿĀɏ"] * 3
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    counts = columns._letters_and_tokens("t")
    assert df.where(~F.coalesce((counts["letters"] == F.regexp_count("t", F.lit("[a-zA-Z]"))) & (counts["tokens"] == F.regexp_count("t", F.lit(r"\S+"))), F.col("t").isNull())).count() == 0
    f = columns.text_facts(df, ["t"])["t"]
    plain = lambda p: df.where(F.col("t").rlike(p)).count()
    assert f["personal"] == {k: plain(p) for k, p in words.PERSONAL.items()} and all(f["personal"].values())
    for kind, p in {**words.PERSONAL, **words.MARKUP, **{k: p for k, (p, _) in words.ENTITIES.items()}}.items():
        needed = words.NEEDED.get(kind, p)
        assert plain(p) and df.where(F.col("t").rlike(p) & ~F.col("t").rlike(needed)).count() == 0
    assert f["entities"] == [k for k, (p, least) in words.ENTITIES.items() if df.agg(F.sum(F.regexp_count("t", F.lit(p)))).first()[0] > least]


@pytest.mark.parametrize("function", ["RANK", "DENSE_RANK", "SUM", "COUNT", "AVG", "NTILE", "LEAD"])
def test_split_windows_equal_plain_ones(spark, function):
    df = spark.createDataFrame([(i, i % 3, None if i % 7 == 0 else float(i // 4), float(i)) for i in range(120)], "id int, g int, o double, v double")
    order = ["o"] if function in ("RANK", "DENSE_RANK", "SUM", "COUNT", "AVG") else ["id"]
    window = {"func": function, "column": "v", "partition_by": ["g"], "order_by": order}
    plain = {r["id"]: r["w"] for r in add_window(df, window, "w").collect()}
    split = {r["id"]: r["w"] for r in add_window(df, window, "w", group_rows=0).collect()}
    assert plain == split


def test_frames():
    assert frame_bounds("ROWS BETWEEN 6 PRECEDING AND CURRENT ROW") == ("ROWS", -6, 0)


def test_safe_names():
    assert [safe_name(n) for n in ("my file.csv", "2024 sales.xlsx", "select", "!!!")] == ["my_file", "sales", "tbl_select", "table"]


def test_workspace(spark, people):
    w = Workspace(spark)
    assert w.register(people, "my people.csv") == "my_people"
    assert w.register(people, "my people.csv").startswith("my_people_")
    assert w.tables().count() == 2
    with pytest.raises(ReadOnlyError):
        run_sql(spark, "drop table my_people")
    with pytest.raises(ReadOnlyError):
        run_template(spark, "SELECT 1; DROP TABLE x", {})
    assert w.create_view("elders", "SELECT * FROM my_people WHERE age > 30") == "elders"
    assert [r["name"] for r in w.views().collect()] == ["elders"]
    assert w.drop_view("elders") and w.views().count() == 0
    a = w.run_cached("SELECT count(*) AS n FROM my_people")
    assert a is w.run_cached("SELECT count(*) AS n FROM my_people") and w.clear_cache() == 1
    assert w.unregister("my_people")


def test_template_values_are_bound_not_pasted(spark, people):
    people.createOrReplaceTempView("people_t")
    got = run_template(spark, "SELECT id FROM people_t WHERE name = '{{who}}'", {"who": "x' OR '1'='1"})
    assert got.count() == 0


def test_column_info_and_roles(people):
    info = {r["column"]: r for r in column_info(people).collect()}
    assert info["age"]["null_count"] == 1 and info["team"]["ui_type"] == "categorical"
    found = templates.suggest_templates([r.asDict() for r in info.values()])
    assert ("null_counts", {}) in found and any(n == "value_range" for n, _ in found)


def test_keys(spark, people):
    assert [r["columns"] for r in keys.primary_keys(people).collect()] == ["id"]
    assert keys.join_cardinality(people, people, "id", "id").first()["relationship"] == "1:1"
    assert keys.join_cardinality(people, people, "team", "team").first()["relationship"] == "N:M"


def test_schemas_and_merge(spark, people):
    other = people.drop("age").withColumn("id", F.col("id").cast("string"))
    assert setops.compare_schemas({"a": people.schema, "b": other.schema})["type_clashes"] == ["id"]
    merged = setops.merge_tables({"a": people, "b": other})
    assert merged.count() == 10 and merged.where("age is null and __source_file__ = 'b'").count() == 5


def test_empty_tables_do_no_harm(spark):
    empty = spark.createDataFrame([], "id int, name string, x double, t timestamp")
    assert templates.null_counts(empty).first()["total_rows"] == 0
    assert templates.histogram(empty, "x").count() == 0
    assert templates.zscore_outliers(empty, "x").count() == 0
    assert basic.impute(empty, ["x"], "median").count() == 0
    assert basic.ffill(empty, ["x"], "t", "id").count() == 0
    assert columns.column_profile(empty).count() == 0
    assert columns.datetime_profile(empty, "t").first()["n"] == 0
    assert structure.duplicate_columns(empty).count() == 0
    assert semantics.semantic_types(empty).where("semantic_type = 'unknown'").count() == 4
    assert quality_facts(empty)["grade"] == "F"


def test_currency_by_hand(spark):
    texts = ["$1,200.50", "(1,200)", "-£3", "12%", "1.5K", "2M", "abc", None, "€ 7"]
    got = [r["p"] for r in types.parse_currency(spark.createDataFrame([(t,) for t in texts], "p string"), ["p"]).collect()]
    assert got == [1200.5, -1200.0, -3.0, 0.12, 1500.0, 2000000.0, None, None, 7.0]


def test_booleans_stay_text_when_strange_words_remain(spark):
    df = spark.createDataFrame([("Yes",), ("no",), ("maybe",), (None,)], "b string")
    assert [r["b"] for r in types.standardize_booleans(df, ["b"]).collect()] == ["true", "false", "maybe", None]


def test_json_columns_grow_by_all_fields(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"d": [1, 2]}'), (3, None), (4, "no json")], "id int, j string")
    got = types.expand_json(df, ["j"])
    assert set(got.columns) == {"id", "j_a", "j_b.c", "j_d"}
    assert got.where("id = 1").first()["j_b.c"] == "x"


def test_normalised_text(spark):
    df = spark.createDataFrame([("  Don't <b>stop</b> &amp; see [this](http://x.y/z)  **now** \U0001f600 http://a.b ",)], "t string")
    assert text.normalize_text(df, ["t"], "full").first()["t"] == "do not stop & see this now"


def test_tfidf_by_hand(spark):
    import math

    df = spark.createDataFrame([(1, "red apple"), (2, "red pear"), (3, "green pear pear")], "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in text.tfidf_weights(df, "t", "id", ngram_range=(1, 1)).collect()}
    assert set(t for _, t in got) == {"red", "pear"}
    assert got[(1, "red")] == pytest.approx(1.0) and got[(2, "red")] == pytest.approx(1 / math.sqrt(2))


@pytest.mark.parametrize("listed", [1000, 12])
def test_tfidf_of_word_pairs_needs_few_pairs(spark, monkeypatch, listed):
    """The vocabulary is that of counting every word and pair, also where more words tie than a condition lists."""
    import random
    from collections import Counter

    monkeypatch.setattr(text, "LISTED", listed, raising=False)
    rng = random.Random(3)
    texts = [[f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(rng.randint(0, 25))] for _ in range(60)]
    grams = [ws + [" ".join(p) for p in zip(ws, ws[1:])] for ws in texts]
    tf, df = Counter(g for gs in grams for g in gs), Counter(g for gs in grams for g in set(gs))
    want = sorted((t for t in tf if 2 <= df[t] <= 0.4 * len(texts)), key=lambda t: (-tf[t], t))[:10]
    table = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "id int, t string")
    words = text._words(table, F.col("t"), "id", [])
    fits = lambda n: (n >= 2) & (n <= 0.4 * len(texts))
    assert [(r["term"], r["tf"], r["df"]) for r in text._vocabulary(words, (1, 2), 10, fits)] == [(t, tf[t], df[t]) for t in want]
    assert {r["term"] for r in text.tfidf_weights(table, "t", "id", 10, max_df=0.4, stops=[]).collect()} == set(want)


def test_balance_is_stable_and_whole(spark):
    df = spark.range(100).select("id", (F.col("id") < 83).cast("int").alias("y"), F.rand(1).alias("x"))
    over = balance.oversample(df, "y", "id").groupBy("y").agg(F.count("*").alias("n"), F.count_distinct("id").alias("u")).collect()
    assert sorted((r["y"], r["n"], r["u"]) for r in over) == [(0, 83, 17), (1, 83, 83)]
    a, b = ids(balance.undersample(df, "y", "id")), ids(balance.undersample(df.repartition(7), "y", "id"))
    assert a == b and len(a) == 34


def test_smote_points_lie_between_neighbours(spark):
    rows = [(i, 0, float(i), 0.0) for i in range(20)] + [(100 + i, 1, float(10 * i), 5.0) for i in range(4)]
    made = balance.smote(spark.createDataFrame(rows, "id int, y int, a double, b double"), "y", "id").where("_new")
    got = made.collect()
    assert len(got) == 16 and all(r["y"] == 1 and 0 <= r["a"] <= 30 and r["b"] == 5.0 and r["id"] is None for r in got)


def test_knn_imputation_with_holes_in_other_columns(spark):
    rows = [(1, 1.0, 1.0, 10.0), (2, 1.1, None, 12.0), (3, 5.0, 5.0, 50.0), (4, 1.0, 1.0, None), (5, 5.1, 5.0, 52.0)]
    got = balance.impute_knn(spark.createDataFrame(rows, "id int, a double, b double, c double"), ["c"], "id", 2).where("id = 4").first()["c"]
    assert got == pytest.approx(11.0)


def test_kfold_target_encoding_never_sees_its_own_fold(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "b", 1.0)], "id int, c string, y double")
    got = {r["id"]: r["c"] for r in encode.target_encode(df, ["c"], "y", "kfold", "id").collect()}
    assert got == {1: 5.5, 2: 5.5}


def test_recipes(spark, people):
    steps = [{"action": "impute_mean", "column": "years"}, {"action": "drop_rows", "column": "name"}]
    got = recipe.apply_recipe(people, steps, {"years": "age"})
    assert got.count() == 4 and got.where("age is null").count() == 0
    with pytest.raises(ValueError):
        recipe.apply_step(people, {"action": "adasyn", "column": "age"})


def test_long_recipes_are_cut(spark, people):
    steps = [{"action": "standardize_whitespace", "column": "name"}] * 21
    assert recipe.apply_recipe(people, steps).count() == 5


def test_table_diff_and_repairs(spark, people):
    fixed = recipe.apply_repairs(people, spark.createDataFrame([(2, "age", "33")], "key int, column string, value string"), "id")
    got = {(r["column"], r["change"]): r["n"] for r in recipe.table_diff(people, fixed, "id").collect()}
    assert got[("age", "values_changed")] == 1 and got[("age", "nulls_before")] == 1 and got[("age", "nulls_after")] == 0


def test_auto_clean_applies_only_the_definitive(spark):
    rows = [(i, "n/a" if i % 10 == 0 else str(i), 1, " pad " if i % 2 else "pad") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x string, one int, p string")
    plan = cleaning_plan(df, "id")
    steps = steps_from_plan(plan)
    assert {s["action"] for s in steps} >= {"replace_pseudo_nulls", "drop_zero_variance", "standardize_whitespace"}
    got = auto_clean(df)
    assert "one" not in got.columns and got.where("x is null").count() == 6 and got.select("p").distinct().count() == 1


def test_profile_parts_fail_alone(spark):
    frames, warnings = whole.profile_frames(spark.createDataFrame([(1,)], "a int"))
    assert "table" in frames and "columns" in frames


def test_quality_of_a_table_with_rows_has_a_grade(spark):
    whole = spark.range(50).selectExpr("id as k_id", "'a' as v")
    empty = whole.selectExpr("k_id", "CAST(NULL AS STRING) AS v", "CAST(NULL AS STRING) AS w", "CAST(NULL AS STRING) AS u")
    got, worse = quality_score(whole).first(), quality_score(empty).first()
    assert (got["completeness"], got["uniqueness"], got["grade"]) == (100.0, 100.0, "A")
    assert worse["completeness"] == 25.0 and worse["grade"] == "C"  # 0.35 * 25 + 65 of the others


def test_imbalance(spark):
    df = spark.range(110).select((F.col("id") < 100).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    assert features.imbalance_facts(df)["severity"] == "moderate" and features.imbalance_facts(df)["strategy"] == "smote"


def test_delimited_report_and_strict(spark, folder):
    lines = ["a,b,c", "1,2,3", "4,5", '6,"x,y",7', "8,9,10,11,12,13,14"]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(folder)
    report = readers.malformed_rows(spark, folder)
    assert [(r["row_number"], r["issue"], r["severity"]) for r in report.collect()] == [(3, "1 missing", "warning"), (5, "4 extra", "error")]
    assert readers.read_delimited(spark, folder, ",", strict=True).count() == 2
    assert readers.drop_malformed(readers.read_numbered(spark, folder), report).count() == 3
    assert readers.read_delimited(spark, folder).count() == 4


def test_empty_fields_stay_empty_text(spark, folder):
    spark.createDataFrame([("a,b",), ("1,",), (',"q"',)], "value string").coalesce(1).write.text(folder)
    df = readers.read_delimited(spark, folder, ",")
    assert sorted(tuple(r) for r in df.collect()) == [("", "q"), ("1", "")]
    assert [f.dataType.simpleString() for f in readers.infer_types(df).schema] == ["bigint", "string"]


def test_sql_dump_short_and_long_rows(spark, folder):
    script = "CREATE TABLE t (a INT, b VARCHAR(10), PRIMARY KEY (a));\nINSERT INTO t VALUES (1, 'it''s; (ok)'),(2),(3, 'x', 9);\nINSERT INTO u VALUES (5);\n"
    spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(folder)
    got = sorted(tuple(r) for r in readers.read_sql_dump(spark, folder, "t").collect())
    assert got == [("1", "it's; (ok)"), ("2", None), ("3", "x")]


def test_writers_refuse_unknown_formats(people, folder):
    with pytest.raises(ValueError):
        writers.write(people, folder, "docx")


def test_ranks_of_whole_numbers_beyond_doubles_do_not_depend_on_the_plan(spark):
    from lodeframe.plans.windows import add_window

    base = 2**53
    df = spark.createDataFrame([(i, base + i % 40, i % 3) for i in range(200)] + [(200, None, 0)], "k long, v long, g long")
    for function in ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "SUM"):
        for direction in ("ASC", "DESC"):
            for keys in ([], ["g"]):
                window = {"func": function, "column": "k", "order_by": [{"column": "v", "direction": direction}], "partition_by": keys}
                whole, split = (sorted(map(tuple, add_window(df, window, "w", n).collect()), key=repr) for n in (10**9, 1))
                assert whole == split, (function, direction, keys)


def test_values_beyond_any_list_still_meet(spark):
    from lodeframe.operators.detect import consistency, structure

    names = [f"{i * 7919 % 10007:05d}-{i * 104729 % 99991:05d}" for i in range(1300)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(5000, names[3] + "x"), (5001, names[3].replace("-", "_"))], "k long, n string")
    near = {(r["a"], r["b"]) for r in structure.near_pairs(df, "n", 0.98).collect()}
    assert (names[3], names[3] + "x") in near
    assert links.near_links(df.selectExpr("n as v"), 0.98, spanning=True).count() <= len(near)
    doubled = df.where("k < 5000").union(df.where("k < 5000")).union(df.where("k = 5000"))
    assert [(r["current"], r["suggested"]) for r in consistency.repair_typos(doubled, "n", "k").collect()] == [(names[3] + "x", names[3])]


def test_quoted_fields_and_statements(spark, folder):
    from lodeframe.sources import readers as R

    lines = ["a,b", '1,"two', 'lines"', '2,"a ""x, y"" b"', "3,plain", '4,"x",y', "5"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{folder}/csv")
    want = {("1", "two\nlines"), ("2", 'a "x, y" b'), ("3", "plain")}
    assert want <= {tuple(r) for r in R.read_delimited(spark, f"{folder}/csv", ",", multiline=True).collect()}
    assert {tuple(r) for r in R.read_delimited(spark, f"{folder}/csv", ",", strict=True, multiline=True).collect()} == want
    report = R.malformed_rows(spark, f"{folder}/csv", multiline=True).collect()
    assert {(r["row_number"], r["issue"]) for r in report} == {(6, "1 extra"), (7, "1 missing")}
    script = "CREATE TABLE t (a INT, b TEXT);\nINSERT INTO t VALUES (1,'x;\ny'),(2,'z''s');\nINSERT INTO t VALUES (3,NULL);\n"
    spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(f"{folder}/sql")
    assert {tuple(r) for r in R.read_sql_dump(spark, f"{folder}/sql", "t").collect()} == {("1", "x;\ny"), ("2", "z's"), ("3", None)}


def test_accents_are_no_traces_of_a_wrong_encoding(spark):
    from lodeframe.sources.readers import structural_issues

    assert structural_issues(spark.createDataFrame([("café",), ("für",)], "t string")).count() == 0
    assert structural_issues(spark.createDataFrame([("cafÃ©",)], "t string")).first()["issue"].startswith("encoding")
    assert structural_issues(spark.createDataFrame([("SÃO PAULO Â",)], "t string")).count() == 0


def test_a_key_is_found_whatever_a_sketch_says(spark, monkeypatch):
    """Also where no class of rows shows a duplicate, and where the only duplicate lies outside the first class."""
    df = spark.range(3000).select("id", (F.col("id") % 2999).alias("nearly"), (F.col("id") % 60).alias("a"), F.floor(F.col("id") / 60).alias("b"))
    monkeypatch.setattr(F, "approx_count_distinct", lambda c: F.lit(1))
    assert [r["columns"] for r in keys.primary_keys(df.drop("a", "b")).collect()] == ["id"]
    assert [r["columns"] for r in keys.primary_keys(df.select("a", "b")).collect()] == ["a, b"]
    assert keys.unique_sets(df, [("id",), ("nearly",), ("a", "b"), ("a",)]) == [("id",), ("a", "b")]


def test_purity_of_numbers_counts_values_that_repeat(spark):
    from lodeframe.operators.detect import leaks

    df = spark.range(600).select(F.floor(F.col("id") / 3).cast("double").alias("thirds"), F.col("id").cast("double").alias("once"), F.concat(F.lit("t"), F.floor(F.col("id") / 3) % 7).alias("y"))
    assert [(r["column"], r["kind"]) for r in leaks.perfect_predictors(df, "y").collect()] == [("thirds", "purity")]


def test_cross_joins_up_to_a_given_size(spark):
    from lodeframe.plans.spec import SpecError, run_spec

    tables = {"a": spark.range(40), "b": spark.range(30).withColumnRenamed("id", "k")}
    spec = lambda most: {"from": "a", "joins": [{"type": "CROSS", "table": "b", "max_rows": most}]}
    assert run_spec(spark, spec(1200), tables).count() == 1200
    with pytest.raises(SpecError):
        run_spec(spark, spec(1199), tables)


@pytest.mark.parametrize("least", [0.5, 0.85])
def test_near_in_block_equals_loop(least):
    import random

    rng = random.Random(5)
    values = {"".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for alphabet, most in (("0123456789abcdef", 10), ("ab", 7), ("abcdefghijklmnopqrstuvwxyz\u00e9 \U0001f600", 30), ("ab", 80)) for _ in range(40)}
    values = sorted(values, key=lambda v: rng.random())
    for x, y in ((0, 0), (0, 1)):
        mine = [rng.randint(x, y) for _ in values]
        want = {}
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (mine[i], mine[j]) == (x, y) and (x != y or i < j):
                    low, high = sorted((a, b))
                    s = jaro_winkler(low, high)
                    if 0 < s < 1 and s >= least:
                        want[low, high] = s
        got = {(a, b): s for a, b, s in links.near_in_block(x, y, mine, values, least)}
        assert got == want
        some = [(a, b) for a, b, _ in links.near_in_block(x, y, mine, values, least, spanning=True)]
        assert set(some) <= set(want) and clusters_of(some) == clusters_of(list(want))
        assert len(some) == len(clusters_of(some)) - len(set(clusters_of(some).values()))  # a forest


def test_blocks_grow_with_the_values():
    for n in (0, 1, 999, 15_000, 900_000):
        assert -(-n // links.side_of(n)) <= 65  # blocks of 1000: 900 of 900 000 values
    assert links.side_of(10**9) == links.LARGEST


@pytest.mark.parametrize("least", [0.75, 0.85, 0.95])
def test_values_that_meet_by_choices_of_letters_are_all_near_ones(least, monkeypatch):
    import random

    monkeypatch.setattr(links, "WORTH", 0)
    rng = random.Random(int(least * 100))
    values = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for alphabet, most in (("0123456789abcdef", 9), ("abc", 6), ("abcdefghé\U0001f600", 12)) for _ in range(90)} | {str(n) for n in range(0, 9000, 83)})
    rng.shuffle(values)
    values += ["".join(rng.sample(v, len(v))) for v in values[:60]]
    values = sorted(set(values), key=lambda v: rng.random())
    for x, y in ((0, 0), (0, 1)):
        mine = [rng.randint(x, y) for _ in values]
        want = {}
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (mine[i], mine[j]) == (x, y) and (x != y or i < j):
                    low, high = sorted((a, b))
                    s = jaro_winkler(low, high)
                    if 0 < s < 1 and s >= least:
                        want[low, high] = s
        found = list(links.near_in_block(x, y, mine, values, least))
        assert len(found) == len(want) and {(a, b): s for a, b, s in found} == want
        some = [(a, b) for a, b, _ in links.near_in_block(x, y, mine, values, least, spanning=True)]
        assert set(some) <= set(want) and clusters_of(some) == clusters_of(list(want))
        known, rest = some[::2], [(a, b) for a, b, _ in links.near_in_block(x, y, mine, values, least, spanning=True, linked=some[::2])]
        assert clusters_of(known + rest) == clusters_of(list(want)) and len(known) + len(rest) == len(some)


def test_links_between_blocks_leave_out_what_is_linked_inside(spark, monkeypatch):
    """Numbers are near-equal to most others; each two blocks used to have a forest of their own."""
    monkeypatch.setattr(links, "SIDE", 60)
    values = [str(n) for n in range(1000, 1600)]
    found = links.near_links(spark.createDataFrame([(v,) for v in values], "v string"), 0.85, spanning=True).collect()
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if jaro_winkler(a, b) >= 0.85}
    assert {(r.a, r.b) for r in found} <= want and clusters_of([(r.a, r.b) for r in found]) == clusters_of(list(want))
    assert len(found) < 2 * len(values)


def test_components_of_a_long_way_take_few_rounds(spark, monkeypatch):
    import random

    rounds, cut = [], links.cut
    monkeypatch.setattr(links, "cut", lambda df: rounds.append(1) or cut(df))
    ids = random.Random(3).sample(range(200), 200)
    found = links.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert sorted(r.node for r in found) == list(range(200)) and {r.comp for r in found} == {0}
    assert len(rounds) < 16
