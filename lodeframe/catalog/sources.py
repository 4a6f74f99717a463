"""Sources and sinks: the supplied tables written in each format to a new folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodeframe.catalog.base import Catalog
from lodeframe.session import shared_dir
from lodeframe.sources import readers as R
from lodeframe.sources import writers as W
from lodeframe.sources.inventory import file_inventory
from lodeframe.sources.nested import explode_main_array, flatten
from lodeframe.streaming.monitor import check_once, monitor, read_history


def place(t) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(t.spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def _csv(t, df, **options) -> str:
    path = place(t)
    df.write.option("header", True).options(**options).csv(path)
    return path


def _documents(t, record, frame) -> str:
    """JSON documents, each an array of the records of some neighbouring keys, one document per file."""
    path = place(t)
    chunk = F.floor(F.col("p_partkey") / 500)
    grouped = frame.select("p_partkey", record.alias("j")).groupBy(chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "j"))).alias("l"))
    text = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ",\n"), F.lit("]"))
    grouped.select("chunk", text.alias("value")).write.partitionBy("chunk").text(path)
    return path


def _lines(t, column) -> str:
    """Text lines with a header, in one file."""
    path = place(t)
    head = t.spark.createDataFrame([("key,name,price,note",)], "value string").coalesce(1)
    head.union(t.part.orderBy("p_partkey").select(column.alias("value")).coalesce(1)).coalesce(1).write.text(path)
    return path


def _faulty():
    key = F.col("p_partkey").cast("string")
    base = F.concat_ws(",", key, F.concat(F.lit('"'), "p_name", F.lit(', "')), F.col("p_retailprice").cast("string"), F.lit("x"))
    return F.when(F.col("p_partkey") % 50 == 3, F.concat(base, F.lit(",y"))).when(F.col("p_partkey") % 50 == 7, F.concat(base, F.lit(",1,2,3"))).otherwise(base)


def register(c: Catalog) -> None:
    plain = "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part"
    some = lambda t: t.part.select("p_partkey", "p_name", F.expr("CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END").alias("size"))
    c.add("s1_delimited", lambda t: R.read_delimited(t.spark, _csv(t, some(t))), plain)
    c.add("s1_tab_separated", lambda t: R.read_delimited(t.spark, _csv(t, some(t), sep="\t")), plain)
    c.add("s2_many_files", lambda t: R.read_delimited(t.spark, _csv(t, t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").repartition(8)), ","),
          "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag FROM lineitem")
    c.add("s3_infer_types", lambda t: R.infer_types(R.read_delimited(t.spark, _csv(t, t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))), ",")).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
          "SELECT * FROM orders")
    c.add("s4_malformed_rows", lambda t: R.malformed_rows(t.spark, _lines(t, _faulty()), ",").select("row_number", "issue", "severity"),
          "SELECT p_partkey + 2 AS row_number, CASE WHEN p_partkey % 50 = 3 THEN '1 extra' ELSE '3 extra' END AS issue, CASE WHEN p_partkey % 50 = 3 THEN 'warning' ELSE 'error' END AS severity FROM part WHERE p_partkey % 50 IN (3, 7)")
    c.add("s5_strict", lambda t: R.read_delimited(t.spark, _lines(t, _faulty()), ",", strict=True).select("key", "name"),
          "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || ', ' AS name FROM part WHERE p_partkey % 50 NOT IN (3, 7)")

    def quoted(t):
        """All documents with their text as a field: commas, doubled quotes and line breaks inside."""
        path = place(t)
        fields = t.documents.select("doc_id", F.concat(F.lit('"a", '), "text", F.lit(',\n""')).alias("text"), "lang")
        fields.hint("rebalance").write.options(header=True, quoteAll=True, **W.CSV_TEXT).csv(path)
        return path

    texts = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, '"a", ' || text || ',' || chr(10) || '""' AS text, lang FROM documents"""
    c.add("s1_quoted_texts", lambda t: R.read_delimited(t.spark, quoted(t), ",", multiline=True), texts)
    c.add("s5_strict_quoted", lambda t: R.read_delimited(t.spark, quoted(t), ",", strict=True, multiline=True), texts)
    c.add("s4_malformed_quoted", lambda t: R.malformed_rows(t.spark, quoted(t), ",", multiline=True).select("issue"), "SELECT '' AS issue FROM documents WHERE FALSE")

    # Quotes that never end: each is reported where it stands, and the lines after it are read as they are.
    def stray():
        return F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.col("p_retailprice").cast("string"), F.expr("CASE WHEN p_partkey % 50 = 3 THEN '\"x' ELSE 'x' END"))

    c.add("s4_unclosed_quotes", lambda t: R.malformed_rows(t.spark, _lines(t, stray()), ",", multiline=True).select("row_number", "issue", "severity"),
          "SELECT p_partkey + 2 AS row_number, 'unclosed quote' AS issue, 'error' AS severity FROM part WHERE p_partkey % 50 = 3")
    c.add("s5_strict_unclosed", lambda t: R.read_delimited(t.spark, _lines(t, stray()), ",", strict=True, multiline=True).select("key", "name"),
          "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part WHERE p_partkey % 50 <> 3")

    def cleaned(t):
        path = _lines(t, _faulty())
        return R.drop_malformed(R.read_numbered(t.spark, path), R.malformed_rows(t.spark, path)).select("row_number", "key", "note")

    c.add("s6_drop_malformed", cleaned, "SELECT p_partkey + 2 AS row_number, CAST(p_partkey AS VARCHAR) AS key, 'x' AS note FROM part WHERE p_partkey % 50 <> 7")

    c.add("s7_json_array", lambda t: R.read_json(t.spark, _documents(t, F.to_json(F.struct("p_partkey", "p_name", "p_size")), t.part)).drop("chunk"), "SELECT p_partkey, p_name, p_size FROM part")
    c.add("s7_json_values", lambda t: R.read_json(t.spark, _documents(t, F.concat(F.lit('"'), "p_name", F.lit('"')), t.part)), "SELECT p_name AS value FROM part")

    def one_document(t):
        path = place(t)
        texts = t.documents.select(F.concat(F.lit(","), F.to_json(F.struct("doc_id", "text"))).alias("value"))
        W.write_one_text(texts, path, '[{"doc_id":-1}', "]")
        return R.read_json(t.spark, path).where("doc_id >= 0")

    c.add("s7_json_one_document", one_document, "SELECT doc_id, text FROM documents")

    def jsonl(t):
        path = place(t)
        t.part.select(F.when(F.col("p_partkey") % 9 == 0, F.lit('{"broken')).otherwise(F.to_json(F.struct("p_partkey", "p_name"))).alias("value")).write.text(path)
        return R.read_jsonl(t.spark, path)

    c.add("s8_json_lines", lambda t: jsonl(t)[0], "SELECT p_partkey, p_name FROM part WHERE p_partkey % 9 <> 0")
    c.add("s8_json_lines_bad", lambda t: jsonl(t)[1].groupBy("value").agg(F.count(F.lit(1)).alias("n")), "SELECT '{\"broken' AS value, count(*) AS n FROM part WHERE p_partkey % 9 = 0")
    nested = lambda t: t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.struct("o_custkey", F.struct("o_orderstatus").alias("s")).alias("c")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("l")).select("o_orderkey", "c", "l", F.array("o_orderkey").alias("k"))
    item = "(SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r = {0})"
    c.add("s9_flatten", lambda t: flatten(nested(t)).select("o_orderkey", "`c.o_custkey`", "`c.s.o_orderstatus`", "`l[0].l_partkey`", "`l[1].l_partkey`", "k"),
          f"SELECT o_orderkey, o_custkey AS \"c.o_custkey\", o_orderstatus AS \"c.s.o_orderstatus\", a.l_partkey AS \"l[0].l_partkey\", b.l_partkey AS \"l[1].l_partkey\", '[' || o_orderkey || ']' AS k FROM orders JOIN {item.format(1)} a ON a.l_orderkey = o_orderkey LEFT JOIN {item.format(2)} b ON b.l_orderkey = o_orderkey")
    c.add("s10_main_array", lambda t: explode_main_array(nested(t).select("l", F.array(F.struct("o_orderkey")).alias("short"))),
          "SELECT l_linenumber, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    c.add("s11_parquet", lambda t: R.read_parquet(t.spark, f"{t.folder}/customer.parquet"), "SELECT * FROM customer")

    def feather(t):
        path = place(t)
        W.write_feather(t.part.repartition(3), path)
        return path

    c.add("s12_feather_source", lambda t: R.read_feather(t.spark, feather(t)), "SELECT * FROM part")
    c.add("s23_feather_sink", lambda t: W.write_feather(t.part.repartition(3), place(t)).agg(F.sum("rows").alias("rows"), F.count("file").alias("files")), "SELECT count(*) AS rows, 3 AS files FROM part")

    def xml(t):
        path = place(t)
        row = F.concat(F.lit('<part id="'), F.col("p_partkey").cast("string"), F.lit('"><name>'), "p_name", F.lit("</name><size>"), F.col("p_size").cast("string"), F.lit("</size></part>"))
        line = lambda text: t.spark.createDataFrame([(text,)], "value string").coalesce(1)
        line("<parts>").union(t.part.select(row.alias("value")).coalesce(1)).union(line("</parts>")).coalesce(1).write.text(path)
        return R.read_xml(t.spark, path)

    c.add("s13_xml", xml, "SELECT p_partkey AS \"@id\", p_name AS name, p_size AS size FROM part")

    def script(t):
        path = place(t)
        df = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.concat(F.lit("O'"), "c_name", F.lit(" (x), y"))).alias("name"), "c_acctbal")
        W.write_sql_inserts(df, path, "people")
        return path

    c.add("s14_sql_dump", lambda t: R.read_sql_dump(t.spark, script(t), "people").select(F.col("c_custkey").cast("long").alias("c_custkey"), "name", F.col("c_acctbal").cast("double").alias("c_acctbal")),
          "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'O''' || c_name || ' (x), y' END AS name, c_acctbal FROM customer")
    def texts_script(t):
        path = place(t)
        W.write_sql_inserts(t.documents.select("doc_id", F.concat(F.lit("it's;\n"), "text", F.lit(" (x);\n")).alias("text")), path, "docs")
        return path

    c.add("s14_sql_dump_texts", lambda t: R.read_sql_dump(t.spark, texts_script(t), "docs").select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
          "SELECT doc_id, 'it''s;' || chr(10) || text || ' (x);' || chr(10) AS text FROM documents")
    def one_insert(t):
        path = place(t)
        texts = t.documents.select(F.concat(F.lit(",("), F.col("doc_id").cast("string"), F.lit(", "), F.coalesce(F.concat(F.lit("'"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")), F.lit(")")).alias("value"))
        W.write_one_text(texts, path, "INSERT INTO docs (doc_id, text) VALUES (-1, 'x')", ";")
        return R.read_sql_dump(t.spark, path, "docs").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id >= 0")

    c.add("s14_sql_dump_one_insert", one_insert, "SELECT doc_id, text FROM documents")
    c.add("s24_sql_sink", lambda t: t.spark.read.text(script(t)).where("value like 'INSERT%'").select(F.regexp_extract("value", r"VALUES \((\d+)", 1).cast("long").alias("c_custkey"), F.col("value").contains("NULL").alias("missing")),
          "SELECT c_custkey, c_custkey % 4 = 0 AS missing FROM customer")
    c.add("s15_gzip", lambda t: R.read_delimited(t.spark, _csv(t, some(t), compression="gzip")), plain)

    def zipped(t):
        import os
        import zipfile

        folder = place(t)
        os.makedirs(folder)

        def pack(part):
            """One archive per 500 keys, written where the task runs."""
            lines = [f"{a},{b}" for a, b in zip(part["c_name"], part["c_nationkey"])]
            with zipfile.ZipFile(f"{folder}/{part['chunk'].iloc[0]}.zip", "w") as z:
                z.writestr("people.csv", "\n".join(["c_name,c_nationkey", *lines]))
                z.writestr("notes.jsonl", "\n".join(f'{{"name": "{x.split(",")[0]}"}}' for x in lines))
            return part[["chunk"]].head(1)

        chunked = t.customer.select("c_name", "c_nationkey", F.floor(F.col("c_custkey") / 500).alias("chunk"))
        chunked.groupBy("chunk").applyInPandas(pack, "chunk long").write.format("noop").mode("overwrite").save()
        return R.read_zip_members(t.spark, folder)

    c.add("s16_zip_csv", lambda t: R.zip_table(zipped(t), "people.csv"), "SELECT c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
    c.add("s16_zip_jsonl", lambda t: R.zip_table(zipped(t), "notes.jsonl"), "SELECT c_name AS name FROM customer")

    def mixed(t):
        base = place(t)
        t.customer.coalesce(1).write.option("header", True).csv(f"{base}/a")
        t.customer.coalesce(1).write.json(f"{base}/b")
        t.customer.coalesce(1).write.parquet(f"{base}/c")
        t.customer.coalesce(1).write.option("compression", "gzip").csv(f"{base}/d")
        return file_inventory(t.spark, f"{base}/*/part-*")

    c.add("s17_file_inventory", lambda t: mixed(t).groupBy("format").agg(F.count(F.lit(1)).alias("files")),
          "SELECT * FROM (VALUES ('csv', 1), ('json', 1), ('parquet', 1), ('compressed', 1)) v(format, files) WHERE (SELECT count(*) > 0 FROM customer)")

    def encodings(t):
        base = place(t)
        names = t.customer.select(F.concat("c_name", F.lit(" é")).alias("value"))
        names.coalesce(1).write.text(f"{base}/plain")
        names.coalesce(1).write.option("encoding", "UTF-16").csv(f"{base}/wide")
        names.coalesce(1).write.option("encoding", "ISO-8859-1").csv(f"{base}/latin")
        return file_inventory(t.spark, f"{base}/*/part-*").select(F.regexp_extract("path", r"/(plain|wide|latin)/", 1).alias("kind"), "encoding")

    c.add("s18_encoding", encodings, "SELECT * FROM (VALUES ('plain', 'utf-8'), ('wide', 'utf-16-be'), ('latin', 'unknown')) v(kind, encoding) WHERE (SELECT count(*) > 0 FROM customer)")
    c.add("s19_detect_delimiter", lambda t: R.detect_delimiter(t.spark, _csv(t, t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), sep=";")).where("chosen").select("delimiter"), "SELECT ';' AS delimiter WHERE (SELECT count(*) > 0 FROM orders)")
    c.add("s20_structural_issues", lambda t: R.structural_issues(t.part.select("p_partkey", F.lit("").alias("blank"), F.expr("CASE WHEN p_partkey % 20 = 0 THEN p_size END").alias("few"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' Ã©') WHEN p_partkey % 3 = 1 THEN concat(p_name, ' SÃO Â') ELSE p_name END").alias("name"))),
          "SELECT 'blank' AS \"column\", 'empty' AS issue, count(*) AS count FROM part UNION ALL SELECT 'few', 'mostly_null', count(*) FILTER (p_partkey % 20 <> 0) FROM part UNION ALL SELECT 'name', 'encoding Ã', count(*) FILTER (p_partkey % 3 = 0) FROM part")

    def beside(t):
        path = _lines(t, _faulty())
        return R.malformed_comparison(t.spark, path, R.read_numbered(t.spark, path, strict=True)).select("row_number", F.col("key").isNull().alias("dropped"))

    c.add("s21_comparison", beside, "SELECT p_partkey + 2 AS row_number, p_partkey % 50 IN (3, 7) AS dropped FROM part")
    for fmt in ("csv", "json", "parquet"):
        def back(t, fmt=fmt):
            path = place(t)
            W.write(t.customer, path, fmt)
            if fmt == "csv":
                return R.infer_types(R.read_delimited(t.spark, path, ","))
            return t.spark.read.json(path) if fmt == "json" else R.read_parquet(t.spark, path)

        c.add(f"s22_{fmt}_sink", back, "SELECT * FROM customer")

    def exported(t):
        path = place(t)
        spec = {"from": "orders", "columns": [{"column": "o_orderpriority"}, {"aggregate": "COUNT", "column": "*", "alias": "n"}], "group_by": ["o_orderpriority"]}
        W.export_query(t.spark, spec, path, "parquet", t.all("orders"))
        return R.read_parquet(t.spark, path)

    c.add("s25_export_query", exported, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")

    def watched(t):
        base = place(t)
        good, bad = t.customer.drop("c_name"), t.customer.drop("c_name", "c_acctbal")
        good.coalesce(1).write.parquet(f"{base}/in/1")
        monitor(t.spark, f"{base}/in", good, f"{base}/history", f"{base}/state", availableNow=True).awaitTermination()
        bad.coalesce(1).write.parquet(f"{base}/in/2")
        monitor(t.spark, f"{base}/in", good, f"{base}/history", f"{base}/state", availableNow=True).awaitTermination()
        return read_history(t.spark, f"{base}/history").select("rows", "columns", "schema_changed", "status")

    c.add("i11_monitor", watched, "SELECT count(*) AS rows, 4 AS columns, FALSE AS schema_changed, 'ok' AS status FROM customer UNION ALL SELECT count(*), 3, TRUE, 'warning' FROM customer")
    c.add("i11_check_once", lambda t: check_once(t.customer, t.customer.select(*[F.expr(f"CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE {x} END").alias(x) for x in t.customer.columns])).select("rows", "schema_changed", "status"),
          "SELECT count(*) AS rows, FALSE AS schema_changed, 'warning' AS status FROM customer")
