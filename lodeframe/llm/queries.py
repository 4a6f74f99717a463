"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm import backoff_lm, bbit_minhash, concat_pack, cyk_repair, gru_toxicity, license_lines, link_trust, max_sketch, run_index, secret_owners, simhash, suffix_quality, tree_bpe
from lodeframe.llm.oracles import SQL


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_quality.assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = backoff_lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~F.coalesce(held_out, F.lit(False)))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _round_trip(ids: np.ndarray, counts: np.ndarray, model: tree_bpe.Model) -> dict:
    """Digests of each text's ids and of the text they decode to."""
    at = np.concatenate([[0], np.cumsum(counts)])
    each = [ids[a:b] for a, b in zip(at, at[1:])]
    return {"n_tokens": counts, "ids_sha256": [sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], "decoded_sha256": [sha256(model.decode(x).encode()).hexdigest() for x in each]}


def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return tree_bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe_file(), fields=fields, finish=_round_trip)


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=Fraction(85, 100))


def op6_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_pack.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe_file(), with_ids=False)


def op7_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner, its source and language the repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_owners.scan(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    loose = F.filter("live", lambda s: s.kind == 3)
    return found.select("doc_id", *(count(k).alias(f"n_{secret_owners.KINDS[k]}") for k in range(3)), F.sha2(secret_owners.text_of(F.col("base")), 256).alias("base_sha256"), secret_owners.text_of(F.array_sort(F.concat("base", loose))).alias("spans"), F.size("live").cast("long").alias("n_live"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digests: for each id divisible by 50, how many other documents have a fingerprint within the radius."""
    found = simhash.with_successors(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    asked = found.where("doc_id % 50 = 0")
    near = simhash.neighbours(found.select("high", "low"), asked)
    counted = asked.join(near, ["high", "low"], "left").withColumn("n_near", F.col("n_near") - 1).unionByName(found.where("not coalesce(doc_id % 50 = 0, false)"), allowMissingColumns=True)
    return counted.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), simhash.text_form(F.col("high"), F.col("low")).alias("fingerprint"), simhash.text_form(F.col("edited_high"), F.col("edited_low")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


def op9_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_lines.find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("line")


def op10_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = gru_toxicity.fit(docs, labels.where(~held_out))
    scored = gru_toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyk_repair.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_suffix_repetition, op2_link_trust, op3_backoff_automaton, op4_tree_bpe, op5_bbit_minhash, op6_concat_pack, op7_secret_owners, op8_simhash, op9_license_lines, op10_gru_toxicity, op11_cyk_repair, op12_run_index, op13_max_sketch)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
