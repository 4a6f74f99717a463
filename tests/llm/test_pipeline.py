import re

import pytest
from conftest import plain

pytest.importorskip("public_tokenizers")

import corpus_pipeline as c  # noqa: E402

from lodeframe.llm import bbit_minhash, suffix_quality  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, docs):
    import uuid

    from lodeframe.session import shared_dir

    folder = f"{shared_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect_and_keep_the_columns(spark, docs, empty, tables):
    assert [n for n, _ in c.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    now = docs
    for name, stage in c.STAGES[:-1]:
        new = stage(spark, now, tables)
        assert new.columns == docs.columns and stage(spark, empty, tables).count() == 0
        now = new.checkpoint()
    good = suffix_quality.drop_repetitive(docs).checkpoint()
    stay = bbit_minhash.drop_near_copies(good)
    assert plain(now, "doc_id") == plain(stay, "doc_id")
    assert not any(re.search("token = ", r.text) for r in now.collect())


def test_run_packs_what_is_left(spark, tables):
    found = c.run(spark, tables).collect()
    assert found and sorted({r.sequence_id for r in found}) == list(range(max(r.sequence_id for r in found) + 1))
    assert all(r.doc_id is None or r.doc_id < 900 for r in found)
