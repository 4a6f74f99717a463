import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import words

from lodeframe.llm import max_sketch as m
from lodeframe.llm.texts import block_of


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, queries, k=10):
    """(query row, rank, id, score), a query at a time."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for _, b in bags for t in b)
    out = []
    for q, text in queries:
        found = []
        for (i, bag), size in zip(bags, sizes):
            score = 0
            for t, times in Counter(terms(text)).items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (25 + 75 * size * n // total)))
            if score:
                found.append((-score, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def queries_of(docs, seed=4):
    rng = random.Random(seed)
    texts = [t for _, t in docs if t and len(t) > 60]
    made = [rng.choice(texts)[a : a + rng.randint(20, 200)] for a in range(0, 60, 5)]
    return [*enumerate(made), (100, ""), (101, None), (102, "nowhere to be found zzz"), (103, made[0]), (104, "the the THE of, of"), (None, made[1])]


@pytest.mark.parametrize("width", [4, 64, 4096])
@pytest.mark.parametrize("block_bytes", [500, 1 << 20])
def test_equals_brute_force(spark, docs, monkeypatch, width, block_bytes):
    monkeypatch.setattr(m, "BLOCK_BYTES", block_bytes)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    queries = queries_of(rows)
    asked = spark.createDataFrame([(i, t, "d", 1) for i, t in queries], "item_id long, text string, id string, rank int")
    found = m.search(docs, asked, width=width)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, queries)


def test_batches_of_queries_and_few_results(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    queries = queries_of(rows)[:9]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    found = m.search(docs, asked, k=3, batch_bytes=300)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, queries, 3)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the stone")], "item_id long, text string")
    assert m.search(docs, none).count() == 0 and m.search(empty, some).count() == 0 and m.search(empty, none).count() == 0


def test_bounds_hold_and_spare_work():
    rng = random.Random(3)
    texts = [words(rng, 150) for _ in range(400)]
    batch = m.Batch([texts[7][:150], texts[300][40:240]])
    total = [batch.held(block_of(texts))]
    batch.weigh(total[0][0], total[0][1], total[0][2], m.WIDTH)
    documents, best = m.Documents(block_of(texts), batch), m.Best(2, 1)
    for q in range(2):
        assert (documents.bounds[:, q] >= documents.scores(q, np.arange(400))).all()
    scored = best.take(documents, list(range(400)))
    assert [x[0] for x in best.ids] == [7, 300] and scored <= 4 * m.STEP


def test_a_very_long_text(spark):
    rng = random.Random(5)
    rows = [(1, words(rng, 60_000)), (2, "lone needle " + words(rng, 5)), (3, "x")]
    asked = [(0, "needle lone"), (1, rows[0][1][5000:5200])]
    found = m.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, asked)
