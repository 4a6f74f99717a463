import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import backoff_lm as lm


def brute(rows, held, order, strength):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) + ["</s>"] for _, t in rows]
    grams = Counter()
    for w, out in zip(tokens, held):
        x = ["<s>", *w]
        if not out:
            grams.update(tuple(x[j : j + k]) for k in range(1, order + 1) for j in range(len(x) - k + 1))
    known = {g: c for g, c in grams.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(known.values()), len(known)

    def p(w, h):
        if not h:
            return (known.get((w,), 0) + 1) / (n + v + 1)
        low = p(w, h[1:])
        return (grams[(*h, w)] + strength * low) / (grams[h] + strength) if grams[h] else low

    for (i, _), w, out in zip(rows, tokens, held):
        x = ["<s>", *w]
        base = sum(math.log10((known.get((a,), 0) + 1) / (n + v + 1)) for a in w)
        score = sum(math.log10(p(x[j], tuple(x[max(0, j - order + 1) : j]))) for j in range(1, len(x)))
        yield (i, out, len(w), sum((a,) in known for a in w), n, base, score)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(docs, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 3000)
    monkeypatch.setattr(lm, "SEGMENT", 7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = lm.score(docs, ~out, order=order).collect()
    got = sorted(((r.doc_id, not r.learned, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=repr)
    want = sorted(brute(rows, held, order, lm.STRENGTH), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for x, y in zip(got, want):
        assert x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_probabilities_of_the_next_word_sum_to_one():
    from lodeframe.llm.texts import block_of

    import numpy as np

    grams = lm.Grams(block_of(["a b a c", "b", "a"]))
    learned = np.array([True, True, False])
    counts = [grams.count(k, learned) for k in range(2)]
    kinds = 4  # a, b, c, end; the fifth is the unknown word
    tokens = 7
    p = lambda w, h: (h.get(w, 0) + 4 * ({"a": 2, "b": 2, "c": 1, "e": 2}.get(w, 0) + 1) / (tokens + kinds + 1)) / (sum(h.values()) + 4)
    after_a = {"b": 1, "c": 1}
    assert sum(p(w, after_a) for w in ("a", "b", "c", "e", "?")) == pytest.approx(1)
    read = lm.Automaton(grams, counts, tokens, kinds).read()
    start = {"a": 1, "b": 1}
    assert read[2] == pytest.approx(math.log10(p("a", start)) + math.log10(p("e", after_a)))


def test_nothing_to_read_or_learn(empty, docs):
    assert lm.score(empty, F.lit(True)).count() == 0
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs, F.lit(False)).collect()} == {(0, 0, 0.0, 0.0)}


def test_the_registered_model_has_order_three(spark, docs, folder):
    from lodeframe.llm.queries import op3_backoff_automaton

    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    want = {x[0]: x[6] for x in brute(rows, held, 3, lm.STRENGTH)}
    got = {r.doc_id: r.score for r in op3_backoff_automaton(spark, folder).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)
