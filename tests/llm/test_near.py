import random
import re
from fractions import Fraction

import numpy as np
import pytest
from conftest import words

from lodeframe.llm import bbit_minhash as m
from lodeframe.operators import links


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows, t):
    rows = [(i, shingles(x)) for i, x in rows if i is not None]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and t.denominator * len(x & y) >= t.numerator * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)] if s else i) for k, (i, s) in enumerate(rows))


@pytest.mark.parametrize("t", [Fraction(85, 100), Fraction(8, 10)])
def test_components_equal_brute_force(docs, t):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = m.groups(docs, threshold=t).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == brute(rows, t)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_a_family_of_copies_in_small_blocks(spark, monkeypatch):
    """Copies edited to all degrees: chains, stragglers and pairs near the threshold, with buckets cut into many blocks."""
    monkeypatch.setattr(m, "SIDE", 7)
    rng = random.Random(8)
    w = words(rng, 120).split(" ")
    rows = []
    for i in range(70):
        v = list(w)
        for _ in range(rng.randint(0, 9)):
            v[rng.randrange(len(v))] = f"e{rng.randint(0, 9)}"
        rows.append((i + 1, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in m.groups(df).collect()) == brute(rows, Fraction(8, 10))


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        common, own = int(2000 * share), 2000 - int(2000 * share)
        base = rng.integers(0, 2**63, common + own, dtype=np.uint64)
        a, b = base[: common + own // 2], np.concatenate([base[:common], base[common + own // 2 :]])
        sig = m.packed(m.minima_of(np.concatenate([a, b]), np.array([0, len(a)]), m.MINIMA, 1))
        assert abs(m.estimates(sig[:1], sig[1])[0] - share) < 0.15
    assert (1 - 0.85**m.ROWS) ** m.bands_for(Fraction(85, 100)) <= m.MISS


def test_dropping_copies_keeps_columns(docs, empty):
    kept = m.drop_near_copies(docs)
    assert kept.columns == docs.columns
    stay = {r.doc_id for r in m.groups(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == stay and kept.where("doc_id is null").count() == 2
    assert m.groups(empty).count() == 0 and m.drop_near_copies(empty).count() == 0


def test_an_id_with_two_texts_keeps_the_one_that_is_no_copy(spark):
    rng = random.Random(2)
    a, b = words(rng, 40), words(rng, 40)
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (None, a)], "`doc.id` long, text string")
    assert sorted(map(tuple, m.drop_near_copies(df, id_col="doc.id").collect()), key=repr) == sorted([(1, a), (5, b), (None, a)], key=repr)


def test_components_of_few_links_need_one_partition(spark, monkeypatch):
    """Hundreds of shuffle partitions for a few links would write a file for each pair of tasks; the labels are those of a plain search."""
    rng = random.Random(8)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1012)] + [(5, 5), (None, 7)]
    top = {}

    def root(v):
        while top.get(v, v) != v:
            v = top[v]
        return v

    for a, b in pairs:
        if a is not None:
            p, q = sorted((root(a), root(b)))
            top[q] = p
    table = spark.createDataFrame(pairs, "a long, b long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part, most in ((links.PART, 1), (50, 8)):
            monkeypatch.setattr(links, "PART", part)
            found = links.components(table.where("a is not null"))
            assert found.rdd.getNumPartitions() <= most
            assert {r.node: r.comp for r in found.collect()} == {v: root(v) for p in pairs if p[0] is not None for v in p}
        assert links.components(table.where("a < 0")).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
