import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from conftest import words

from lodeframe.llm import run_index as m


def brute(rows, long):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + long] for d in data for i in range(len(d) - long + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for k in range(len(d) - long + 1):
            if seen[d[k : k + long]] > 1:
                gone[k : k + long] = b"\1" * long
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])), sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted(map(tuple, m.digests(df, **more).collect()), key=repr)


def statistics(stretches):
    """Longest string from each place that also starts elsewhere, by trying all."""
    out = []
    for a, x in enumerate(stretches):
        for i in range(len(x)):
            best = 0
            for b, y in enumerate(stretches):
                for j in range(len(y)):
                    if (a, i) != (b, j):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        best = max(best, n)
            out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab\0") for _ in range(40))
    stretches = [base, base, base[5:30] + b"x" + base[:9], b"a" * 30, b"", b"q", *(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 50))) for _ in range(4))]
    stretches = [s for s in stretches if s]
    begins = np.cumsum([0] + [len(s) for s in stretches])[:-1]
    index = m.RunIndex(np.frombuffer(b"".join(stretches), np.uint8), begins)
    assert index.statistics().tolist() == statistics(stretches)
    assert index.lengths.sum() == index.n and (index.symbols[1:] != index.symbols[:-1]).all()


def test_runs_are_few_where_texts_repeat():
    rng = random.Random(1)
    base = words(rng, 300).encode()
    one, many = (m.RunIndex(np.frombuffer(base * k, np.uint8), np.arange(k) * len(base)) for k in (1, 40))
    assert len(many.heads) < 3 * len(one.heads)


def test_corpus_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for long in (200, 64):
        assert found(docs, long=long) == brute(rows, long)


def odd_rows(seed=7):
    """Copies cut and shifted in all ways, runs of one letter, periods, matches that only overlap themselves, texts of just the length."""
    rng = random.Random(seed)
    base = [words(rng, 40) for _ in range(6)]
    texts = ["a" * 39, "a" * 40, "a" * 41, "b" * 200, "ab" * 60, base[0], base[0][7:], base[0][:61], base[1] + base[2], base[2] + base[1], base[3][:40], base[3][1:41], "é" * 30, "xé" + "é" * 21]
    line = words(rng, 9)
    texts += [words(rng, rng.randint(0, 12)) + line + words(rng, rng.randint(0, 12)) for _ in range(60)]
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(a[i : i + rng.randint(30, 90)] + rng.choice(["", "-", "\n"]) + b[j : j + rng.randint(30, 90)])
    return [*enumerate(texts), (3, texts[5]), (3, texts[5]), (None, texts[8]), (900, None), (901, "")]


@pytest.mark.parametrize("block,bucket,most", [(300, 500, 1 << 30), (1 << 20, 1 << 20, 1 << 30), (400, 2000, 3), (1 << 20, 1 << 20, 1)])
def test_odd_rows(spark, monkeypatch, block, bucket, most):
    """Small blocks and buckets, and groups split down to single windows."""
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    monkeypatch.setattr(m, "BUCKET_BYTES", bucket)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, long=40, gram=17, most=most) == brute(rows, 40)


def test_names_empties_and_bytes(spark, empty):
    assert m.digests(empty).count() == 0
    df = spark.createDataFrame([("k", "é" * 150, 1, 2), ("l", "y" + "é" * 120, 3, 4)], "`row.id` string, `the text` string, block int, entry int")
    kept = {r["row.id"]: (r.n_removed, bytes(r.kept)) for r in m.kept_bytes(df, "the text", "row.id").collect()}
    assert kept == {"k": (300, b""), "l": (240, b"y")}


def test_a_long_text(spark):
    rng = random.Random(9)
    whole = words(rng, 20_000)
    rows = [(1, whole + whole[:5000]), (2, whole[90_000:90_300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows, 200)
