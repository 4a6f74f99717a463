import math
import random
import re

import numpy as np
from conftest import words

from lodeframe.llm import gru_toxicity as g
from lodeframe.llm.texts import block_of, keys_of

BAD = ["snarg", "Blick", "vorpel"]


def sample(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(5, 150)).split(" ")
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w) + 1), rng.choice(BAD) + rng.choice(["", ".", "s"]))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_held_out_accuracy_and_long_texts():
    net = g.train(*sample(240, 1), 1 / 3)
    texts, y = sample(120, 2)
    score = net.score(block_of(texts))
    assert ((score >= 0.5) == y).mean() > 0.95
    rng = random.Random(9)
    long = words(rng, 5000)
    score = net.score(block_of([long, f"{long} snarg vorpel Blick snarg", "", None, texts[0], texts[0]]))
    assert score[1] > score[0] and score[4] == score[5] and score[2] == score[3] and ((score >= 0) & (score <= 1)).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    net = g.Network(np.arange(4, dtype=np.uint64))
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape)
    there = np.arange(6)[:, None] < np.array([6, 3, 1, 4])
    gates = rng.standard_normal((6, 4, 6 * g.HIDDEN))
    y = rng.standard_normal(4)
    tape = {}
    net.forward(gates, there, tape)
    grads, d_gates = net.backward(y, there, tape)
    loss = lambda: float(net.forward(gates, there) @ y)
    for array, grad in [*((net.p[k], grads[k]) for k in ("out", "look", "look_out", "look_bias", "ahead", "back")), (gates, d_gates)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in array.shape)
            keep = array[at]
            array[at] = keep + 1e-3
            up = loss()
            array[at] = keep - 1e-3
            down = loss()
            array[at] = keep
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3 * max(1, abs(grad[at]))


def _key(word):
    return keys_of(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]


def _plain_logit(net, tokens):
    """One window, a token and a unit at a time."""
    p, n, units = {k: v.astype(float).tolist() for k, v in net.p.items()}, len(tokens), range(g.HIDDEN)
    known = {int(k): i for i, k in enumerate(net.keys)}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def gates(token):
        padded = b"\0" + token + b"\0"
        grams = [p["grams"][(((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761) >> 7) % g.TRIGRAMS] for i in range(len(token))]
        x = p["words"][known.get(int(_key(token)), len(known))] + [sum(c) / len(grams) for c in zip(*grams)]
        return [sum(v * row[j] for v, row in zip(x, p["into"])) + p["bias"][j] for j in range(6 * g.HIDDEN)]

    def read(order, u, at):
        states, h = {}, [0.0] * g.HIDDEN
        for t in order:
            own = gates(tokens[t])[at : at + 3 * g.HIDDEN]
            side = [sum(v * row[j] for v, row in zip(h, u)) for j in range(3 * g.HIDDEN)]
            z, r = ([sigmoid(own[k + j] + side[k + j]) for j in units] for k in (0, g.HIDDEN))
            new = [math.tanh(own[2 * g.HIDDEN + j] + r[j] * side[2 * g.HIDDEN + j]) for j in units]
            h = states[t] = [z[j] * h[j] + (1 - z[j]) * new[j] for j in units]
        return states

    ahead, back = read(range(n), p["ahead"], 0), read(range(n - 1, -1, -1), p["back"], 3 * g.HIDDEN)
    states = [ahead[t] + back[t] for t in range(n)]
    look = [sum(math.tanh(sum(v * row[a] for v, row in zip(s, p["look"])) + p["look_bias"][a]) * p["look_out"][a] for a in range(g.ATTENTION)) for s in states]
    total = sum(map(math.exp, look))
    return sum(math.exp(e) / total * v * o for e, s in zip(look, states) for v, o in zip(s, p["out"])) + p["out_bias"][0]


def test_scores_agree_with_a_loop_over_tokens():
    rng, draw = random.Random(4), np.random.default_rng(4)
    vocabulary = [w.encode() for w in {"snarg", *words(rng, 40).split(" ")}]
    net = g.Network(np.sort(np.array([_key(w) for w in vocabulary], np.uint64)))
    for k, v in net.p.items():
        net.p[k] = (v + 0.4 * draw.standard_normal(v.shape)).astype(np.float32)
    net.scale, net.shift = 1.3, -0.2
    word = lambda: rng.choice([w.decode() for w in vocabulary] + ["Snarg", "été", "x", "7up", "新しい"])
    texts = [rng.choice([" ", ", "]).join(word() for _ in range(n)) for n in (1, 2, g.WINDOW, g.WINDOW + 1, 130, 5)] + ["", None, " .,!", "été", "été"]
    want = []
    for text in texts:
        tokens, logits = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower()), []
        for start in range(0, max(1, len(tokens)), g.STRIDE):
            if start == 0 or start + g.WINDOW - g.STRIDE < len(tokens):
                logits.append(_plain_logit(net, tokens[start : start + g.WINDOW]))
        want.append(1 / (1 + math.exp(-(net.scale * max(logits) + net.shift))))
    assert np.abs(net.score(block_of(texts)) - want).max() < 1e-4 and np.ptp(want) > 0.1


def test_windows_overlap_and_reach_the_end():
    counts = np.array([0, 1, g.WINDOW, g.WINDOW + 1, 1000])
    text, start, length = g.windows_of(counts)
    first = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        own = text == i
        covered = {k for a, m in zip(start[own] - first[i], length[own]) for k in range(a, a + m)}
        assert covered == set(range(n))


def test_tables_without_labels_or_rows(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = g.fit(docs, labels)
    assert {r.score for r in g.score(docs, model).collect()} == {0.0} and g.drop_toxic(docs, model).count() == docs.count()
    assert g.score(empty, model).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 0, None)], labels.schema)
    assert g.fit(docs, one) == 1.0
