import random
import re

import numpy as np
from conftest import make_texts, plain

from lodeframe.llm import suffix_quality as q
from lodeframe.llm.texts import block_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest(words):
    """For each place, the longest run that also starts elsewhere."""
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def brute(text, least=q.MIN_WORDS):
    text = text or ""
    found = list(WORD.finditer(text))
    w = [m[0] for m in found]
    runs = longest(w) if len(w) < 700 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
    if runs is None:
        return base, None, None, None
    cover = lambda m, size: {k for i, n in enumerate(runs) if n >= m for k in range(i, i + (size or n))}
    return base, len(cover(5, 5)), len(cover(least, 0)), max([n for n in runs if n >= least], default=0)


def test_counts_and_repeats_equal_brute_force(docs):
    for r in q.assess(docs, keep=("doc_id", "text")).collect():
        base, repeat, covered, most = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == base
        if repeat is not None:
            assert (r.n_repeat_words, r.covered_words, r.longest_repeat) == (repeat, covered, most)
            assert r.base_failed == (base[0] < 10 or 100 * repeat > 20 * base[0])
        assert sum(len(WORD.findall((r.text or "")[s.start : s.end])) for s in r.spans) == r.covered_words
        assert not (r.base_failed and r.kept)


def test_longest_repeats_on_small_alphabets():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.choice("ab c".split()) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        flat = [w for t in texts for w in t]
        owner = np.repeat(np.arange(4), [len(t) for t in texts])
        key = np.array([ord(w[0]) for w in flat], np.uint64)
        assert q.longest_repeats(owner, key).tolist() == [n for t in texts for n in longest(t)]


def test_limits_reject_what_the_base_rules_let_through():
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    clean = " ".join(f"w{rng.random()}" for _ in range(900))
    found = q.measure(block_of([f"{passage} {clean} {passage}", clean]))
    assert found["base_failed"].tolist() == [False, False]
    assert q.verdict(found).tolist() == [False, True]


def test_filter_keeps_all_columns_and_empty_tables(docs, empty):
    kept = q.drop_repetitive(docs)
    judged = q.assess(docs, keep=("doc_id", "text"))
    assert kept.columns == docs.columns
    assert plain(kept, "doc_id", "text") == plain(judged.where("kept"), "doc_id", "text")
    assert q.assess(empty).count() == 0 and q.drop_repetitive(empty).columns == empty.columns
    assert len(make_texts()) > 0
