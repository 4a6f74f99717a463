import hashlib
import random

import numpy as np

from lodeframe.llm import simhash
from lodeframe.llm.queries import op8_simhash


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_successors_digests_and_search_equal_brute_force(spark, docs, folder):
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(5).write.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r.doc_id: r for r in op8_simhash(spark, folder).collect()}
    order = sorted(rows, reverse=True)
    assert sorted(found) == sorted(rows)
    for i, nxt in zip(order, order[1:] + order[:1]):
        r, t = found[i], rows[i]
        changed = t[: len(t) - len(t) // 2] + rows[nxt][: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_next == 1 - bits(r.fingerprint, found[nxt].fingerprint) / 128
        assert r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 128
        assert len(r.fingerprint) == 32 and all(found[j].fingerprint == r.fingerprint for j in rows if rows[j] == t)
        near = sum(bits(r.fingerprint, x.fingerprint) <= simhash.RADIUS for x in found.values()) - 1
        assert r.n_near == (near if i % 50 == 0 else None)


def test_nulls_repeats_one_row_and_none(spark, docs, empty):
    found = simhash.with_successors(docs).collect()
    assert len(found) == docs.count()
    assert simhash.with_successors(empty).count() == 0
    one = simhash.with_successors(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert (one.n_chars, one.near_next) == (7, 1.0)


def test_search_at_other_radii(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(1, 9))) for b in base for _ in range(6)]
    halves = [tuple(int(np.array(x, np.uint64).view(np.int64)) for x in (p >> 64, p & (2**64 - 1))) for p in prints]
    data = spark.createDataFrame(halves, "high long, low long")
    for radius in (0, 3, 6):
        found = {(r.high, r.low): r.n_near for r in simhash.neighbours(data, data, radius).collect()}
        assert found == {h: sum(bin(p ^ q).count("1") <= radius for q in prints) for h, p in zip(halves, prints)}


def test_search_at_the_registered_radius(spark):
    """Fingerprints up to 12 bits apart, the limit of real near copies, are found, and none beyond."""
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(8)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), n)) for b in base for n in range(1, 16)]
    halves = [tuple(int(np.array(x, np.uint64).view(np.int64)) for x in (p >> 64, p & (2**64 - 1))) for p in prints]
    data = spark.createDataFrame(halves, "high long, low long")
    found = {(r.high, r.low): r.n_near for r in simhash.neighbours(data, data.limit(8)).collect()}
    assert found == {h: sum(bin(p ^ q).count("1") <= 12 for q in prints) for h, p in zip(halves[:8], prints[:8])}


def test_search_sends_no_table_of_keys_to_the_driver(spark, folder):
    """Each query stands for some 350 keys, which the size before that does not tell."""
    spark.range(200).selectExpr("xxhash64(id) AS high", "xxhash64(id, 1) AS low").write.parquet(f"{folder}/prints")
    data = spark.read.parquet(f"{folder}/prints")
    found = simhash.neighbours(data, data.limit(20))
    assert [r.n_near for r in found.collect()] == [1] * 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_most_copies_with_one_word_in_a_hundred_changed_are_within_the_radius():
    from lodeframe.llm.texts import block_of

    rng = random.Random(6)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(250)] for _ in range(60)]
    changed = [[f"x{rng.randrange(3000)}" if rng.random() < 0.01 else w for w in t] for t in texts]
    a, b = (simhash.fingerprints(block_of([" ".join(t) for t in ts])) for ts in (texts, changed))
    assert (np.bitwise_count(a ^ b).sum(axis=1) <= simhash.RADIUS).mean() > 0.7
