"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. Every text becomes its set of distinct word shingles. Texts with equal sets are one node (a 128-bit sum over the set), so exact copies
   never meet as pairs.
2. Minima over `rows * bands` hash functions give a key for each band of `rows` minima. The number of bands follows from the threshold, so
   that a pair at the threshold shares none with a chance of `MISS`. Nodes that share a band key are candidates; they keep their set, and the
   low `BITS` bits of `MINIMA` minima, packed.
3. Two rounds measure each candidate against one hub of its buckets, on the full sets; links merge components. Then all pairs of a bucket
   that still lie in different components are compared, block against block where a bucket is large, each pair in its first common band.
   The sets of a block's members meet in its task, and only pairs that link are written. Two bounds drop pairs before that: the Jaccard distance is a metric, so distances to a common hub that differ by more than 1 - threshold
   exclude a link; and the similarity estimated from the bit counts, corrected for chance collisions, may not lie `SIGMAS` standard
   deviations under the threshold.
4. What is left is decided on the full sets: |A and B| >= threshold * |A or B|.
5. Components are found by passing on least labels and jumping pointers, all as joins.

Texts without words have empty sets and link with nothing. Rows with a null id take no part: their component is null and they stay. Rows
that repeat an id are the same document if their texts agree; the id's rows stay or go by their own text's component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.texts import SMALL, Block, chain, keys_of, mix, per_text
from lodeframe.operators.links import components
from lodeframe.session import cut

WORDS, THRESHOLD = 5, Fraction(8, 10)
ROWS, MISS = 4, 1e-6
BITS, MINIMA, SIGMAS = 4, 256, 5.0
#: Members of a bucket that are compared with each other in one group; larger buckets are cut into blocks.
SIDE = 1000


def bands_for(threshold: Fraction, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(float(threshold), 0.999) ** rows)))


def shingle_sets(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each distinct shingle, sorted by both; a text of fewer words is one shingle."""
    block = block.lower()
    starts, ends = block.words()
    owner = block.owners(starts)
    count = np.bincount(owner, minlength=len(block))
    key = keys_of(block.data, starts, ends)
    made = key.copy()
    for k in range(1, words):
        made[: len(key) - k] = chain(made[: len(key) - k], key[k:])
    whole = np.flatnonzero(owner[: len(key) - words + 1] == owner[words - 1 :]) if len(key) >= words else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    first = (np.cumsum(count) - count)[short]
    ends_of = []
    for at, n in zip(first, count[short]):
        value = key[at : at + 1]
        for k in range(1, n):
            value = chain(value, key[at + k : at + k + 1])
        ends_of.append(mix(value + np.uint64(n)))
    text = np.concatenate([owner[whole], short])
    value = np.concatenate([made[whole], *ends_of]) if ends_of else made[whole]
    by = np.lexsort((value, text))
    text, value = text[by], value[by]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def node_of(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free sums that stand for each set."""
    return tuple(np.add.reduceat(mix(value ^ np.uint64(s)), first).view(np.int64) for s in (0x1234567, 0x89ABCDEF0123))


def packed(minima: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, two to a byte."""
    low = (minima & np.uint64(15)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures from the counted unequal minima, corrected for those that agree by chance."""
    x = a ^ b
    x |= x >> 1
    x |= x >> 2
    same = 1 - np.bitwise_count((x & 0x11).view(np.uint64)).sum(axis=-1) / MINIMA
    chance = 0.5**BITS
    return (same - chance) / (1 - chance)


def floor_of(threshold: Fraction) -> float:
    chance = 0.5**BITS
    p = float(threshold) * (1 - chance) + chance
    return float(threshold) - SIGMAS * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def minima_of(value: np.ndarray, first: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minima of each set; the high bits of a product decide the minimum, and mixing makes the low ones as good."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, n, dtype=np.uint64)
    return mix(np.stack([np.minimum.reduceat((value ^ o) * f, first) for f, o in zip(factors, offsets)], axis=1))


def band_keys(df: DataFrame, text: str, id_col: str, words: int, bands: int, rows: int = ROWS) -> DataFrame:
    """id, digest of the text, n_shingles, node, node2, bands for each row; the last three are null for texts without words."""

    def compute(block: Block) -> dict:
        owner, value = shingle_sets(block, words)
        size = np.bincount(owner, minlength=len(block))
        some = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[some]
        nodes, lists = [[None] * len(block) for _ in range(2)], [None] * len(block)
        if len(some):
            minima = minima_of(value, first, bands * rows, 20)
            keys = minima[:, ::rows]
            for r in range(1, rows):
                keys = chain(keys, minima[:, r::rows])
            keys = mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            one, two = node_of(value, first)
            for at, i in enumerate(some):
                nodes[0][i], nodes[1][i], lists[i] = one[at], two[at], keys[at]
        return {"n_shingles": size, "node": pa.array(nodes[0], pa.int64()), "node2": pa.array(nodes[1], pa.int64()), "bands": pa.array(lists, pa.list_(pa.int64()))}

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("node2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return per_text(df.select(F.col(f"`{id_col}`").alias("id"), _digest(text).alias("digest"), F.col(f"`{text}`").alias("text")), "text", ["id", "digest"], fields, compute, size=SMALL)


def _digest(text: str) -> Column:
    """Tells apart texts of one id."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def full_sets(df: DataFrame, words: int) -> DataFrame:
    """node, the sorted set, eight bytes for each shingle, and the packed signature of the rows (id, text)."""

    def compute(block: Block) -> dict:
        owner, value = shingle_sets(block, words)
        size = np.bincount(owner, minlength=len(block))
        first = np.cumsum(size) - size
        out = [[None] * len(block) for _ in range(3)]
        some = np.flatnonzero(size)
        if len(some):
            low = packed(minima_of(value, first[some], MINIMA, 21))
            for at, (i, one) in enumerate(zip(some, node_of(value, first[some])[0])):
                out[0][i], out[1][i], out[2][i] = one, value[first[i] : first[i] + size[i]].tobytes(), low[at].tobytes()
        return {"node": pa.array(out[0], pa.int64()), "members": pa.array(out[1], pa.binary()), "sig": pa.array(out[2], pa.binary())}

    fields = [T.StructField("node", T.LongType()), T.StructField("members", T.BinaryType()), T.StructField("sig", T.BinaryType())]
    return per_text(df, "text", ["id"], fields, compute, size=SMALL).where("node is not null")


def measured(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) with their Jaccard distance on the full sets and whether they link, which is decided in whole numbers."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            away, linked = [], []
            for i in range(len(batch)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                union = len(x) + len(y) - both
                away.append(1 - both / union)
                linked.append(down * both >= up * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "away", "linked"])

    there = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("right")), "b")
    there = there.join(sets.select(F.col("node").alias("a"), F.col("members").alias("left")), "a")
    return there.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, away double, linked boolean")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def hub_pairs(members: DataFrame) -> DataFrame:
    """For each node (a) the hub (b), the least node of the least component, that most of its buckets offer, if that is another component's."""
    hubs = members.groupBy("key").agg(F.min(F.struct("comp", "node")).alias("hub"))
    offers = members.join(hubs, "key").where("comp <> hub.comp").groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("n"))
    best = offers.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.hub").alias("b"))


SIDES = ["key", "x", "y", "mine", "node", "comp", "bands", "sig", "hub0", "away0", "hub1", "away1"]


def blocks_of(members: DataFrame) -> DataFrame:
    """The members of buckets with several components, once for each pair of blocks (x, y) of the bucket that their own block is in."""
    open_keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    cuts = members.join(open_keys.select("key", F.ceil(F.col("n") / SIDE).cast("int").alias("cuts")), "key").withColumn("mine", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    sides = cuts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return sides.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).select(*SIDES)


def open_pairs(group: pa.Table, threshold: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of the first block, the members of the second that it must still be compared with."""
    least, furthest = floor_of(threshold), 1 - float(threshold) + 1e-9
    key, x, y = (group.column(c)[0].as_py() for c in ("key", "x", "y"))
    node, comp, mine = (group.column(c).to_numpy() for c in ("node", "comp", "mine"))
    hubs = [(group.column(f"hub{k}").fill_null(0).to_numpy(), group.column(f"away{k}").to_numpy(zero_copy_only=False)) for k in (0, 1)]
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
    bands = np.array(group.column("bands").to_pylist(), np.int64)
    place = int(np.flatnonzero(bands[0] == key)[0])
    right = np.flatnonzero(mine == y)
    for i in np.flatnonzero(mine == x):
        some = right[(comp[right] != comp[i]) & ((node[right] > node[i]) | (x != y))]
        some = some[(bands[some] == bands[i]).argmax(axis=1) == place]
        for hub, away in hubs:
            for other, far in hubs:  # through a common hub; one of the two may be the hub
                bound = np.where(hub[some] == other[i], np.abs(away[some] - far[i]), 0)
                some = some[~(bound > furthest)]
            some = some[~((node[some] == hub[i]) & (away[i] > furthest)) & ~((hub[some] == node[i]) & (away[some] > furthest))]
        some = some[estimates(sigs[some], sigs[i]) >= least]
        if len(some):
            yield i, some


def block_links(members: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) between components, as many as join them up, from all pairs of a bucket that neither bound excludes.

    `members` has key, node, comp, bands, sig and hubs. First the members that need comparing are found, then their sets join them, and the
    pairs are decided where the sets meet: no pair is written unless it links.
    """
    up, down = threshold.numerator, threshold.denominator

    def needed(group: pa.Table) -> pa.Table:
        some = set()
        for i, others in open_pairs(group, threshold):
            some.update((i, *others.tolist()))
        return group.take(pa.array(sorted(some), pa.int64()))

    def decide(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        sets_of = [np.frombuffer(m.as_buffer(), np.uint64) for m in group.column("members")]
        top = {}

        def root(v: int) -> int:
            while top.get(v, v) != v:
                v = top[v]
            return v

        comp = group.column("comp").to_pylist()
        a, b = [], []
        for i, others in open_pairs(group, threshold):
            for j in others.tolist():
                p, q = root(comp[i]), root(comp[j])
                if p == q:
                    continue
                small, large = sorted((sets_of[i], sets_of[j]), key=len)
                if down * len(small) < up * len(large):
                    continue
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if down * both >= up * (len(small) + len(large) - both):
                    top[max(p, q)] = min(p, q)
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sides = blocks_of(members)
    asked = sides.groupBy("key", "x", "y").applyInArrow(needed, sides.schema)
    return asked.join(sets.select("node", "members"), "node").groupBy("key", "x", "y").applyInArrow(decide, "a long, b long")


def _classes(df: DataFrame, text: str, id_col: str, words: int, threshold: Fraction) -> DataFrame:
    """One row for each row: id, digest, n_shingles, component_id, kept."""
    sigs = cut(band_keys(df, text, id_col, words, bands_for(threshold)))
    nodes = sigs.where("node is not null and id is not null").groupBy("node", "node2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    rows = nodes.select("node", "rep", F.explode("bands").alias("key"))
    shared = rows.select("key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(rows.join(shared, "key"))
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    reps = members.select(F.col("rep").alias("id"), "node").distinct()
    found = full_sets(texts.join(reps.select("id").distinct(), "id"), words).join(reps, ["id", "node"], "left_semi")
    sets = cut(found.groupBy("node").agg(F.first("members").alias("members"), F.first("sig").alias("sig")))

    plain = members.select("key", "node")
    links, labels, hubs = None, None, sets.select("node", "sig").join(nodes.select("node", "bands"), "node")
    for turn in range(2):
        tested = cut(measured(hub_pairs(_labelled(plain, labels)), sets, threshold))
        hubs = hubs.join(tested.select(F.col("a").alias("node"), F.col("b").alias(f"hub{turn}"), F.col("away").alias(f"away{turn}")), "node", "left")
        new = tested.where("linked").select("a", "b")
        links = new if links is None else links.union(new)
        labels = components(links)
    last = cut(block_links(_labelled(plain, labels).join(hubs, "node"), sets, threshold))
    labels = components(links.union(last))
    classes = sigs.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep"))
    merged = classes.join(labels, "node")
    least = merged.groupBy("comp").agg(F.min("rep").alias("component_id"))
    whole = classes.join(merged.select("node", "comp").join(least, "comp"), "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = sigs.select("id", "digest", "n_shingles", "node").join(whole, "node", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return out.select("id", "digest", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def groups(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row for each row: its id, n_shingles (set size), component_id (least id reachable over links, itself included), kept."""
    return _classes(df, text, id_col, words, threshold).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_copies(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows, with all columns, without those that go: of each group the document with the least id stays. An id may have several texts."""
    gone = _classes(df, text, id_col, words, threshold).where("not kept").select(F.col("id").alias("gone_id_"), F.col("digest").alias("gone_digest_")).distinct()
    return df.join(gone, (F.col(f"`{id_col}`") == F.col("gone_id_")) & (_digest(text) == F.col("gone_digest_")), "left_anti")
