"""Language-model scores from a weighted backoff automaton over smoothed n-grams.

Words are runs other than space and \\t-\\r with A-Z lower-cased, and each text ends with one end token. With c the counts over the texts
learned from, p1(w) = (c(w) + 1) / (N + V + 1) and p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K), where h' is h without its first word.
As an automaton: each history met is a state, each n-gram met an arc with its smoothed log10 probability, and a state's failure arc
leads to h' with the weight log10(K / (c(h) + K)). A text is read once from left to right; the state is carried from word to word.

The model has the size of the corpus, so no task holds it. Texts are dealt into blocks by a hash. A block sends each n-gram it has, once,
with its count, to the range of n-gram keys that adds up the counts of all blocks; the sums come back in the same order, and the block
builds the part of the automaton that its own texts can reach. Frequent words weigh no more than others: one entry for each block.
Every block hears from every range of words, so that N and V are the sums of what the ranges report. Texts move as compressed pieces.
Keys have 64 bits; n-grams that share one by chance share their counts.

Null and empty texts are the end token alone. Repeated rows count as often as they occur and score alike. With nothing to learn from,
N = V = 0 and every word has probability 1.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.texts import Block, blocks, chain, keys_of, spread

ORDER, STRENGTH = 3, 4.0
BLOCK_BYTES, RANGE_BYTES = 10 << 20, 10 << 20
SEGMENT = 512
#: Noisy bytes of a value, number of values, first key.
HEAD = struct.Struct("<BIQ")
BEGIN, END = (np.uint64(x) for x in (0xB5026F5AA96619E9, 0x5851F42D4C957F2D))


def pack(values: np.ndarray, sort_of: str) -> bytes:
    """Sorted keys as differences, or counts. Equal bytes of all values lie together: the low ones of differences, which are noise, as they
    are, the others compressed."""
    first = int(values[0]) if len(values) and sort_of == "keys" else 0
    raw = np.diff(values, prepend=values[:1]) if sort_of == "keys" else values
    noise = int(np.log2(max(1.0, float(raw.mean())))) // 8 if len(values) and sort_of == "keys" else 0
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T)
    return HEAD.pack(noise, len(values), first) + planes[:noise].tobytes() + zstandard.compress(planes[noise:].tobytes(), 1)


def unpack(data: bytes, sort_of: str) -> np.ndarray:
    noise, n, first = HEAD.unpack_from(data)
    cut = HEAD.size + noise * n
    planes = np.frombuffer(data[HEAD.size : cut] + zstandard.decompress(data[cut:]), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(values, dtype=np.uint64) + np.uint64(first) if sort_of == "keys" else values.view(np.int64)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range each key falls into, in the order of the keys."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


class Grams:
    """The n-grams of a block: for each order the distinct keys and, for each token, the number of the n-gram that ends there or -1."""

    def __init__(self, block: Block, order: int = ORDER):
        block = block.lower()
        starts, ends = block.words()
        words = np.bincount(block.owners(starts), minlength=len(block))
        self.counts = words + 2
        self.owner, place = spread(self.counts)
        self.begin, self.end = place == 0, place == self.counts[self.owner] - 1
        key = np.empty(len(self.owner), np.uint64)
        key[self.begin], key[self.end] = BEGIN, END
        key[~(self.begin | self.end)] = keys_of(block.data, starts, ends)
        self.keys, self.at, self.one = [], [], []
        made = key
        for k in range(order):
            if k:
                made = chain(np.concatenate([made[:1], made[:-1]]), key)
            there = place >= k
            keys, one, number = np.unique(made[there], return_index=True, return_inverse=True)
            at = np.full(len(key), -1, np.int32)
            at[there] = number
            self.keys.append(keys)
            self.at.append(at)
            self.one.append(np.flatnonzero(there)[one].astype(np.int32))
            del number, one, there

    def count(self, k: int, learn: np.ndarray) -> np.ndarray:
        """Occurrences of each n-gram of order k + 1 in the texts learned from."""
        some = learn[self.owner] & (self.at[k] >= 0)
        return np.bincount(self.at[k][some], minlength=len(self.keys[k]))


class Automaton:
    """States and arcs that a block's texts can reach, from the corpus counts of its n-grams."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, kinds: int, strength: float = STRENGTH):
        self.grams, self.counts = grams, counts
        p = [(counts[0] + 1) / (tokens + kinds + 1)]
        self.fail = [np.log10(strength / (counts[0] + strength))]
        for k in range(1, len(counts)):
            one = grams.one[k]
            lower, history = grams.at[k - 1][one], grams.at[k - 1][one - 1]
            seen = counts[k - 1][history]
            p.append(np.where(seen > 0, (counts[k] + strength * p[-1][lower]) / (seen + strength), p[-1][lower]))
            self.fail.append(np.log10(strength / (counts[k] + strength)))
        self.arc = [np.log10(x) for x in p]

    def step(self, token: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one token in each of many texts: from states of the given depths to the next depths, with the weight of the way."""
        weight = np.zeros(len(token))
        for k in range(len(self.counts) - 1, 0, -1):
            here = np.flatnonzero(depth == k)
            lost = here[self.counts[k][self.grams.at[k][token[here]]] == 0]
            weight[lost] += self.fail[k - 1][self.grams.at[k - 1][token[lost] - 1]]
            depth[lost] = k - 1
        for k in range(len(self.counts)):
            here = depth == k
            weight[here] += self.arc[k][self.grams.at[k][token[here]]]
        met = (depth > 0) | (self.counts[0][self.grams.at[0][token]] > 0)
        return np.where(met, np.minimum(depth + 1, len(self.counts) - 1), 0), weight

    def start(self, token: np.ndarray) -> np.ndarray:
        """Depth of the state after these tokens: that of the longest history met."""
        depth = np.zeros(len(token), np.int64)
        for k in range(len(self.counts) - 1):
            at = self.grams.at[k][token]
            depth[(at >= 0) & (depth == k) & (self.counts[k][np.maximum(at, 0)] > 0)] = k + 1
        return depth

    def read(self) -> np.ndarray:
        """log10 probability of each text. Long texts are read as segments that start from the state their last words lead to."""
        n = self.grams.counts - 1
        parts = -(-n // SEGMENT)
        text, place = spread(parts)
        first = (np.cumsum(self.grams.counts) - self.grams.counts)[text] + 1 + place * SEGMENT
        length = np.minimum(SEGMENT, n[text] - place * SEGMENT)
        by = np.argsort(-length, kind="stable")
        first, length, text = first[by], length[by], text[by]
        total, depth = np.zeros(len(first)), self.start(first - 1)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, side="left"))
            depth[:live], weight = self.step(first[:live] + t, depth[:live])
            total[:live] += weight
        return np.bincount(text, weights=total, minlength=len(n))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, learn, ends, frame): the texts of a batch that go to one block, compressed together."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        by = np.argsort(block, kind="stable")
        batch = batch.take(pa.array(by))
        at = np.flatnonzero(np.diff(block[by], prepend=-1))
        if not len(at):
            continue
        _, _, texts = next(blocks(batch.column("t"), 1 << 50))
        cuts = pa.array([*at, len(block)], pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(cuts, values)
        ends = pa.array(texts.offsets[1:] - np.repeat(texts.offsets[at], np.diff([*at, len(block)])), pa.int64())
        edges = texts.offsets[[*at, len(block)]]
        frames = [zstandard.compress(texts.data[a:b].tobytes(), 3) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(block[by][at], pa.int64()), "ids": lists(batch.column("id")), "learn": lists(batch.column("learn")),
            "ends": lists(ends), "frame": pa.array(frames, pa.binary()),
        })


def _joined(group: pa.Table) -> Block:
    """All texts of a block's pieces."""
    data, offsets, size = [], [np.zeros(1, np.int64)], 0
    for frame, ends in zip(group.column("frame"), group.column("ends")):
        data.append(np.frombuffer(zstandard.decompress(frame.as_py()), np.uint8))
        offsets.append(ends.values.to_numpy() + size)
        size += len(data[-1])
    return Block(np.concatenate(data), np.concatenate(offsets))


def _flat(group: pa.Table, name: str) -> pa.Array:
    return group.column(name).combine_chunks().flatten()


def _add_up(group: pa.Table) -> pa.Table:
    """Adds up the counts of equal n-grams and hands every block the sums for its own, in its order, and the range's tokens and kinds."""
    keys = [unpack(x, "keys") for x in group.column("keys").to_pylist()]
    counts = [unpack(x, "counts") for x in group.column("counts").to_pylist()]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, number, np.concatenate(counts))
    back = np.split(total[number], np.cumsum([len(k) for k in keys])[:-1])
    words = total[distinct != BEGIN]
    sides = {"tokens": np.full(len(keys), words.sum()), "kinds": np.full(len(keys), np.count_nonzero(words))}
    return pa.table({"block": group.column("block"), "gram": group.column("gram"), "range": group.column("range"), "sums": [pack(x, "counts") for x in back], **sides})


def score(df: DataFrame, learn: Column, text: str = "text", id_col: str = "doc_id", order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """id, learned, n_tokens, n_known, train_tokens, base_score and score of every text, by a model of the rows where `learn` holds."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks, ranges = 1 + size // BLOCK_BYTES, 1 + size // RANGE_BYTES
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)))
    kind = df.schema[id_col].dataType.simpleString()
    dealt = dealt.mapInArrow(pieces, f"block long, ids array<{kind}>, learn array<boolean>, ends array<long>, frame binary")

    def gather(group: pa.Table) -> pa.Table:
        grams = Grams(_joined(group), order)
        learned = _flat(group, "learn").to_numpy(zero_copy_only=False)
        out: dict = {"block": [], "gram": [], "range": [], "keys": [], "counts": []}
        for k, keys in enumerate(grams.keys):
            count = grams.count(k, learned)
            cut = np.searchsorted(range_of(keys, ranges), np.arange(1, ranges))
            for r, (x, c) in enumerate(zip(np.split(keys, cut), np.split(count, cut))):
                # A range of words is asked even where a block has none of its words.
                if len(x) or not k:
                    out["range"].append(r)
                    out["keys"].append(pack(x, "keys"))
                    out["counts"].append(pack(c, "counts"))
                    out["gram"].append(k)
        out["block"] = [group.column("block")[0].as_py()] * len(out["gram"])
        return pa.table(out, pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    sums = dealt.groupBy("block").applyInArrow(gather, "block long, gram long, range long, keys binary, counts binary")
    sums = sums.groupBy("gram", "range").applyInArrow(_add_up, "block long, gram long, range long, sums binary, tokens long, kinds long")

    def read(group: pa.Table, back: pa.Table) -> pa.Table:
        grams = Grams(_joined(group), order)
        back = back.sort_by([("gram", "ascending"), ("range", "ascending")])
        gram, sums = back.column("gram").to_numpy(), back.column("sums").to_pylist()
        tokens, kinds = (int(back.column(c).to_numpy()[gram == 0].sum()) for c in ("tokens", "kinds"))
        counts = [np.concatenate([unpack(sums[i], "counts") for i in np.flatnonzero(gram == k)] or [np.zeros(0, np.int64)]) for k in range(order)]
        c = counts[0][grams.at[0]]
        own = ~grams.begin
        n = len(grams.counts)
        base = np.bincount(grams.owner[own], weights=np.log10((c[own] + 1) / (tokens + kinds + 1)), minlength=n)
        known = np.bincount(grams.owner[own & (c > 0)], minlength=n)
        logs = Automaton(grams, counts, tokens, kinds, strength).read()
        return pa.table({"id": _flat(group, "ids"), "learned": _flat(group, "learn"), "n_tokens": pa.array(grams.counts - 1, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(n, tokens), pa.int64()), "base_score": base, "score": logs})

    out = dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(read, f"id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
