"""SimHash fingerprints of whole texts, of texts edited with their successor, and the search for all fingerprints within a Hamming radius.

A term is two neighbouring words (a text of one word has that word), its weight 1 + log2 of its count in the text. Each term's 128-bit
hash votes with its weight for or against every bit. `1 - distance / 128` is the likeness of two fingerprints.

Search: fingerprints are cut into `BLOCKS` blocks of bits. Two within the radius are within a share of it in some block (`shares`), so a
table for each block holds every fingerprint under that block's bits, and a query asks for its own bits and all within the share of them.
A pair counts in the first table that has it. Equal fingerprints are one row there.

Successors: rows are sorted by descending id (null last; equal ids by text) in ranges, neighbours are paired inside a range, and the ends
of the ranges, two rows for each, are joined afterwards; the last row's successor is the first. Null and empty texts have no terms and the
fingerprint zero. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.texts import Block, block_of, blocks, chain, keys_of, mix, per_text
from lodeframe.session import cut

#: Of copies with a Jaccard likeness of 0.85 over 5-word shingles, most are within RADIUS; the README has the measured shares.
WIDTH, RADIUS, BLOCKS = 128, 12, 6
PIECE = 1 << 14


def fingerprints(block: Block) -> np.ndarray:
    """Two 64-bit halves for each text."""
    starts, ends = block.words()
    owner = block.owners(starts)
    key = keys_of(block.data, starts, ends)
    count = np.bincount(owner, minlength=len(block))
    inside = owner[:-1] == owner[1:]
    single = np.flatnonzero(count == 1)
    first = (np.cumsum(count) - count)[single]
    text = np.concatenate([owner[:-1][inside], single])
    term = np.concatenate([chain(key[:-1], key[1:])[inside], key[first]])
    by = np.lexsort((term, text))
    text, term = text[by], term[by]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    weight = (1 + np.log2(np.diff(np.concatenate([at, [len(text)]])))).astype(np.float32)
    text, term = text[at], term[at]
    bounds = np.searchsorted(text, np.arange(len(block) + 1))
    halves = np.stack([mix(term), mix(term ^ np.uint64(0x9E3779B97F4A7C15))], axis=1)
    out = np.zeros((len(block), 2), np.uint64)
    for i in np.flatnonzero(np.diff(bounds)):
        votes = np.zeros(WIDTH)
        for a in range(bounds[i], bounds[i + 1], PIECE):
            b = min(a + PIECE, bounds[i + 1])
            bits = np.unpackbits(halves[a:b].view(np.uint8), axis=1)
            votes += 2 * (weight[a:b] @ bits.astype(np.float32)) - weight[a:b].sum()
        out[i] = np.packbits(votes > 0).view(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / WIDTH


def text_form(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def fingerprint(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the fingerprint's halves `high` and `low`."""

    def compute(block: Block) -> dict:
        found = fingerprints(block).view(np.int64)
        return {"high": found[:, 0], "low": found[:, 1]}

    return per_text(df, text, list(keep), [T.StructField(c, T.LongType()) for c in ("high", "low")], compute)


EDGES = [WIDTH * i // BLOCKS for i in range(BLOCKS + 1)]  # BLOCKS is even: no block lies in both halves


def _bits(high: Column, low: Column, block: int) -> Column:
    """A block of the fingerprint as a number."""
    a, b = EDGES[block], EDGES[block + 1]
    return F.shiftrightunsigned(F.shiftleft(high, a) if b <= 64 else F.shiftleft(low, a - 64), 64 - (b - a))


def shares(radius: int) -> list[int]:
    """The distance to search each block to; -1 is not at all. Fingerprints farther apart in each block differ in more than `radius` bits."""
    least, rest = divmod(radius, BLOCKS)
    return [least if i <= rest else least - 1 for i in range(BLOCKS)]


def neighbours(data: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """high, low of each distinct query with the rows (high, low) of `data` within the radius: `n_near`, equal ones included."""
    within = {i: r for i, r in enumerate(shares(radius)) if r >= 0}

    def table(df: DataFrame, name: str, keys_of_block) -> DataFrame:
        entry = lambda i: lambda k: F.shiftleft(k, 8) + F.lit(i)
        entries = F.concat(*(F.transform(keys_of_block(i), entry(i)) for i in within))
        return df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns), F.explode(entries).alias(f"{name}_at"))

    def own(i: int) -> Column:
        return F.array(_bits(F.col("high"), F.col("low"), i))

    def around(i: int) -> Column:
        masks = [sum(1 << k for k in c) for n in range(within[i] + 1) for c in combinations(range(EDGES[i + 1] - EDGES[i]), n)]
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: _bits(F.col("high"), F.col("low"), i).bitwiseXOR(m))

    d = table(data.groupBy("high", "low").agg(F.count("*").alias("n")), "d", own)
    q = table(queries.select("high", "low").distinct(), "q", around)
    high, low = F.col("q_high").bitwiseXOR(F.col("d_high")), F.col("q_low").bitwiseXOR(F.col("d_low"))
    earlier = F.lit(False)
    for i, r in within.items():
        earlier = earlier | ((F.col("q_at").bitwiseAND(255) > i) & (F.bit_count(_bits(high, low, i)) <= r))
    # Spark takes the exploded rows for as few as there were before, so without the hint it sends them whole to the driver and every task.
    found = q.hint("merge").join(d, (F.col("q_at") == F.col("d_at")) & (F.bit_count(high) + F.bit_count(low) <= radius) & ~earlier)
    return found.groupBy(F.col("q_high").alias("high"), F.col("q_low").alias("low")).agg(F.sum("d_n").alias("n_near"))


def edited(texts: list[str], after: list[str]) -> list[str]:
    """Each text with its last half (rounded down) replaced by as many first characters of the next, or all it has."""
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]


_EDGE = "kind int, part long, id {}, n_chars long, high long, low long, sha string, edited_high long, edited_low long, near_edited double, near_next double, text string"


def _compared(texts: list[str], after: list[str], own: np.ndarray, next_own: np.ndarray) -> dict:
    changed = edited(texts, after)
    of_changed = fingerprints(block_of(changed)) if changed else np.zeros((0, 2), np.uint64)
    return {
        "sha": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()), "edited_high": of_changed[:, 0].view(np.int64), "edited_low": of_changed[:, 1].view(np.int64),
        "near_edited": likeness(own, of_changed), "near_next": likeness(own, next_own),
    }


def with_successors(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: id, n_chars, high, low, sha and fingerprint of its edited text, and its likeness to that and to the next row's text."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = (F.col("id").desc_nulls_last(), F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _EDGE.format(df.schema[id_col].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(columns: dict, n: int, ids: pa.Array) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "sha": pa.string(), "text": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
        return pa.RecordBatch.from_arrays([ids if c == "id" else x if isinstance(x := columns.get(c), pa.Array) else pa.nulls(n, kinds.get(c, pa.int64())) if x is None else pa.array(x, kinds.get(c, pa.int64())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        edge = lambda kind, x: batch_of({"kind": [kind], "part": [part], "n_chars": [len(x[1])], "high": x[2][:, 0].view(np.int64), "low": x[2][:, 1].view(np.int64), "text": [x[1]]}, 1, x[0])
        for batch in batches:
            for at, to, block in blocks(batch.column(1)):
                ids, own = batch.column(0).slice(at, to - at), fingerprints(block)
                texts = [block.text(i) for i in range(len(block))]
                if held is None:
                    yield edge(2, (ids.slice(0, 1), texts[0], own[:1]))
                else:
                    ids, texts, own = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.concatenate([held[2], own])
                n = len(texts) - 1
                held = ids.slice(n, 1), texts[n], own[n:]
                if n:
                    made = _compared(texts[:n], texts[1:], own[:n], own[1:])
                    yield batch_of({"kind": [0] * n, "part": [part] * n, "n_chars": [len(x) for x in texts[:n]], "high": own[:n, 0].view(np.int64), "low": own[:n, 1].view(np.int64)} | made, n, ids.slice(0, n))
        if held is not None:
            yield edge(1, held)

    written = cut(ranged.mapInArrow(run, schema))
    parts = sorted(r.part for r in written.where("kind = 2").select("part").collect())  # one number for each range
    links = df.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, then long")
    heads = written.where("kind = 2").select(F.col("part").alias("then"), F.col("text").alias("next_text"), F.col("high").alias("next_high"), F.col("low").alias("next_low"))
    ends = written.where("kind = 1").join(links, "part").join(heads, "then").select(*names, "next_text", "next_high", "next_low")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = lambda a, b: np.stack([batch.column(c).to_numpy().view(np.uint64) for c in (a, b)], axis=1)
            made = _compared(batch.column("text").to_pylist(), batch.column("next_text").to_pylist(), pair("high", "low"), pair("next_high", "next_low"))
            yield batch_of({c: batch.column(c) for c in ("kind", "part", "n_chars", "high", "low")} | made, len(batch), batch.column("id"))

    done = written.where("kind = 0").union(ends.mapInArrow(finish, schema))
    return done.select(F.col("id").alias(id_col), *(c for c in names if c not in ("kind", "part", "id", "text")))
