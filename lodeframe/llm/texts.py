"""Whole texts as flat byte arrays inside Arrow batches: words, lines and their 64-bit keys without a Python object for each word.

A word is a run of bytes other than space and \\t-\\r, so it never crosses a character of more than one byte. A key is a polynomial of
the word's bytes modulo 2^64, mixed with its length; two different words share one with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts worked on at once; the smaller size where a worker goes on to other work and memory counts.
BLOCK, SMALL = 4 << 20, 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 1024, 2 * len(_powers))
        factors = np.full(size, _BASE, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit key over all its bits; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of a sequence from the key of its beginning and that of its last member."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key for each of the byte ranges, which lie in order and apart."""
    lens = ends - starts
    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(lens > 0)
    if len(some):
        n = lens[some]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        values = data[place + np.repeat(starts[some], n)].astype(np.uint64)
        values += np.uint64(1)
        values *= powers(int(n.max()))[place]
        out[some] = np.add.reduceat(values, first)
    return mix(out + lens.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class Block:
    """Some whole texts: `data` holds their bytes, text i those from offsets[i] to offsets[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()

    def lower(self) -> Block:
        return Block(LOWER[self.data], self.offsets)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of flagged bytes; no run crosses texts."""
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SPACES[self.data])

    def owners(self, starts: np.ndarray) -> np.ndarray:
        """The text that each of the sorted positions lies in."""
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def code_points(self) -> np.ndarray:
        """Number of the code point that starts at or after each byte, counted through the block."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])


def block_of(texts: list[str | None]) -> Block:
    return next(blocks(pa.array(texts, pa.string()), 1 << 40), (0, 0, Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))))[2]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, Block]]:
    """Cuts a column of texts into runs of rows of at most `size` bytes, or one row if that is longer; null is an empty text."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def per_text(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], compute: Callable[..., dict], prepare: Callable | None = None, size: int = BLOCK) -> DataFrame:
    """The columns `keep` and what `compute` finds for each text. `prepare`, if given, runs once in each task and its value is handed on."""
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    arrow = _arrow(T.StructType(fields))
    source = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = [prepare()] if prepare else []
        for batch in batches:
            for at, to, block in blocks(batch.column(len(keep)), size):
                found = compute(block, *more)
                kept = [batch.column(i).slice(at, to - at) for i in range(len(keep))]
                made = [x if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *(f.name for f in arrow)])

    return source.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, judge: Callable[[Block], np.ndarray], prepare: Callable | None = None, size: int = SMALL) -> DataFrame:
    """The rows, with all their columns, whose text `judge` says yes to."""
    at_text = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = [prepare()] if prepare else []
        for batch in batches:
            for at, to, block in blocks(batch.column(at_text), size):
                yield batch.slice(at, to - at).filter(pa.array(judge(block, *more), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Values, in order, as one list for each count."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths laid end to end: the list of each place, and the place inside its list."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
