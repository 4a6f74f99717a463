"""Long repeats over a whole corpus, removed byte by byte, with run-length compressed Burrows-Wheeler indexes.

A byte goes if a string of `LONG` bytes that covers it also starts anywhere else, in the same text or another. Texts are UTF-8 bytes; matches
never cross texts, and all strings are judged on the input.

**The index.** A text's suffixes in order give the characters before them: the Burrows-Wheeler transform, whose runs are few where the text
repeats itself. At the two ends of each run it keeps a sample: the suffix's place in the text and how far it agrees with its neighbour
across the end. Inside a run, going one place to the left in the text keeps both neighbours and adds one to what is shared, so that
one stream over the text from sample to sample gives the matching statistics of every place: the length of the longest string from there
that also starts elsewhere.

**Which parts meet.** Of the `GRAM`-byte strings in each `LONG`-byte window the one with the least hash is an anchor; equal windows choose
equal anchors. A context is an anchor with the bytes around it that a window can reach, so that equal windows lie in contexts of equal
anchors. Corpora repeat themselves, and so do contexts: those with the same bytes are one entry of the collection, kept once, with the number
of its places; all its windows repeat if that is two or more. Entries of anchors that occur once are dropped. The others go to buckets
by anchor; a bucket joins contexts that overlap in their text, so that no place is in it twice, builds an index over them and marks
the places whose statistic reaches `LONG`.

Texts are packed into blocks of about `BLOCK_BYTES`, written to the shared folder, which fixes their numbers; anchors are counted once per
block before they are shuffled. An anchor with more than `MOST` different contexts (a common line) is split by the windows that contain it: those
that start in the first half of the possible places share more bytes on the right, the others on the left, so contexts meet only those that
share these bytes, half by half down to one window; then all bytes of the window are shared and nothing is left to compare.

Hashes have 64 bits; contexts are taken for equal if both their anchor's and their own hash agree, matches inside buckets compare bytes.
Null texts are empty, empty and short texts stay as they are. Rows that repeat are texts of their own, so that copies of `LONG` bytes
or more vanish wholly. A text that is longer than a block is a block of its own, for which a task needs about 60 times its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeframe.llm.texts import _BASE, blocks, mix, powers
from lodeframe.session import cut, shared_dir

LONG, GRAM = 200, 100
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
MOST = 20_000
_INVERSE = pow(_BASE, -1, 1 << 64)
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        factors = np.full(max(n, 1024, 2 * len(_inverses)), _INVERSE, np.uint64)
        factors[0] = 1
        _inverses = np.multiply.accumulate(factors)
    return _inverses[:n]


class Hashes:
    """Hashes of any byte ranges of some data."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), dtype=np.uint64)])
        self.back = inverses(len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def grams(self, size: int) -> np.ndarray:
        """Of the `size` bytes from every place on."""
        return mix((self.sums[size:] - self.sums[: len(self.sums) - size]) * self.back[: len(self.sums) - size])


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """`op` over every `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        x = op(x[: len(x) - reach], x[reach:])
        reach *= 2
    rest = width - reach
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, long: int, gram: int) -> np.ndarray:
    """Places of the grams that have the least hash of some window; those without any window in one text don't matter."""
    width = long - gram + 1
    if len(data) < long:
        return np.zeros(0, np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    first = np.repeat(offsets[:-1], np.diff(offsets))
    hashes = Hashes(data).grams(gram)
    n = len(hashes)
    outside = (np.arange(n) + gram > ends[:n]) | (ends[:n] - first[:n] < long)
    top = np.uint64(2**64 - 1)
    hashes[outside] = top
    least = sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((sliding(np.concatenate([edge, least, edge]), width, np.maximum) == hashes) & ~outside)


class Entries:
    """The contexts of a block's anchors; those with equal bytes are one entry."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, places: np.ndarray, long: int, gram: int):
        self.text = np.searchsorted(offsets, places, side="right") - 1
        begin, end = offsets[self.text], offsets[self.text + 1]
        left, right = np.minimum(places - begin, long - gram), np.minimum(end - places - gram, long - gram)
        self.start, self.end, self.at = places - left, places + gram + right, left
        hashes = Hashes(data)
        anchor, whole = hashes.of(places, places + gram), hashes.of(self.start, self.end)
        whole = mix(whole + (left * 2 * long + right).astype(np.uint64))
        by = np.lexsort((whole, anchor))
        new = np.concatenate([[True], (anchor[by][1:] != anchor[by][:-1]) | (whole[by][1:] != whole[by][:-1])]) if len(by) else np.zeros(0, bool)
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.one = by[new]
        self.anchor, self.whole = anchor[self.one], whole[self.one]
        self.count = np.bincount(self.entry, minlength=len(self.one))


class RunIndex:
    """A run-compressed Burrows-Wheeler transform over stretches of bytes, each with an end mark of its own, with samples at the ends of runs."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        self.data, self.n = data, len(data)
        sizes = np.diff(np.concatenate([begins, [self.n]]))
        self.stretch, self.stop = np.repeat(np.arange(len(begins)), sizes), np.repeat(begins + sizes, sizes)
        self._words = np.ndarray((self.n,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
        order = self._order(len(begins))
        before = np.concatenate([[0], data[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        before[begins] = 256 + np.arange(len(begins))
        transform = before[order]
        change = np.flatnonzero(transform[1:] != transform[:-1]) + 1
        self.heads = np.concatenate([[0], change]) if self.n else change
        self.tails = np.concatenate([change - 1, [self.n - 1]]) if self.n else change
        self.symbols, self.lengths = transform[self.heads], self.tails - self.heads + 1
        shared = np.concatenate([[0], self.common(order[change], order[change - 1]), [0]]) if self.n else change
        self.head_sample, self.head_shared = order[self.heads], shared[:-1]
        self.tail_sample, self.tail_shared = order[self.tails], shared[1:]

    def _order(self, stretches: int) -> np.ndarray:
        """Suffixes in order, by ranks of prefixes of 7, 14, 28, ... bytes; only ties are sorted on."""
        n, place = self.n, np.arange(self.n)
        key = np.zeros(n, np.uint64)
        padded = np.concatenate([self.data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
        for i in range(7):
            key = key * np.uint64(257) + np.where(place + i < self.stop, padded[i : i + n], np.uint64(0))
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else place
        sizes = np.diff(np.concatenate([heads, [n]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(heads, sizes)
        active, reach = order[np.repeat(sizes > 1, sizes)], 7
        while len(active):
            ahead = active + reach
            second = np.where(ahead < self.stop[active], rank[np.minimum(ahead, n - 1)] + stretches, self.stretch[active])
            base = rank[active]
            by = np.argsort(base * (n + stretches + 1) + second)
            active, base, second = active[by], base[by], second[by]
            other = np.concatenate([[True], base[1:] != base[:-1]])
            new = other | np.concatenate([[True], second[1:] != second[:-1]])
            at = np.arange(len(active))
            head = np.maximum.accumulate(np.where(new, at, 0))
            rank[active] = base + head - np.maximum.accumulate(np.where(other, at, 0))
            size = np.diff(np.concatenate([np.flatnonzero(new), [len(active)]]))
            active = active[np.repeat(size > 1, size)]
            reach *= 2
        order[rank] = place
        return order

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes from x and y on share."""
        most = np.minimum(self.stop[x] - x, self.stop[y] - y)
        found = np.zeros(len(x), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            at = found[live]
            differ = self._words[x[live] + at] ^ self._words[y[live] + at]
            low = (differ & (~differ + np.uint64(1))).astype(np.float64)
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) >> 3)
            found[live] = np.minimum(at + same, most[live])
            live = live[(same == 8) & (found[live] < most[live])]
        return found

    def statistics(self) -> np.ndarray:
        """For every place, the length of the longest string from there that also starts elsewhere, streamed from sample to sample."""
        out = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for sample, shared in ((self.head_sample, self.head_shared), (self.tail_sample, self.tail_shared)):
            known = np.zeros(self.n, np.int64)
            known[sample] = sample  # the first place of a stretch always is one: its character before is an end mark
            last = np.maximum.accumulate(known)
            length = np.zeros(self.n, np.int64)
            length[sample] = shared
            np.maximum(out, length[last] - (place - last), out=out)
        return out


def _compress(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 3)


def _expand(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def packed(df: DataFrame, text: str, id_col: str, long: int, gram: int) -> DataFrame:
    """Blocks of texts (block, ids, data, offsets, places of anchors), written, so that their numbers stay."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, to, block in blocks(batch.column(1), BLOCK_BYTES):
                ids = pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at)], ["id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as out:
                    out.write_batch(ids)
                places = anchors(block.data, block.offsets, long, gram)
                fields = [zstandard.compress(sink.getvalue().to_pybytes(), 1), _compress(block.data), _compress(np.diff(block.offsets)), _compress(np.diff(places, prepend=0).astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in fields)], names=["block", "ids", "data", "sizes", "places"])
                number += 1

    return cut(rows.mapInArrow(run, "block long, ids binary, data binary, sizes binary, places binary"))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = _expand(row["sizes"], np.int64)
    return _expand(row["data"], np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), np.cumsum(_expand(row["places"], np.uint32), dtype=np.int64)


def counted(packs: DataFrame, long: int, gram: int) -> DataFrame:
    """Entries worth looking at: (block, entry, twice: it has two places or more, asked: its context must meet others, anchor, kin: how many must)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                e = Entries(*_unpacked(row), long, gram)
                n = len(e.one)
                yield pa.RecordBatch.from_arrays([pa.array(e.anchor.view(np.int64)), pa.array(e.whole.view(np.int64)), pa.array(np.full(n, row["block"], np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(e.count.astype(np.int32))], names=["anchor", "whole", "block", "entry", "n"])

    found = packs.mapInArrow(run, "anchor long, whole long, block long, entry int, n int").repartition("anchor")
    same, near = Window.partitionBy("anchor", "whole"), Window.partitionBy("anchor")
    found = found.withColumns({"places": F.sum("n").over(same), "first": F.row_number().over(same.orderBy("block", "entry")) == 1})
    found = found.withColumns({"all": F.sum("n").over(near), "lone": F.max(F.col("places") == 1).over(near)}).where("all > 1")
    found = found.withColumn("asked", F.col("lone") & F.col("first")).withColumn("kin", F.sum(F.col("asked").cast("int")).over(near))
    return found.select("block", "entry", (F.col("places") > 1).alias("twice"), "asked", F.when(F.col("asked"), F.col("anchor")).alias("anchor"), F.col("kin").cast("int").alias("kin")).where("twice or asked")


CONTEXT = "g long, block long, text int, start int, at int, twice boolean, kin int, data binary"


def contexts(packs: DataFrame, flags: DataFrame, long: int, gram: int) -> DataFrame:
    """The bytes of the entries that are asked for."""

    def run(pack: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("g", pa.int64()), ("block", pa.int64()), ("text", pa.int32()), ("start", pa.int32()), ("at", pa.int32()), ("twice", pa.bool_()), ("kin", pa.int32()), ("data", pa.binary())])
        if not len(pack) or not len(asked):
            return schema.empty_table()
        data, offsets, places = _unpacked(row := pack.to_pylist()[0])
        e = Entries(data, offsets, places, long, gram)
        asked = asked.filter(asked.column("asked"))
        one = e.one[asked.column("entry").to_numpy()]
        start, end, text = e.start[one], e.end[one], e.text[one]
        raw = data.tobytes()
        return pa.table([asked.column("anchor"), pa.array(np.full(len(one), row["block"], np.int64)), pa.array(text.astype(np.int32)), pa.array((start - offsets[text]).astype(np.int32)), pa.array(e.at[one].astype(np.int32)), asked.column("twice"), asked.column("kin"), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())], schema=schema)

    return packs.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(run, CONTEXT)


def divided(found: DataFrame, most: int, long: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts whose groups (g) are of bounded size, and the windows (block, text, start, end) of groups that share all bytes of one window."""
    reach = long - gram
    rest, hot, ready = found.where(F.col("kin") <= most), cut(found.where(F.col("kin") > most).withColumns({"lo": F.lit(0), "hi": F.lit(reach + 1)})), None
    while not hot.isEmpty():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = hot.withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi"))))).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half")
        length = F.col("lo") + gram + reach - F.col("hi") + 1
        halves = halves.where((F.col("at") >= F.col("lo")) & (F.octet_length("data") - F.col("at") + F.col("lo") >= length))
        halves = halves.withColumn("g", F.xxhash64("g", "lo", "hi", F.substring(F.col("data"), F.col("at") - F.col("lo") + 1, length)))
        sizes = halves.groupBy("g").agg(F.count("*").cast("int").alias("kin"), F.max(~F.col("twice")).alias("open")).where("kin > 1 and open").select("g", "kin")
        halves = cut(halves.drop("kin").join(sizes, "g").select(*hot.columns))
        one = (F.col("hi") - F.col("lo") == 1) & (F.col("kin") > most)
        windows = halves.where(one).select("block", "text", (F.col("start") + F.col("at") - F.col("lo")).cast("int").alias("start"), (F.col("start") + F.col("at") - F.col("lo") + long).cast("int").alias("end"))
        ready = windows if ready is None else ready.union(windows)
        rest = rest.union(halves.where(F.col("kin") <= most).drop("lo", "hi"))
        hot = halves.where((F.col("kin") > most) & ~one)
    return rest, ready


def joined(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Stretches (data, where each begins, its block, text, start, twice): contexts that occur once are joined where they overlap in their text."""
    block, text, start, twice = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("block", "text", "start", "twice"))
    raw = rows.column("data").combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    where = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    size = np.diff(where)
    start = start.astype(np.int64)
    by = np.lexsort((size, start, text, block, twice))
    block, text, start, twice, size, where = block[by], text[by], start[by], twice[by], size[by], where[:-1][by]
    _, owner = np.unique(np.stack([twice.astype(np.int64), block, text.astype(np.int64)]), axis=1, return_inverse=True)
    owner = np.cumsum(np.concatenate([[0], owner.ravel()[1:] != owner.ravel()[:-1]]))
    owner = np.where(twice, np.arange(len(by)) + len(by), owner)  # those with more places stand for themselves
    far = int((start + size).max()) + 1
    reached = np.concatenate([[-1], np.maximum.accumulate(owner * far + start + size)[:-1]]) - owner * far  # the end of what came before in the text
    new = reached < start
    skip = np.where(new, 0, np.minimum(reached - start, size))
    kept = size - skip
    first = np.cumsum(kept) - kept
    out = data[np.repeat(where + skip - first, kept) + np.arange(kept.sum())]
    return out, first[new], block[new], text[new], start[new], twice[new]


def _marks(rows: pa.Table, long: int) -> pa.Table:
    """Windows of a bucket's contexts that also start elsewhere, united, as (block, text, start, end)."""
    data, begins, block, text, start, twice = joined(rows)
    index = RunIndex(data, begins)
    found = np.flatnonzero((index.statistics() >= long) & ~twice[index.stretch])
    own = index.stretch[found]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (found[1:] > found[:-1] + long)]) if len(found) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.concatenate([head[1:] - 1, [len(found) - 1]]) if len(found) else head
    shift = start[own[head]] - begins[own[head]]
    return pa.table({"block": pa.array(block[own[head]], pa.int64()), "text": pa.array(text[own[head]], pa.int32()), "start": pa.array((found[head] + shift).astype(np.int32)), "end": pa.array((found[last] + long + shift).astype(np.int32))})


def remove(df: DataFrame, finish, fields: list[T.StructField], text: str = "text", id_col: str = "doc_id", long: int = LONG, gram: int | None = None, most: int = MOST) -> DataFrame:
    """For each row its id, n_bytes, n_removed, n_spans and what `finish` (the kept bytes as a buffer -> values) makes of the rest."""
    spark, gram = df.sparkSession, gram or max(1, long // 2)
    packs = packed(df, text, id_col, long, gram)
    folder = f"{shared_dir(spark).rstrip('/')}/repeats-{uuid.uuid4().hex}"
    counted(packs, long, gram).write.parquet(f"{folder}/flags")
    flags = spark.read.schema("block long, entry int, twice boolean, asked boolean, anchor long, kin int").parquet(f"{folder}/flags")
    contexts(packs, flags, long, gram).write.option("compression", "zstd").parquet(f"{folder}/contexts")
    met, ready = divided(spark.read.schema(CONTEXT).parquet(f"{folder}/contexts"), most, long, gram)
    buckets = 1 + flags.where("asked").count() * (2 * long - gram) // BUCKET_BYTES
    spans = met.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda rows: _marks(rows, long), "block long, text int, start int, end int")
    if ready is not None:
        spans = spans.union(ready)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    marks = flags.where("twice").select("block", "entry", none("text", "int"), none("start", "int"), none("end", "int")).union(spans.select("block", none("entry", "int"), "text", "start", "end"))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), *fields])
    arrow = to_arrow_schema(schema)

    def run(pack: pa.Table, marked: pa.Table) -> pa.Table:
        if not len(pack):
            return arrow.empty_table()
        data, offsets, places = _unpacked(row := pack.to_pylist()[0])
        step = np.zeros(len(data) + 1, np.int64)
        entry = marked.column("entry").drop_null().to_numpy()
        if len(entry):
            e = Entries(data, offsets, places, long, gram)
            some = np.isin(e.entry, entry)
            np.add.at(step, e.start[some], 1)
            np.add.at(step, e.end[some], -1)
        own = marked.filter(marked.column("text").is_valid())
        base = offsets[own.column("text").to_numpy()]
        np.add.at(step, base + own.column("start").to_numpy(), 1)
        np.add.at(step, base + own.column("end").to_numpy(), -1)
        gone = np.cumsum(step[:-1]) > 0
        total = lambda flags_: np.concatenate([[0], np.cumsum(flags_)])
        cut_ = np.zeros(len(data) + 1, bool)
        cut_[offsets] = True
        begins = gone & (cut_[:-1] | ~np.concatenate([[False], gone[:-1]])) if len(data) else gone
        removed, spans_ = (total(x)[offsets[1:]] - total(x)[offsets[:-1]] for x in (gone, begins))
        kept, to = data[~gone], total(~gone)[offsets]
        ids = pa.ipc.open_stream(zstandard.decompress(row["ids"])).read_all().column("id")
        rest = [finish(kept[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
        more = [pa.array([x[i] for x in rest], f.type) for i, f in enumerate(list(arrow)[4:])]
        return pa.table([ids, pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans_), *more], schema=arrow)

    return packs.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("id", id_col)


def kept_digest(kept: np.ndarray) -> tuple[str]:
    return (sha256(kept.tobytes()).hexdigest(),)


def digests(df: DataFrame, text: str = "text", id_col: str = "doc_id", long: int = LONG, gram: int | None = None, most: int = MOST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove(df, kept_digest, [T.StructField("kept_sha256", T.StringType())], text, id_col, long, gram, most)


def kept_bytes(df: DataFrame, text: str = "text", id_col: str = "doc_id", long: int = LONG, gram: int | None = None, most: int = MOST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the remaining bytes, which may begin or end inside a character."""
    return remove(df, lambda kept: (kept.tobytes(),), [T.StructField("kept", T.BinaryType())], text, id_col, long, gram, most)
