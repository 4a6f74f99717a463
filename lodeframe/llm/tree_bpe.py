"""Byte-level BPE over whole texts, equal to encoding them with the tokenizers library, and its inverse.

A text may be cut before white space that follows something else: the pre-tokenizer never joins across that place and looks no further
back. Between such cuts lie units, a word with the white space before it. A block's distinct units are encoded once, side by side, and
their ids are laid out in the order of the texts.

A unit that holds a pre-token of more than `LEAF` bytes (unsplit text) is done by tree concatenation: the pre-token is halved down to leaves,
leaves are encoded on their own, and at each join a window of tokens around it is encoded again. If the window's first and last tokens
come out as they were, every pair of neighbours in the result is one that the encoder itself puts side by side, and a sequence of which
that holds is the encoding; otherwise the window grows. Texts with a unit of more than `SPREAD` characters have their leaves dealt over all
tasks; only the joins meet again.

The model file is a parameter. Its special tokens are recognised in texts, as the library does by default. Null and empty texts have no ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.texts import SPACES, Block, blocks, keys_of, per_text, spread

LEAF, SPREAD = 4096, 1 << 20
#: Fixed: the pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed: what \s means there; Python's has more.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """A byte-level BPE file, given by its content."""

    def __init__(self, content: str):
        file = json.loads(content)
        if file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or file["normalizer"] or file["post_processor"]:
            raise ValueError("only byte-level BPE files without normalizer and template are supported")
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        made = [file["model"]["vocab"]["".join(m)] for m in merges]
        if any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError("the file's merges are not in the order of their ids")
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        pieces = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.top = max(pieces) + 1
        self.sizes = np.array([len(pieces.get(i, b"")) for i in range(self.top)])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(self.top)), np.uint8)
        self.pattern = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.white = regex.compile(f"[{WHITE}]+")
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def piece(self, data: bytes) -> list[int]:
        """BPE of bytes that are not split further."""
        return self.encoding._core_bpe.encode_single_piece(data) if data else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of one pre-token from their own encodings."""
        n = 4
        while True:
            a, b = left[max(0, len(left) - n) :], right[:n]
            again = self.piece(self.back(np.array(a + b)))
            fits_left = len(a) == len(left) or again[0] == a[0]
            fits_right = len(b) == len(right) or again[-1] == b[-1]
            if fits_left and fits_right:
                return left[: len(left) - len(a)] + again + right[len(b) :]
            n *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Joins the encodings of neighbouring leaves pair by pair until one is left."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def unsplit(self, data: bytes, leaf: int = LEAF) -> list[int]:
        return self.tree([self.piece(x) for x in halves(data, leaf)])

    def stretches(self, text: str, leaf: int = LEAF) -> Iterator[tuple[str, bool]]:
        """The text as runs of ordinary pre-tokens and special tokens, and single pre-tokens (flagged) of more than `leaf` bytes."""
        for part in self.cut.split(text) if self.cut else [text]:
            if not part:
                continue
            if part in self.special:
                yield part, False
                continue
            done = before = 0
            for m in self.pattern.finditer(part):
                if m.end() - m.start() > leaf // 4 and len(m[0].encode()) > leaf:
                    # White space in front of it would join the white space before that, were it the end of a text.
                    for x in (part[done:before], part[before : m.start()]) if before > done and self.white.fullmatch(part, before, m.start()) else (part[done : m.start()],):
                        if x:
                            yield x, False
                    yield m[0], True
                    done = m.end()
                before = m.start()
            if done < len(part):
                yield part[done:], False

    def long_unit(self, text: str, leaf: int = LEAF) -> np.ndarray:
        found = [np.array(self.unsplit(x.encode(), leaf), np.uint32) if giant else self.plain(x) for x, giant in self.stretches(text, leaf)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.back(ids).decode(errors="replace")

    def back(self, ids: np.ndarray) -> bytes:
        owner, place = spread(self.sizes[ids])
        return self.bytes[self.places[ids][owner] + place].tobytes()


def halves(data: bytes, leaf: int) -> list[bytes]:
    if len(data) <= leaf:
        return [data]
    middle = len(data) // 2
    return halves(data[:middle], leaf) + halves(data[middle:], leaf)


@lru_cache(maxsize=2)
def model_of(content: str) -> Model:
    return Model(content)


def _units(block: Block) -> np.ndarray:
    """Start of each unit: of each text, and of white space after something that can't be white space of any kind."""
    d = block.data
    space = SPACES[d]
    one, two, three = (np.concatenate([np.zeros(min(k, len(d)), np.uint8), d[: max(0, len(d) - k)]]) for k in (1, 2, 3))
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
    start = np.zeros(len(d) + 1, bool)
    start[:-1] = space & ~SPACES[one] & ~wide
    start[block.offsets] = True
    return np.flatnonzero(start[:-1])


def encode_block(block: Block, model: Model, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, end to end, and how many each has."""
    starts = _units(block)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(block), np.int64)
    ends = np.concatenate([starts[1:], [len(block.data)]])
    _, first, number = np.unique(keys_of(block.data, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first], ends[first]
    # Side by side go units that begin with white space and end with an ordinary character of one byte or of a letter's bytes.
    last = block.data[b - 1]
    wide = (last >= 0x80) & (last <= 0xAF)
    joined = SPACES[block.data[a]] & ~SPACES[last] & ~wide & (b - a <= leaf)
    some = np.flatnonzero(joined)
    flat, count, place_of = [], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    if len(some):
        owner, place = spread((b - a)[some])
        found = model.plain(block.data[a[some][owner] + place].tobytes().decode())
        ends_at = np.searchsorted(np.cumsum(model.sizes[found]), np.cumsum((b - a)[some])) + 1
        flat.append(found)
        place_of[some] = np.concatenate([[0], ends_at[:-1]])
        count[some] = ends_at - place_of[some]
    done = sum(map(len, flat))
    for i in np.flatnonzero(~joined):
        text = block.data[a[i] : b[i]].tobytes().decode()
        own = model.long_unit(text, leaf) if b[i] - a[i] > leaf else model.plain(text)
        flat.append(own)
        place_of[i], count[i] = done, len(own)
        done += len(own)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    owner, place = spread(count[number])
    per = np.add.reduceat(np.concatenate([count[number], [0]]), np.searchsorted(starts, block.offsets[:-1]))
    per[block.offsets[1:] == block.offsets[:-1]] = 0
    return flat[place_of[number][owner] + place].astype(np.uint32), per


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of values as one binary cell for each count."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(counts)]) * width
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


IDS = [T.StructField("ids", T.BinaryType())]


def as_ids(ids: np.ndarray, counts: np.ndarray, model: Model) -> dict:
    return {"ids": binary(ids, counts)}


def encode(
    df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fields: list[T.StructField] = IDS, finish: Callable[[np.ndarray, np.ndarray, Model], dict] = as_ids, leaf: int = LEAF, spread_from: int = SPREAD
) -> DataFrame:
    """The kept columns with `ids`: the text's token ids, little-endian unsigned 32-bit integers laid end to end.

    Other columns can be made where the ids are: `finish` gets the ids of some texts end to end, how many each has, and the model.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    # Only a text with a long stretch free of white space is dealt out.
    far = F.coalesce((F.length(F.col(f"`{text}`")) > spread_from) & F.col(f"`{text}`").rlike(rf"[^\x20\x09-\x0D]{{{spread_from},}}+"), F.lit(False))
    near = per_text(df.where(~far), text, list(keep), fields, lambda block, model: finish(*encode_block(block, model, leaf), model), prepare=lambda: model_of(content), size=2 << 20)
    keys = [f"k{i}" for i in range(len(keep))]
    rows = df.where(far).select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, keys)), F.col(f"`{text}`").alias("t"))
    rows = rows.groupBy(*keys, F.sha2("t", 256).alias("sha")).agg(F.count("*").alias("copies"), F.first("t").alias("t"))
    key_fields = [T.StructField(k, df.schema[c].dataType) for c, k in zip(keep, keys)] + [T.StructField("sha", T.StringType()), T.StructField("copies", T.LongType())]
    part_fields = [T.StructField("part", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("giant", T.BooleanType()), T.StructField("data", T.BinaryType())]
    n = len(key_fields)
    names = [f.name for f in (*key_fields, *part_fields)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(content)
        for batch in batches:
            for i in range(len(batch)):
                part, head = 0, batch.slice(i, 1).columns[:n]
                for number, (x, giant) in enumerate(model.stretches(batch.column(n)[i].as_py(), leaf)):
                    for piece in halves(x.encode(), leaf) if giant else [x.encode()]:
                        yield pa.RecordBatch.from_arrays([*head, pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([giant]), pa.array([piece], pa.binary())], names=names)
                        part += 1

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(content)
        for batch in batches:
            found = [np.array(model.piece(x), np.uint32).tobytes() if giant else model.plain(x.decode()).tobytes() for giant, x in zip(batch.column("giant").to_pylist(), batch.column("data").to_pylist())]
            yield batch.set_column(n + 3, "data", pa.array(found, pa.binary()))

    def meet(group: pa.Table) -> pa.Table:
        model = model_of(content)
        group = group.sort_by("part")
        stretch, giant = group.column("stretch").to_numpy(), group.column("giant").to_pylist()
        ids = [np.frombuffer(x, np.uint32) for x in group.column("data").to_pylist()]
        out, at = [], 0
        while at < len(ids):
            to = int(np.searchsorted(stretch, stretch[at], side="right"))
            out.append(np.array(model.tree([x.tolist() for x in ids[at:to]]), np.uint32) if giant[at] else ids[at])
            at = to
        whole = np.concatenate(out)
        made = finish(whole, np.array([len(whole)]), model)
        row = pa.table({k: group.column(k).slice(0, 1) for k in [*keys, "copies"]} | {f.name: made[f.name] for f in fields})
        return row.take(pa.array([0] * group.column("copies")[0].as_py())).drop_columns(["copies"])

    schema = T.StructType([*key_fields, *part_fields])
    parts = rows.select(*(f.name for f in key_fields), "t").mapInArrow(cut, schema)
    found = parts.repartition("sha", "part").mapInArrow(leaves, schema).groupBy(*keys, "sha").applyInArrow(meet, T.StructType([*key_fields[:-2], *fields]))
    return near.union(found)


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the text that `ids` stands for, special tokens included."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    source = df.select(*keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(content)
        for batch in batches:
            column = pc.fill_null(batch.column(len(keep)), b"").cast(pa.large_binary())
            for at, to, block in blocks(column.view(pa.large_string())):
                ids = np.frombuffer(block.data.tobytes(), np.uint32)
                texts = [model.decode(ids[a:b]) for a, b in zip(block.offsets[:-1] // 4, block.offsets[1:] // 4)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField("text", T.StringType())]))
