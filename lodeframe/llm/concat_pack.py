"""Concatenate and cut: token ids of all texts, laid end to end, in sequences of a fixed length.

First pass: the ids of every partition's texts are written to the shared folder and counted. Prefix sums over the counts, one number for
each partition, give every partition its place in the whole. Second pass: a partition goes on from its place, and each text's ids are cut
where a window of `LENGTH` ids ends; a piece is a record of its text, its place there, its sequence and its place in that. No row moves
between tasks, and only the last sequence can be short.

Each text ends with the id `END`, so that null and empty texts take one place. Repeated rows are packed as often as they occur. Sequences
follow the order in which partitions hold the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm import tree_bpe
from lodeframe.llm.texts import spread
from lodeframe.session import cut

LENGTH, END = 2048, 1


def narrow(ids: np.ndarray, counts: np.ndarray, model: tree_bpe.Model) -> dict:
    """Ids in two bytes each where the vocabulary allows it."""
    return {"ids": tree_bpe.binary(ids.astype(np.uint16 if model.top <= 1 << 16 else np.uint32), counts), "n": counts.astype(np.int64)}


def pieces(written: DataFrame, id_col: str, length: int, end: int, with_ids: bool) -> DataFrame:
    """Cuts the rows (id, ids, n), which must come in the same partitions and order each time."""
    totals = {r.part: r.n for r in written.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.col("n") + 1).alias("n")).collect()}  # a number for each partition
    sizes = np.zeros(max(totals, default=-1) + 1, np.int64)
    sizes[list(totals)] = list(totals.values())
    before = np.cumsum(sizes) - sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            if done is None:
                done = int(before[TaskContext.get().partitionId()])
            n = batch.column(2).to_numpy() + 1
            whole = done + np.cumsum(n) - n
            done += int(n.sum())
            first, last = whole // length, (whole + n - 1) // length
            row, k = spread(last - first + 1)
            start = np.maximum(whole[row], (first[row] + k) * length) - whole[row]
            stop = np.minimum(n[row], (first[row] + k + 1) * length - whole[row])
            crc, own = [], []
            ids, held = None, -1
            for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist()):
                if r != held:
                    raw, held = batch.column(1)[r].as_buffer(), r
                    ids = np.frombuffer(raw, np.uint16 if raw.size == 2 * (n[r] - 1) else np.uint32).astype(np.uint32)
                    ids = np.append(ids, np.uint32(end))
                data = ids[a:b].tobytes()
                crc.append(zlib.crc32(data))
                own.append(data if with_ids else None)
            columns = {"id": batch.column(0).take(pa.array(row)), "start": start, "length": stop - start, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": n[row], "sequence_id": first[row] + k, "offset": whole[row] + start - (first[row] + k) * length}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) if isinstance(v, np.ndarray) else v for c, v in columns.items()} | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))

    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    more = [T.StructField("ids", T.BinaryType())] if with_ids else []
    return written.mapInArrow(run, T.StructType([T.StructField("id", written.schema["id"].dataType), *longs, *more])).withColumnRenamed("id", id_col)


def pack(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, its ids (32 bits each)."""
    tokens = tree_bpe.encode(df, path, text, (id_col,), [*tree_bpe.IDS, T.StructField("n", T.LongType())], narrow)
    return pieces(cut(tokens.withColumnRenamed(id_col, "id")), id_col, length, end, with_ids)
