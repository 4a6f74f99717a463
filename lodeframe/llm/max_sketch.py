"""Ranked lexical search with hashed max-sketches.

A term is a run of ASCII letters and digits and characters above ASCII, with A-Z lower-cased. With N documents that hold a term, L terms
in all, n in one document, df documents that hold a term and tf its occurrences, in whole numbers:

    weight  w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    length  m = 25 + (75 n N) div L
    impact    = (10^9 tf) div (1000 tf + 8 m)

and a document's score is the sum of w * impact over the query's terms, repeats included.

Within a document the impact grows with tf alone, so its sketch keeps, for each of `WIDTH` coordinates, the largest tf of the terms hashed
to it: the impact of that is at least the impact of every one of those terms. A batch of queries is a matrix of weights over the
coordinates; one product with the sketches of a block of documents bounds all scores from above. Then, query by query, documents are
scored exactly in descending order of their bounds, until the bound falls below the k-th best score so far. The k best are carried on from
block to block, so that later blocks start with a threshold, and each task hands on k rows a query.

Documents are read twice for each batch of queries: for N, L and df, and to search. Queries come to the driver and to the tasks in batches
of about `BATCH_BYTES` of text, whatever their number. Terms are compared by 64-bit keys.

Null and empty texts, and texts without terms, have no score and are not found; a query without terms finds nothing. Rows that repeat
are documents, and queries, of their own. Equal scores come by ascending id, null ids last. Weights are never below 0 (df is N at most),
and a score of 0 is no find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.texts import Block, block_of, blocks, keys_of, mix

TOP, WIDTH, STEP, ROWS = 10, 4096, 16, 1024
BLOCK_BYTES, BATCH_BYTES = 2 << 20, 256 << 10
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The text and the key of every term of a block, in order."""
    low = block.lower()
    starts, ends = low.runs(INSIDE[low.data])
    return low.owners(starts), keys_of(low.data, starts, ends)


def postings(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each text; text, key and tf of each distinct term of a text, by text and key)."""
    owner, key = terms(block)
    by = np.lexsort((key, owner))
    owner, key = owner[by], key[by]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    return np.bincount(owner, minlength=len(block)), owner[new], key[new], np.diff(np.concatenate([new, [len(key)]]))


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * length, 1)


class Batch:
    """Some queries: their distinct terms, how often each has each, and with the corpus figures the weights."""

    def __init__(self, texts: list[str | None]):
        owner, key = terms(block_of(texts))
        self.n = len(texts)
        self.keys, number = np.unique(key, return_inverse=True)
        self.count = np.zeros((self.n, len(self.keys)), np.int64)
        np.add.at(self.count, (owner, number), 1)

    def weigh(self, documents: int, tokens: int, df: np.ndarray, width: int) -> None:
        self.documents, self.tokens, self.width = documents, tokens, width
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.weight = self.count * weight
        at = (mix(self.keys) % np.uint64(width)).astype(np.int64)
        self.coordinates, number = np.unique(at, return_inverse=True)
        folded = np.zeros((len(self.coordinates), self.n))
        np.add.at(folded, number, self.weight.T)
        self.folded = folded  # below 2^53, so that sums of products are exact
        self.column = np.full(width, -1, np.int64)
        self.column[self.coordinates] = np.arange(len(self.coordinates))

    def held(self, block: Block) -> tuple[int, int, np.ndarray]:
        """Of a block: documents with a term, terms, and documents that hold each of the batch's terms."""
        n, _, key, _ = postings(block)
        at = np.searchsorted(self.keys, key)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), bool)
        return int((n > 0).sum()), int(n.sum()), np.bincount(at[known], minlength=len(self.keys))


class Documents:
    """A block of documents: sketches, bounds and exact scores for a batch."""

    def __init__(self, block: Block, batch: Batch):
        self.batch = batch
        n, owner, key, tf = postings(block)
        self.length = 25 + (75 * n * batch.documents) // max(batch.tokens, 1)
        column = batch.column[(mix(key) % np.uint64(batch.width)).astype(np.int64)]
        asked = column >= 0
        owner_, column, tf_ = owner[asked], column[asked], tf[asked]
        self.bounds = np.zeros((len(block), batch.n))
        for at in range(0, len(block), ROWS):
            some = slice(*np.searchsorted(owner_, [at, at + ROWS]))
            sketch = np.zeros((min(ROWS, len(block) - at), len(batch.coordinates)), np.int64)
            np.maximum.at(sketch, (owner_[some] - at, column[some]), tf_[some])
            self.bounds[at : at + ROWS] = impacts(sketch, self.length[at : at + ROWS, None]).astype(np.float64) @ batch.folded
        self.keys, code = np.unique(key, return_inverse=True)
        self.place, self.tf = owner * (len(self.keys) + 1) + code, tf
        at = np.searchsorted(self.keys, batch.keys)
        found = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == batch.keys) if len(self.keys) else np.zeros(len(at), bool)
        self.code = np.where(found, at, len(self.keys))  # a code that no posting has

    def scores(self, query: int, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for a query."""
        asked = np.flatnonzero(self.batch.count[query])
        want = rows[:, None] * (len(self.keys) + 1) + self.code[asked]
        at = np.minimum(np.searchsorted(self.place, want), max(len(self.place) - 1, 0))
        tf = np.where(self.place[at] == want, self.tf[at], 0) if len(self.place) else np.zeros(want.shape, np.int64)
        return impacts(tf, self.length[rows][:, None]) @ self.batch.weight[query, asked]


def order_of(scores: np.ndarray, ids: list) -> np.ndarray:
    """Highest score first, equal ones by ascending id, null last."""
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] if ids[i] is not None else 0)), np.int64)


class Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64) for _ in range(queries)], [[] for _ in range(queries)]

    def least(self, query: int) -> int:
        """What a document must reach to matter."""
        return int(self.scores[query][-1]) if len(self.scores[query]) == self.k else 1

    def add(self, query: int, scores: np.ndarray, ids: list) -> None:
        some = np.flatnonzero(scores >= self.least(query))
        if len(some):
            scores, ids = np.concatenate([self.scores[query], scores[some]]), [*self.ids[query], *(ids[i] for i in some.tolist())]
            by = order_of(scores, ids)[: self.k]
            self.scores[query], self.ids[query] = scores[by], [ids[i] for i in by.tolist()]

    def take(self, documents: Documents, ids: list, step: int = STEP) -> int:
        """Scores documents by descending bound until the threshold; returns how many were scored."""
        scored = 0
        for query in range(len(self.ids)):
            bound = documents.bounds[:, query]
            open_ = np.flatnonzero(bound >= self.least(query))
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            at = 0
            while at < len(open_) and bound[open_[at]] >= self.least(query):
                rows = open_[at : at + step]
                self.add(query, documents.scores(query, rows), [ids[i] for i in rows.tolist()])
                at += step
                scored += len(rows)
        return scored


def _figures(texts: DataFrame, batch: Batch) -> tuple[int, int, np.ndarray]:
    """N, L and the batch's df, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, tokens, df = 0, 0, np.zeros(len(batch.keys), np.int64)
        for rows in batches:
            for _, _, block in blocks(rows.column(0), BLOCK_BYTES):
                a, b, c = batch.held(block)
                documents, tokens, df = documents + a, tokens + b, df + c
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.concatenate([[-2, -1], some]), pa.int64()), "n": pa.array(np.concatenate([[documents, tokens], df[some]]), pa.int64())})

    found = {r.term: r.n for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the batch
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(batch.keys))], np.int64)


def _search(docs: DataFrame, batch: Batch, items: list, kind: T.DataType, k: int) -> DataFrame:
    """The k best of each task for each query: (item, query, id, score)."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_type, id_type = to_arrow_type(kind), to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(batch.n, k)
        for rows in batches:
            for at, to, block in blocks(rows.column(1), BLOCK_BYTES):
                best.take(Documents(block, batch), rows.column(0).slice(at, to - at).to_pylist())
        query = np.repeat(np.arange(batch.n), [len(x) for x in best.ids])
        yield pa.RecordBatch.from_arrays(
            [pa.array([items[i] for i in query.tolist()], item_type), pa.array(query, pa.int64()), pa.array([x for ids in best.ids for x in ids], id_type), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64())],
            names=["item", "query", "id", "score"],
        )

    return docs.mapInArrow(run, T.StructType([T.StructField("item", kind), T.StructField("query", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, text: str = "text", id_col: str = "doc_id", query_text: str = "text", query_id: str = "item_id", width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """query_id, rank, id_col and score of each query's k best documents."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    asked = queries.select(F.col(f"`{query_id}`").alias("item"), F.col(f"`{query_text}`").cast("string").alias("t"))
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + size // batch_bytes
    found = []
    for i in range(n):
        got = asked.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == i).collect()  # one batch of bounded size
        batch = Batch([r.t for r in got])
        batch.weigh(*_figures(rows.select("t"), batch), width)
        found.append(_search(rows, batch, [r["item"] for r in got], asked.schema["item"].dataType, k).withColumn("batch", F.lit(i)))
    by = Window.partitionBy("batch", "query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(query_id), "rank", F.col("id").alias(id_col), "score")
