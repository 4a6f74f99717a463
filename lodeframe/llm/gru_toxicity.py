"""Toxicity of whole texts by a small bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Tokens are runs of letters, digits and bytes above 127, A-Z lower-cased. A token's input is a vector for its word (one for all words not
met in training) beside the mean of the vectors of its byte trigrams, so that unseen spellings still say something. The network
reads windows of `WINDOW` tokens that overlap by `WINDOW - STRIDE`; all windows of a text are scored and the highest counts.

The training rows are a bounded sample: labelled rows in the order of a hash of their id, at most `TRAIN_TOXIC` of label 1 and
`TRAIN_CLEAN` of label 0, those of more than `TRAIN_CHARS` characters left out. Only training is bounded; scoring reads all of every text.
Each round scores all windows of the training texts and learns from the highest window of each; part of the rows is kept out of
that and calibrates the score to the share of label 1 among all labelled rows.

Null and empty texts have one empty window, whose score is that of the pooled zero vector. Repeated rows score alike. Without labels
of both classes every text gets the share of label 1 (0 without labels).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.texts import Block, blocks, keep_rows, keys_of, per_text, spread

WINDOW, STRIDE = 48, 36
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2000, 3000, 20_000
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION, TRIGRAMS = 8, 6, 8, 8, 8192
ROUNDS, STEPS, BATCH, RATE, MIN_TEXTS = 10, 320, 128, 0.01, 3
WIDE = 2048

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tokens:
    """The tokens of a block by their distinct words: `word` numbers a token's word, whose trigrams are `grams[at:at + size]`."""

    word: np.ndarray
    key: np.ndarray
    grams: np.ndarray
    size: np.ndarray
    counts: np.ndarray


def tokens_of(block: Block) -> Tokens:
    block = block.lower()
    starts, ends = block.runs(TOKEN[block.data])
    counts = np.bincount(block.owners(starts), minlength=len(block))
    key, first, word = np.unique(keys_of(block.data, starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    owner, place = spread(size)
    at = starts[first][owner] + place
    left = np.where(place > 0, block.data[at - 1], 0).astype(np.int64)
    right = np.where(place < size[owner] - 1, block.data[np.minimum(at + 1, max(0, len(block.data) - 1))], 0).astype(np.int64) if len(at) else left
    code = (left << 16) | (block.data[at].astype(np.int64) << 8) | right
    return Tokens(word.astype(np.int32), key, (((code * 2654435761) >> 7) % TRIGRAMS).astype(np.int32), size, counts)


def merged(parts: list[Tokens]) -> Tokens:
    """The tokens of several blocks as those of one."""
    key, first, number = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
    ends = np.cumsum([len(p.key) for p in parts])
    word = np.concatenate([number[end - len(p.key) : end][p.word] for p, end in zip(parts, ends)])
    size = np.concatenate([p.size for p in parts])
    at = (np.cumsum(size) - size)[first]
    owner, place = spread(size[first])
    return Tokens(word, key, np.concatenate([p.grams for p in parts])[at[owner] + place], size[first], np.concatenate([p.counts for p in parts]))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first token and length of every window; windows of a text overlap and reach its end."""
    number = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text, place = spread(number)
    start = place * STRIDE
    return text, start + (np.cumsum(counts) - counts)[text], np.minimum(WINDOW, counts[text] - start)


class Network:
    """The parameters by name, and the passes over batches of windows laid out step by step."""

    def __init__(self, keys: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
        inputs = WORD_DIM + CHAR_DIM
        self.keys = keys
        self.p = {
            "words": draw(len(keys) + 1, WORD_DIM, scale=0.05), "grams": draw(TRIGRAMS, CHAR_DIM, scale=0.05), "into": draw(inputs, 6 * HIDDEN, scale=inputs**-0.5), "bias": np.zeros(6 * HIDDEN, np.float32),
            "ahead": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "back": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "look": draw(2 * HIDDEN, ATTENTION, scale=0.25), "look_bias": np.zeros(ATTENTION, np.float32), "look_out": draw(ATTENTION, scale=0.5),
            "out": draw(2 * HIDDEN, scale=0.25), "out_bias": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0
        self.windows: tuple = ()  # text, first token, length and logit of each window of the last texts scored

    def known(self, key: np.ndarray) -> np.ndarray:
        """Row of each word's vector; the last row is for words not met in training."""
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def inputs(self, t: Tokens) -> np.ndarray:
        """The input vector of each distinct word."""
        chars = np.zeros((len(t.key), CHAR_DIM), np.float32)
        first = np.cumsum(t.size) - t.size
        for a in range(0, len(t.key), 1 << 14):
            b = min(a + (1 << 14), len(t.key))
            own = t.grams[first[a] : first[b - 1] + t.size[b - 1]]
            chars[a:b] = np.add.reduceat(self.p["grams"][own], first[a:b] - first[a], axis=0) / t.size[a:b, None]
        return np.concatenate([self.p["words"][self.known(t.key)], chars], axis=1).astype(np.float32)

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["into"] + self.p["bias"]

    @staticmethod
    def layout(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token at each step of each window, and which steps there are."""
        steps = np.arange(max(1, int(length.max(initial=0))))[:, None]
        there = steps < length
        return np.where(there, start + steps, 0), there

    def _run(self, gates: np.ndarray, u: np.ndarray, there: np.ndarray, order: range, tape: list | None) -> np.ndarray:
        states = np.zeros((len(there), gates.shape[1], HIDDEN), np.float32)
        h = np.zeros(gates.shape[1:2] + (HIDDEN,), np.float32)
        for t in order:
            side = h @ u
            zr = _sigmoid(gates[t][:, : 2 * HIDDEN] + side[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates[t][:, 2 * HIDDEN :] + r * side[:, 2 * HIDDEN :])
            there_t = there[t][:, None]
            if tape is not None:
                tape.append((t, h, z, r, new, side[:, 2 * HIDDEN :]))
            h = np.where(there_t, new + z * (h - new), h)
            states[t] = h
        return states

    def forward(self, gates: np.ndarray, there: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logit of each window from the gate inputs of its steps."""
        p, n = self.p, len(there)
        ahead, back = ([], []) if tape is not None else (None, None)
        states = np.concatenate([self._run(gates[..., : 3 * HIDDEN], p["ahead"], there, range(n), ahead), self._run(gates[..., 3 * HIDDEN :], p["back"], there, range(n - 1, -1, -1), back)], axis=2)
        seen = np.tanh(states @ p["look"] + p["look_bias"])
        weight = np.where(there, seen @ p["look_out"], -1e9)
        weight = np.exp(weight - weight.max(axis=0)) * there
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if tape is not None:
            tape |= {"ahead": ahead, "back": back, "states": states, "seen": seen, "weight": weight, "pooled": pooled}
        return pooled @ p["out"] + p["out_bias"][0]

    def backward(self, d_logit: np.ndarray, there: np.ndarray, tape: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the gate inputs, and of the gate inputs."""
        p, states, weight, seen = self.p, tape["states"], tape["weight"], tape["seen"]
        g = {"out": tape["pooled"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[..., None] * d_pooled
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
        d_look = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["look_out"] = np.einsum("tb,tba->a", d_look, seen)
        d_seen = d_look[..., None] * p["look_out"] * (1 - seen**2)
        g["look"] = np.einsum("tbh,tba->ha", states, d_seen)
        g["look_bias"] = d_seen.sum(axis=(0, 1))
        d_states = d_states + d_seen @ p["look"].T
        d_gates = np.zeros((*there.shape, 6 * HIDDEN), np.float32)
        for name, half in (("ahead", 0), ("back", 1)):
            u, d_u, d_h = p[name], np.zeros_like(p[name]), np.zeros((there.shape[1], HIDDEN), np.float32)
            for t, h, z, r, new, side in reversed(tape[name]):
                d = d_h + d_states[t][:, half * HIDDEN : (half + 1) * HIDDEN]
                live = there[t][:, None]
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (h - new) * z * (1 - z)
                d_r = d_new * side * r * (1 - r)
                pre = np.concatenate([d_z, d_r, d_new], axis=1) * live
                d_gates[t][:, half * 3 * HIDDEN : (half + 1) * 3 * HIDDEN] = pre
                inner = np.concatenate([d_z, d_r, d_new * r], axis=1) * live
                d_u += h.T @ inner
                d_h = np.where(live, d * z + inner @ u.T, d)
            g[name] = d_u
        return g, d_gates

    def logits(self, t: Tokens) -> np.ndarray:
        """The highest window's logit of each text."""
        text, start, length = windows_of(t.counts)
        gates = self.gates(self.inputs(t)) if len(t.key) else np.zeros((1, 6 * HIDDEN), np.float32)
        word = t.word if len(t.word) else np.zeros(1, np.int64)
        found = np.empty(len(text), np.float32)
        by = np.argsort(length, kind="stable")
        for at in range(0, len(by), WIDE):
            some = by[at : at + WIDE]
            where, there = self.layout(start[some], length[some])
            found[some] = self.forward(gates[word[where]], there)
        self.windows = (text, start, length, found)
        return np.maximum.reduceat(found, np.searchsorted(text, np.arange(len(t.counts)))) if len(text) else found

    def score(self, block: Block) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(tokens_of(block)).astype(np.float64) + self.shift)


def train(texts: list[str] | pa.ChunkedArray, toxic: np.ndarray, share: float, rounds: int = ROUNDS, seed: int = 7) -> Network | float:
    """Learns from whole texts and their labels; `share` is the share of label 1 that the score is calibrated to."""
    if not len(toxic) or toxic.min() == toxic.max():
        return share
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    t = merged([tokens_of(block) for _, _, block in blocks(texts, 1 << 19)])
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(toxic)) % 5 == 0
    in_toxic, in_clean = np.zeros(len(t.key), np.int64), np.zeros(len(t.key), np.int64)
    ends = np.cumsum(t.counts)
    for i in np.flatnonzero(~held):
        (in_toxic if toxic[i] else in_clean)[np.unique(t.word[ends[i] - t.counts[i] : ends[i]])] += 1
    common = in_toxic + in_clean >= MIN_TEXTS
    net = Network(t.key[common], seed)
    # The first component of a word and of a trigram starts at its shrunken log odds.
    n1, n0 = max(1, (toxic[~held] == 1).sum()), max(1, (toxic[~held] == 0).sum())
    odds = np.log((in_toxic + 1) / (n1 + 2)) - np.log((in_clean + 1) / (n0 + 2))
    net.p["words"][:-1, 0] += odds[common] / 2
    weight = np.bincount(t.grams, minlength=TRIGRAMS)
    net.p["grams"][:, 0] += np.bincount(t.grams, weights=np.repeat(odds, t.size), minlength=TRIGRAMS) / (weight + 5) / 2

    known = net.known(t.key)
    gram_at = np.cumsum(t.size) - t.size
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    batch = max(16, min(BATCH, len(toxic) // 20))
    rounds = max(rounds, -(-STEPS * batch // len(toxic)))  # few texts are read more often
    for turn in range(rounds):
        net.logits(t)
        text, start, length, found = net.windows
        by = np.lexsort((found, text))
        top = by[np.concatenate([text[by][1:] != text[by][:-1], [True]])]
        top = top[~held[text[top]]]
        rng.shuffle(top)
        rate = RATE * 0.5 ** (3.5 * turn / rounds)
        for at in range(0, len(top), batch):
            some = top[at : at + batch]
            where, there = net.layout(start[some], length[some])
            words, inverse = np.unique(t.word[where], return_inverse=True)
            inverse = inverse.reshape(where.shape)
            size = t.size[words]
            owner, place = spread(size)
            grams = t.grams[gram_at[words][owner] + place]
            chars = np.add.reduceat(net.p["grams"][grams], np.cumsum(size) - size, axis=0) / size[:, None]
            x = np.concatenate([net.p["words"][known[words]], chars], axis=1).astype(np.float32)
            tape: dict = {}
            logit = net.forward(net.gates(x)[inverse], there, tape)
            y = toxic[text[some]]
            d = (_sigmoid(logit) - y).astype(np.float32) / len(some)
            g, d_gates = net.backward(d, there, tape)
            flat = d_gates.reshape(-1, 6 * HIDDEN)
            d_word = np.stack([np.bincount(inverse.ravel(), weights=c, minlength=len(words)) for c in flat.T], axis=1).astype(np.float32)
            g["into"], g["bias"] = x.T @ d_word, flat.sum(axis=0)
            d_x = d_word @ net.p["into"].T
            g["words"], g["grams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
            np.add.at(g["words"], known[words], d_x[:, :WORD_DIM])
            np.add.at(g["grams"], grams, (d_x[:, WORD_DIM:] / size[:, None])[owner])
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                grad = g[k].astype(np.float32) + (1e-4 * v if k in ("words", "grams") else 0)
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    _calibrate(net, net.logits(t)[held], toxic[held], share)
    net.windows = ()
    return net


def _calibrate(net: Network, logit: np.ndarray, y: np.ndarray, share: float) -> None:
    """A logistic curve over the logits of texts that training left out, each class weighed by its share among all labels."""
    if len(y) < 20 or y.min() == y.max():
        return
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = _sigmoid(a * logit + b)
        e, c = weight * (q - y), weight * q * (1 - q) + 1e-6
        grad = np.array([(e * logit).mean() + 0.01 * (a - 1), e.mean()])
        h = np.array([[(c * logit**2).mean() + 0.01, (c * logit).mean()], [(c * logit).mean(), c.mean() + 1e-6]])
        move = np.linalg.solve(h, grad)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
    if a > 0:
        net.scale, net.shift = float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> Network | float:
    """Draws the bounded sample from the labelled rows given (the caller keeps out what must not be learned) and trains on it."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    some = [rows.where(f"y = {y}").orderBy(F.xxhash64("i"), "i").limit(most) for y, most in ((1, toxic_rows), (0, clean_rows))]
    ids = F.broadcast(some[0].union(some[1]))  # at most toxic_rows + clean_rows rows
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).where(F.length("t") <= TRAIN_CHARS)
    sample = texts.join(ids, "i").groupBy("i", "y").agg(F.max("t").alias("t")).select("i", "y", "t")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        model = train(rows.column("t"), rows.column("y").to_numpy(), share) if rows is not None and len(rows) else share
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # The sample has a bound, so one task can learn from it; only the parameters come to the driver.
    found = sample.repartition(1).sortWithinPartitions("i").mapInArrow(learn, "model binary").first()
    return pickle.loads(found.model) if found else share


def score_of(block: Block, model: Network | float) -> np.ndarray:
    return np.full(len(block), float(model)) if isinstance(model, float) else model.score(block)


def score(df: DataFrame, model: Network | float, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the score of the whole text."""
    return per_text(df, text, list(keep), [T.StructField("score", T.DoubleType())], lambda block: {"score": score_of(block, model)})


def drop_toxic(df: DataFrame, model: Network | float, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all columns, that score below the limit."""
    return keep_rows(df, text, lambda block: score_of(block, model) < limit)
