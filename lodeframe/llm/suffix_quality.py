"""Repetition inside texts, found with suffix arrays over words.

For a block of texts one suffix array orders all suffixes, those of a text among themselves: the first key of a suffix is its text and
first word, and prefix doubling sorts only what still ties. Equality of the ranks kept from each round gives the longest common prefix
of neighbours by descending powers of two. A suffix's longest repeat is the larger prefix it shares with its two neighbours (its
deepest LCP interval); where the suffix one word earlier doesn't repeat for longer, that repeat can't be extended to the left, so it is
maximal. The spans of maximal repeats are united, and the covered share of words and the longest repeat are limited.

Null and empty texts have no words, no spans, and fail the base rule of ten words. Repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeframe.llm.texts import Block, chain, keep_rows, keys_of, lists, mix, per_text

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: A repeat counts from so many words on; a text fails if more than this share of its words lies in repeats or one is longer than this.
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.18, 50


def longest_repeats(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each word position, the length in words of the longest run from it on that also starts elsewhere in its text."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64)
    stop = np.searchsorted(owner, owner, side="right")
    first = chain(mix(owner.astype(np.uint64) + np.uint64(1)), key)
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([heads, [n]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    levels, reach = [rank], 1
    active = order[np.repeat(sizes > 1, sizes)]
    while len(active):
        ahead = active + reach
        inside = ahead < stop[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        base = rank[active]
        by = np.argsort(base * (n + 1) + second)
        active, base, second = active[by], base[by], second[by]
        other = np.concatenate([[True], base[1:] != base[:-1]])
        new = other | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        class_head = np.maximum.accumulate(np.where(other, at, 0))
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active] = base + head - class_head
        levels.append(rank)
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(active)]]))
        active = active[np.repeat(size > 1, size)]
        reach *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    tied = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[tied], b[tied]
    common = np.zeros(len(tied), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < stop[a]) & (y < stop[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def united(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Flags of the places covered by any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def measure(block: Block, min_words: int = MIN_WORDS) -> dict:
    """Counts of the base rules, covered words, longest repeat, and the united spans in code points."""
    n = len(block)
    starts, ends = block.words()
    owner = block.owners(starts)
    count = lambda flags: np.bincount(owner[flags], minlength=n)
    n_words = np.bincount(owner, minlength=n)
    longest = longest_repeats(owner, keys_of(block.data, starts, ends))
    five = np.flatnonzero(longest >= 5)
    repeat = united(five, np.full(len(five), 5), len(starts))

    earlier = np.concatenate([[0], longest[:-1]]) if len(longest) else longest
    same = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
    maximal = np.flatnonzero((longest >= min_words) & ~(same & (earlier == longest + 1)))
    covered = united(maximal, longest[maximal], len(starts))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[maximal], longest[maximal])

    edge = covered & ~(np.concatenate([[False], covered[:-1]]) & same) if len(covered) else covered
    last = covered & ~(np.concatenate([covered[1:], [False]]) & np.concatenate([same[1:], [False]])) if len(covered) else covered
    points = block.code_points()
    origin = points[block.offsets[:-1]]
    spans = pa.StructArray.from_arrays([pa.array(points[p] - origin[owner[f]], pa.int64()) for p, f in ((starts[edge], edge), (ends[last], last))], ["start", "end"])

    lines, line_ends = block.runs(block.data != 10)
    held = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)  # an empty line has no word either
    lines, line_ends = lines[held], line_ends[held]
    line_owner = block.owners(lines)
    known = chain(mix(line_owner.astype(np.uint64)), keys_of(block.data, lines, line_ends))
    _, once = np.unique(known, return_index=True)
    head = (block.data & 0xC0) != 0x80
    n_repeat = count(repeat)
    return {
        "n_words": n_words,
        "word_chars": block.sums(head & ~np.isin(block.data, [32, 9, 10, 11, 12, 13])),
        "n_symbols": block.sums(SYMBOLS[block.data]),
        "n_dup_lines": np.bincount(line_owner, minlength=n) - np.bincount(line_owner[once], minlength=n),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < 10) | (100 * n_repeat > 20 * n_words),
        "covered_words": count(covered),
        "longest_repeat": most,
        "spans": lists(np.bincount(owner[edge], minlength=n), spans),
    }


def verdict(found: dict, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> np.ndarray:
    return ~found["base_failed"] & (found["covered_words"] <= max_covered * found["n_words"]) & (found["longest_repeat"] <= max_longest)


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("covered_words", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def assess(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row for each text with its counts, repeated spans (code points, united) and verdict. Other columns are not touched."""

    def compute(block: Block) -> dict:
        found = measure(block, min_words)
        return found | {"kept": verdict(found, max_covered, max_longest)}

    return per_text(df, text, list(keep), FIELDS, compute)


def drop_repetitive(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows, with all columns, that pass the base rules and the limits on repetition."""
    return keep_rows(df, text, lambda block: verdict(measure(block, min_words), max_covered, max_longest))
