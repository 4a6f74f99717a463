"""Groups of linked values: comparison of all values block against block, and connected components as joins.

In a pair of blocks, values that are nearly equal meet by what they must have in common: their first two letters, or a choice of letters."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.strings import jaro_winkler
from lodeframe.session import cut

#: Values of a block; two blocks meet in one task. Blocks grow with the values up to `LARGEST` of them.
SIDE, BLOCKS, LARGEST = 2000, 16, 1 << 17
#: Code points of values that are measured many at once, pairs measured together, and occurrences of a letter that have a bit.
SHORT, TOGETHER, HELD = 64, 1 << 15, 4
#: Pairs looked at together, the most choices of letters that stand for a value, and pairs looked at in the time one choice takes.
LOOKED, CHOICES, WORTH = 1 << 20, 2000, 16
#: Links, both ways, that one partition holds while components are found.
PART = 100_000
_SLACK = 1e-9


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that each end of the links (a, b) is connected with. Least labels are passed on and pointers jump.

    All that have one label go on to the least that any of them met, so that rounds grow with the logarithm of the longest way, not with it.
    Each round keeps as many partitions as the links need: a few rows dealt over hundreds would cost a file for each pair of tasks, and
    rows of one partition need no shuffle at all."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    parts = max(1, -(-edges.count() // PART))
    edges = cut(edges.coalesce(parts)).coalesce(parts)
    labels = cut(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("comp")).coalesce(parts)).coalesce(parts)
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        met = lower.select(F.explode(F.array("old", "node")).alias("from"), F.col("comp").alias("above"))
        up = met.groupBy(F.col("from").alias("comp")).agg(F.min("above").alias("above")).where("above < comp")
        labels = cut(lower.join(up, "comp", "left").select("node", "old", F.least("comp", "above").alias("comp")).coalesce(parts)).coalesce(parts)
        moved = labels.where("old <> comp").limit(1).count()
        labels = labels.select("node", "comp")
        if not moved:
            return labels


def side_of(n: int) -> int:
    """Values of a block: at most some `BLOCKS` blocks while they can grow, so that values are not written more often the more there are."""
    return min(LARGEST, max(SIDE, -(-n // BLOCKS)))


def cuts_of(values: DataFrame) -> int:
    n = values.count()
    return max(1, -(-n // side_of(n)))


def block_pairs(values: DataFrame, cuts: int, same: bool | None = None) -> DataFrame:
    """(x, y, mine, ...): every row once for each pair of blocks that its own block is in; blocks follow from the hash of `v`.

    `same` keeps only the pairs of a block with itself, or leaves them out. Pairs of blocks are dealt by number, as they are little to read
    but much to work on, and would be put together by their size.
    """
    mine = F.pmod(F.xxhash64("v"), F.lit(cuts)).cast("int")
    others = F.array("mine") if same else F.sequence(F.lit(0), F.lit(cuts - 1))
    wide = values.withColumn("mine", mine).withColumn("other", F.explode(others))
    wide = wide.where("mine <> other") if same is False else wide
    wide = wide.select(F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", *values.columns)
    return wide.repartition(2 * cuts if same else cuts * (cuts + 1), "x", "y")


class _Letters:
    """Values as arrays: lengths, order, numbers of the short ones' letters, and bits that bound from above how many letters two have in common.

    A letter's first `HELD` occurrences are bits of its own (of few letters) or of a group of letters; the others are counted in `over`.
    """

    def __init__(self, values: list[str]):
        n = len(values)
        self.size = np.fromiter(map(len, values), np.int64, n)
        self.rank = np.empty(n, np.int64)
        self.rank[sorted(range(n), key=values.__getitem__)] = np.arange(n)
        self.flat = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.int32)
        self.begins = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(n), self.size)
        place = np.arange(len(self.flat)) - self.begins[owner]
        short = self.size[owner] <= SHORT
        letters, letter = np.unique(self.flat, return_inverse=True)
        self.codes = np.zeros((min(SHORT, int(self.size.max(initial=0))), n), np.uint8 if len(letters) < 256 else np.int32)
        self.codes[place[short], owner[short]] = letter[short] + 1
        self.words = 1 if len(letters) <= 64 // HELD else 2
        groups = self.words * 64 // HELD
        held = np.bincount(owner * groups + letter % groups, minlength=n * groups).reshape(n, groups)
        self.over = np.maximum(0, held - HELD).sum(axis=1)
        bits = (np.uint64(1) << np.minimum(held, HELD).astype(np.uint64)) - np.uint64(1)
        shifts = np.arange(64 // HELD, dtype=np.uint64) * np.uint64(HELD)
        self.bits = [np.bitwise_or.reduce(bits[:, w * len(shifts) : (w + 1) * len(shifts)] << shifts, axis=1) for w in range(self.words)]

    def letter(self, place: int) -> np.ndarray:
        """Code point of each value at a place, -1 beyond its end."""
        return np.where(self.size > place, self.flat[np.minimum(self.begins + place, len(self.flat) - 1)] if len(self.flat) else -1, -1).astype(np.int64)

    def common(self, i, j) -> np.ndarray:
        """At least the number of letters in common."""
        found = np.bitwise_count(self.bits[0][i] & self.bits[0][j]).astype(np.int64)
        if self.words > 1:
            found += np.bitwise_count(self.bits[1][i] & self.bits[1][j])
        return found + np.minimum(self.over[i], self.over[j])

    def same_start(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters of the common start, up to four, of short values."""
        found, going = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for row in self.codes[:4]:
            going &= (row[i] == row[j]) & (row[i] > 0)
            found += going
        return found

    def similar(self, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, similarity) of those pairs of short values, i before j, that reach `least`; the same numbers as `jaro_winkler`'s."""
        start, la, lb = self.same_start(i, j), self.size[i], self.size[j]
        reaches = lambda most: most + 0.1 * start * (1 - most) >= least - _SLACK
        keep = reaches((self.common(i, j) * (1 / la + 1 / lb) + 1) / 3)
        i, j, start, la, lb = i[keep], j[keep], start[keep], la[keep], lb[keep]
        if not len(i):
            return i, j, np.zeros(0)
        a, b = self.codes[: la.max(), i], self.codes[: lb.max(), j]
        reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        free, picked, far = b > 0, np.zeros(a.shape, bool), int(reach.max())
        alike = far == int(reach.min())
        for x in range(len(a)):
            waits = a[x] > 0
            for y in range(max(0, x - far), min(len(b), x + far + 1)):
                met = (a[x] == b[y]) & waits & free[y]
                if not alike:
                    met &= abs(x - y) <= reach
                free[y] ^= met
                waits ^= met
                picked[x] |= met
        m = picked.sum(axis=0)
        keep = (m > 0) & reaches((m / la + m / lb + 1) / 3)
        i, j, start, la, lb, m = i[keep], j[keep], start[keep], la[keep], lb[keep], m[keep]
        a, b, picked, taken = a[:, keep], b[:, keep], picked[:, keep], ((b > 0) & ~free)[:, keep]
        swaps = (_in_order(a, picked) != _in_order(b, taken)).sum(axis=0) // 2
        score = (m / la + m / lb + (m - swaps) / m) / 3
        score = np.where(score <= 0.7, score, score + 0.1 * start * (1 - score))
        keep = (score >= least) & (score < 1.0)
        return i[keep], j[keep], score[keep]


def _in_order(codes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen letters of each column moved to its front, 0 after them."""
    found = np.zeros((max(1, int(chosen.sum(axis=0).max(initial=0))), codes.shape[1]), codes.dtype)
    at = np.cumsum(chosen, axis=0) - 1
    x, y = np.nonzero(chosen)
    found[at[x, y], y] = codes[x, y]
    return found


def _plan(la: int, lb: int, least: float) -> list[tuple[bool, int]]:
    """(in order, letters): what two values of those lengths and at most one letter of common start share if they reach `least`.

    With fewer matches than some number none may be out of order, so that those letters come in the same order in both; with more, the
    letters alone are the same. Each has at least one choice of so many letters in common, if any.
    """
    most = (least - 0.1) / 0.9
    swaps = {m: m * (m / la + m / lb + 1 - 3 * most) + _SLACK for m in range(1, min(la, lb) + 1)}
    enough = [m for m, t in swaps.items() if t >= 0]
    loose = [m for m, t in swaps.items() if t >= 1]
    first = [(True, enough[0])] if enough and enough[:1] != loose[:1] else []
    return first + ([(False, loose[0])] if loose else [])


def _worth(la: int, lb: int, n: int, k: int, plan: list[tuple[bool, int]]) -> bool:
    """Whether choices of letters of n and k values are fewer than their pairs by far."""
    choices = [(math.comb(la, size), math.comb(lb, size)) for _, size in plan]
    return max(la, lb) <= SHORT and all(max(c) <= CHOICES for c in choices) and sum(a * n + b * k for a, b in choices) * WORTH <= n * k


def _choices(codes: np.ndarray, ordered: bool, size: int) -> np.ndarray:
    """A hash of every choice of so many letters: (choices, values). Equal choices have equal hashes."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    sets = list(combinations(range(len(codes)), size))
    found = np.zeros((len(sets), codes.shape[1]), np.uint64)
    weights = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) if ordered else 1) for k in range(size)]
    for row, at in zip(found, sets):
        for w, p in zip(weights, at):
            row += mixed[p] * w
    return found


def _shared(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, low, high, owner): the left values with each range of `owner`, right values, that have a choice in common with it."""
    bits = max(16, int(max(left.size, right.size)).bit_length() + 2)
    spot = lambda h: (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    sides, spots = [], [spot(left), spot(right)]
    for own, hashes in ((0, left), (1, right)):  # most choices are met nowhere on the other side
        there = np.zeros(1 << bits, bool)
        there[spots[1 - own].ravel()] = True
        _, value = hit = np.nonzero(there[spots[own]])
        sides.append((hashes[hit], value))
    (asked, value), (known, owner) = sides
    order = np.argsort(known)
    known, owner = known[order], owner[order]
    order = np.argsort(asked)
    asked, value = asked[order], value[order]
    low, high = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
    met = high > low
    value, low, high = value[met], low[met], high[met]
    order = np.argsort(value, kind="stable")
    return value[order], low[order], high[order], owner


def near_in_block(x: int, y: int, mine: list[int], values: list[str], least: float, spanning: bool = False, linked: Iterable[tuple[str, str]] = ()):
    """Pairs of values of the two blocks whose Jaro-Winkler similarity is at least `least` and under 1.

    Pairs with the same two first letters are all looked at; the others meet by the letters they must share where those are few to choose, and
    else are looked at too. Letters in common bound the similarity from above, so that only promising pairs are measured, many at once.
    `spanning` leaves out pairs that are linked through others already, by `linked` or by what was found.
    """
    of = _Letters(values)
    side = np.array(mine, np.int64)
    left, right = (np.flatnonzero((side == s) & (of.size > 0)) for s in (x, y))
    # Values with the same two first letters are neighbours in order. Only they can have a start of more than one letter in common.
    two, third = (of.letter(0) << 32) + of.letter(1) + 1, of.letter(2)
    left, right = left[np.lexsort((of.size[left], two[left]))], right[np.argsort(two[right], kind="stable")]
    bits, over, size, starts = [w[right] for w in of.bits], of.over[right], of.size[right], two[right]
    more = bool(over.any())
    group = np.arange(len(values))
    if spanning and linked:
        place = {v: k for k, v in enumerate(values)}
        _joining([(place[a], place[b], 1.0) for a, b in linked], group)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def measured(i: np.ndarray, j: np.ndarray):
        i, j = np.where(of.rank[i] < of.rank[j], i, j), np.where(of.rank[i] < of.rank[j], j, i)
        short = (of.size[i] <= SHORT) & (of.size[j] <= SHORT)
        got = [of.similar(i[short], j[short], least)]
        slow = [(p, r, jaro_winkler(values[p], values[r])) for p, r in zip(i[~short].tolist(), j[~short].tolist())]
        slow = [f for f in slow if least <= f[2] < 1.0]
        got.append(tuple(np.array([f[c] for f in slow], t) for c, t in enumerate((np.int64, np.int64, float))))
        i, j, score = (np.concatenate([g[c] for g in got]) for c in range(3))
        if spanning:  # one link of each two groups is enough
            a, b = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
            some = np.unique(a * len(values) + b, return_index=True)[1]
            i, j, score = i[some], j[some], score[some]
        links = zip(i.tolist(), j.tolist(), score.tolist())
        return _joining(links, group) if spanning else links

    def links_of(pairs):
        """Measures the pairs (i, j), arrays of any length, as soon as there are enough."""
        held, most = 0, TOGETHER // 8 if spanning else TOGETHER
        for i, j in chain(pairs, [(None, None)]):
            if i is not None:
                if x == y:
                    once = i < j
                    i, j = i[once], j[once]
                if spanning:
                    apart = group[i] != group[j]
                    i, j = i[apart], j[apart]
                waiting.append((i, j))
                held += len(i)
            if held and (held >= most or i is None):
                i, j = (np.concatenate([w[c] for w in waiting]) for c in (0, 1))
                waiting.clear()
                held = 0
                for at in range(0, len(i), most):
                    some = i[at : at + most], j[at : at + most]
                    if spanning:
                        apart = group[some[0]] != group[some[1]]
                        some = some[0][apart], some[1][apart]
                    if len(some[0]):
                        yield from ((values[p], values[r], s) for p, r, s in measured(*some))

    def needed(own: int, start: int) -> np.ndarray:
        """Letters in common without which a value of that length does not reach `least`, whatever the start up to that length."""
        most = (least - 0.1 * start) / (1 - 0.1 * start)
        need = np.clip(np.ceil((3 * most - 1) * own * size / (own + size) - _SLACK), 1, None).astype(np.int32)
        return need if more else np.minimum(need, 255).astype(np.uint8)  # of 128 bits at most

    def common(some: np.ndarray, at) -> np.ndarray:
        found = np.bitwise_count(of.bits[0][some, None] & bits[0][None, at])
        if of.words > 1:
            found += np.bitwise_count(of.bits[1][some, None] & bits[1][None, at])
        return found + np.minimum(of.over[some, None], over[None, at]) if more else found

    def unlinked(some: np.ndarray, at) -> list[tuple]:
        """The values and places on the right that can give new links: of the largest group, if it holds most, only those with others."""
        if not spanning:
            return [(some, at)]
        most = np.bincount(group[of.size > 0]).argmax()
        within, there = group[some] == most, np.arange(len(right))[at]
        if 2 * np.count_nonzero(within) < len(some):
            return [(some, at)]
        return [(a, b) for a, b in ((some[~within], at), (some[within], there[group[right[there]] != most])) if len(a) and len(right[b])]

    def looked(some: np.ndarray, at: slice, promising):
        """Those pairs of the values with the right ones at some places that are promising by their letters in common."""
        n = max(1, (LOOKED >> 3) // max(1, at.stop - at.start))
        n = max(n, 256) if spanning else n  # the largest group is looked up for all of them
        for start in range(0, len(some), n):
            for part, to in unlinked(some[start : start + n], at):
                step = max(1, (LOOKED >> 3) // len(right[to]))
                for k in range(0, len(part), step):
                    i, j = np.nonzero(promising(part[k : k + step], to, common(part[k : k + step], to)))
                    if len(i):
                        yield part[k : k + step][i], right[to][j]

    def alike():
        """Pairs with the same two first letters."""
        cuts = np.flatnonzero(np.diff(two[left], prepend=-1) | np.diff(of.size[left], prepend=-1)).tolist() + [len(left)]
        need = {}
        for a, b in zip(cuts, cuts[1:]):
            own, key = int(of.size[left[a]]), two[left[a]]
            low, high = np.searchsorted(starts, key, "left"), np.searchsorted(starts, key, "right")
            if low < high:
                if own not in need:
                    need[own] = needed(own, 2), needed(own, 4)
                two_, four = need[own]
                yield from looked(left[a:b], slice(low, high), lambda part, at, found: (found >= two_[at]) | ((found >= four[at]) & (third[part, None] == third[right[at]])))

    def by_choices(some: np.ndarray, others: np.ndarray, plan: list[tuple[bool, int]]):
        """Pairs that have a choice of letters in common, each once; None where that would be more than looking at all."""
        met = []
        for ordered, letters in plan:
            met.append(_shared(*(_choices(of.codes[: of.size[part[0]], part], ordered, letters) for part in (some, others))))
        ends = np.zeros(len(some) + 1, np.int64)
        for value, low, high, _ in met:
            ends[1:] += np.bincount(value, high - low, len(some)).astype(np.int64)
        ends = np.cumsum(ends)
        if ends[-1] * 4 > len(some) * len(others):
            return None

        def pairs():
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + LOOKED, "right")) - 1)
                codes = []
                for value, low, high, owner in met:
                    a, b = np.searchsorted(value, at, "left"), np.searchsorted(value, to, "left")
                    n = high[a:b] - low[a:b]
                    j = owner[np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    codes.append(np.repeat(value[a:b], n) * len(others) + j)
                i, j = np.divmod(np.unique(np.concatenate(codes)), len(others))
                i, j = some[i], others[j]
                other = two[i] != two[j]
                yield i[other], j[other]
                at = to

        return pairs()

    def unlike():
        """Pairs with other first letters, by lengths."""
        lengths = [np.unique(of.size[part]).tolist() for part in (left, right)]
        for own in lengths[0]:
            some, rest = left[of.size[left] == own], np.ones(len(right), bool)
            for their in lengths[1]:
                plan = _plan(own, their, least)
                places = np.flatnonzero(size == their)
                found = [] if plan and _worth(own, their, len(some), len(places), plan) else None
                for part, at in unlinked(some, places) if found == [] else []:
                    pairs = by_choices(part, right[at], plan)
                    found = None if pairs is None or found is None else [*found, pairs]
                if not plan or found is not None:
                    rest[places] = False
                    yield from chain(*(found or []))
            if rest.any():
                need = needed(own, 1)
                yield from looked(some, slice(0, len(right)), lambda part, at, found: (found >= need[at]) & rest[at] & (two[part, None] != starts[at]))

    if len(left) and len(right):
        yield from links_of(chain(alike(), unlike()))


def _joining(links, group: np.ndarray) -> list[tuple]:
    """The links that join two groups; `group`, the least member of each value's, is brought up to date."""

    def root(v: int) -> int:
        while group[v] != v:
            group[v] = group[group[v]]
            v = int(group[v])
        return v

    kept = []
    for a, b, s in links:
        x, y = root(a), root(b)
        if x != y:
            group[max(x, y)] = min(x, y)
            kept.append((a, b, s))
    while (group[group] != group).any():
        group[:] = group[group]
    return kept


def near_links(values: DataFrame, least: float, spanning: bool = False) -> DataFrame:
    """(a, b, similarity) of near-equal values. `spanning` keeps a forest of each block, and of each two blocks the links that join what those leave apart."""

    def compare(part: pa.Table) -> pa.Table:
        link = part.column("w").is_valid()
        own, linked = part.filter(pc.invert(link)), part.filter(link)
        known = list(zip(linked.column("v").to_pylist(), linked.column("w").to_pylist()))
        found = list(near_in_block(part.column("x")[0].as_py(), part.column("y")[0].as_py(), own.column("mine").to_pylist(), own.column("v").to_pylist(), least, spanning, known))
        return pa.table({"a": pa.array([f[0] for f in found], pa.string()), "b": pa.array([f[1] for f in found], pa.string()), "similarity": pa.array([f[2] for f in found], pa.float64())})

    schema = "a string, b string, similarity double"
    cuts, alone = cuts_of(values), values.select("v", F.lit(None).cast("string").alias("w"))
    if not spanning or cuts == 1:
        return block_pairs(alone, cuts).groupBy("x", "y").applyInArrow(compare, schema)
    inner = cut(block_pairs(alone, cuts, True).groupBy("x", "y").applyInArrow(compare, schema))
    linked = block_pairs(alone.union(inner.select("a", "b")), cuts, False)
    return inner.union(linked.groupBy("x", "y").applyInArrow(compare, schema))
