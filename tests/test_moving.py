"""Windows that move along an order, and texts within a number of edits, against plain loops."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import edits
from lodeframe.operators.moving import cell_rows, moving_median, select


def test_select_finds_the_kth_of_a_range_and_a_bag():
    rng = np.random.default_rng(5)
    for kinds in (1, 2, 7, 40):
        sequence, weights = rng.integers(0, kinds, 60), rng.integers(0, 4, kinds)
        lo = rng.integers(0, 60, 200)
        hi = lo + rng.integers(0, 60, 200) % (61 - lo)
        size = hi - lo + weights.sum()
        lo, hi, size = (x[size > 0] for x in (lo, hi, size))
        k = rng.integers(0, 1 << 30, len(size)) % size
        whole = [sorted([*sequence[a:b], *np.repeat(np.arange(kinds), weights)]) for a, b in zip(lo, hi)]
        assert list(select(sequence, weights, lo, hi, k)) == [w[i] for w, i in zip(whole, k)]


def _values(kind, n):
    rng = random.Random(n)
    return {
        "spread": [rng.gauss(0, 1) for _ in range(n)], "rising": [i * 0.5 + rng.random() for i in range(n)], "one": [3.0] * n,
        "hot": [rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 9)]) for _ in range(n)], "steps": [float(i // 37 % 5) for i in range(n)],
    }[kind]


@pytest.mark.parametrize("kind", ["spread", "rising", "one", "hot", "steps"])
def test_moving_median_equals_loop(spark, kind):
    for n, before, after, rows in ((300, 40, 39, 10), (300, 40, 39, 1000), (211, 9, 9, 10), (211, 10, 9, 10), (211, 20, 20, 10), (90, 400, 399, 7), (1, 3, 3, 5), (23, 5, 4, 1)):
        values = _values(kind, n)
        df = spark.createDataFrame([(f"k{i}", v, i) for i, v in enumerate(values)], "key string, value double, _pos long")
        got = {r["key"]: r for r in moving_median(df, before, after, rows).collect()}
        assert len(got) == n
        for i in range(n):
            around = values[max(0, i - before) : i + after + 1]
            r = got[f"k{i}"]
            assert (r["value"], r["size"], r["median"]) == (values[i], len(around), pytest.approx(statistics.median(around)))
            assert r["sd"] is None if len(around) < 2 else r["sd"] == pytest.approx(statistics.stdev(around), abs=1e-6)
    assert moving_median(spark.createDataFrame([], "key int, value double, _pos long"), 9, 9, 3).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("together", [1000, 3])
def test_near_texts_finds_every_pair(spark, monkeypatch, together):
    from lodeframe.operators.detect.consistency import _edits

    monkeypatch.setattr(edits, "TOGETHER", together)
    rng = random.Random(11)
    known = sorted({"".join(rng.choice("abCé") for _ in range(rng.randint(0, 14))) for _ in range(120)})
    some = set()
    for t in known:
        for _ in range(2):
            s = list(t)
            for _ in range(rng.randint(0, 5)):
                at = rng.randint(0, len(s))
                s[at : at + rng.randint(0, 1)] = [rng.choice("abCé")] * rng.randint(0, 2)
            some.add("".join(s))
    some = sorted(some)
    allowed = lambda a, b: int(max(2.0, max(a, b, 1) * 0.3))
    want = {(v, f, d) for v in some for f in known if (d := _distance(v.lower(), f.lower())) <= allowed(len(v), len(f))}
    frames = spark.createDataFrame([(v,) for v in some], "v string"), spark.createDataFrame([(f,) for f in known], "f string")
    reach = lambda n: F.sequence(F.greatest(F.lit(0), n - 9), n + 9)
    assert {tuple(r) for r in edits.near_texts(*frames, _edits, reach).collect()} == want


def test_pieces_are_spread_over_keys(spark):
    """Random texts of one length share few pieces: no key holds more than a hundredth of the pairs compared."""
    texts = spark.range(700).select(F.md5(F.col("id").cast("string")).alias("f"))
    size, most = F.lit(32), F.lit(9)
    keys = texts.select("f", F.explode(F.transform(edits._pieces(size, most), lambda p: F.struct(p["i"].alias("i"), F.substring("f", p["at"] + 1, p["size"]).alias("piece")))).alias("p"))
    counts = [r["n"] for r in keys.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(counts) == 7000 and max(n * n for n in counts) < 0.01 * sum(n * n for n in counts)


def test_density_with_far_values_equals_the_sum(spark):
    from lodeframe.operators.profile.numeric import kde_points

    rng = np.random.default_rng(2)
    for values in (rng.normal(0, 1, 3000), np.concatenate([rng.normal(0, 1, 3000), [1e6]]), np.concatenate([rng.normal(0, 1, 2000), rng.normal(400, 1, 30)])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        h = values.std(ddof=1) * len(values) ** -0.2
        got = kde_points(df, "v")
        want = [np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi)) for x, _ in got]
        assert [y for _, y in got] == pytest.approx(want, rel=1e-6, abs=1e-9 * max(want))


@pytest.mark.parametrize("rows", [100, 2000])
def test_every_tree_gets_its_rows(spark, rows, monkeypatch):
    from lodeframe.operators.detect import outlying

    seen = []
    monkeypatch.setattr(outlying, "_mean_depth", lambda n: seen.append(n) or 1.0)
    points = spark.range(rows).select("id", F.array(F.col("id").cast("double")).alias("v"))
    assert outlying.isolation_scores(points, trees=5, sample=64).count() == rows
    assert set(seen) == {64}


def _states(text, sep):
    """Plain reading of a line from both states by the rules of quoting."""
    text = text.replace('""', "")

    def outside(t):
        at = 0
        while at <= len(t):
            if t[at:].lstrip(" \t").startswith('"'):
                end = t.find('"', t.index('"', at) + 1)
                if end < 0:
                    return True
                at = end + 1
            nxt = t.find(sep, at)
            if nxt < 0:
                return False
            at = nxt + 1
        return False

    for i, x in enumerate(text):
        rest = text[i + 1 :].lstrip(" \t")
        if x == '"' and (not rest or rest[0] == sep):
            return outside(text), outside("x" + text[i + 1 :])
    return outside(text), True


@pytest.mark.parametrize("sep", [",", "|"])
def test_lines_are_read_from_both_states(spark, sep):
    from lodeframe.sources.readers import _quoting_states

    rng = random.Random(3)
    lines = sorted({"".join(rng.choice(['"', '"', sep, "a", " "]) for _ in range(rng.randint(0, 9))) for _ in range(1500)})
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r[0]: (r[1], r[2]) for r in frame.select("value", *_quoting_states(F.col("value"), sep)).collect()}
    assert {x: got[x] for x in lines} == {x: _states(x, sep) for x in lines}


@pytest.mark.parametrize("stretch", [1, 3, 100_000])
def test_stray_quotes_gather_nothing(spark, folder, stretch, monkeypatch):
    from lodeframe.sources import readers as R

    joined = R.joined_lines
    monkeypatch.setattr(R, "joined_lines", lambda *a, **k: joined(*a, **k, stretch=stretch))
    lines = ["a,b", '1,"two', 'lines"', '2,"stray', *(f"{i},plain" for i in range(3, 30)), '30,"four', "", 'quoted ""lines""', 'end"', '31,"x,y"', '32,"never closed', "33,last"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{folder}/csv")
    records = {r["row_number"]: (r["value"], r["unclosed"]) for r in R.numbered_records(spark, f"{folder}/csv", multiline=True, longest=4).collect()}
    assert records[2] == ('1,"two\nlines"', False) and records[4] == ('2,"stray', True) and records[5] == ("3,plain", False)
    assert records[31] == (lines[30], False) and records[36] == (lines[35], False) and records[37] == (lines[36], True)
    assert max(records) == len(lines) and {n for n, (_, stray) in records.items() if stray} == {4, 32, 37}
    assert {(r["row_number"], r["issue"]) for r in R.malformed_rows(spark, f"{folder}/csv", multiline=True).collect() if r["issue"] == "unclosed quote"} == {(37, "unclosed quote")}


def test_counts_by_cell_and_bucket_stay_fewer_than_the_rows():
    for n in (10_000, 3_000_000, 18_000_000):
        rows = cell_rows(n // 40, n // 40, 50)
        assert -(-n // rows) * (2 + 2 * (n // 20) // rows) <= n / 2  # with cells of 50 rows: 0.44 n, 120 n and 720 n


def test_small_cells_in_a_wide_window(spark):
    n = 4000
    value = [float(i * 7919 % 997) for i in range(n)]
    got = {r["key"]: r for r in moving_median(spark.createDataFrame([(i, value[i], i) for i in range(n)], "key int, value double, _pos long"), 1000, 999, 2).collect()}
    for i in range(0, n, 97):
        w = value[max(0, i - 1000) : i + 1000]
        assert got[i]["median"] == float(np.median(w)) and got[i]["size"] == len(w)
