import heapq
import random
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import cyk_repair as m

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, row long, kind string, piece long, conv string, letters string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        spell = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{spell(conv)}:{spell(turn)}".encode()) % 20
        role, text = spell(role), spell(text)
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: ((r[1] is not None, r[1] or 0), r[2].encode(), md5(r[3].encode()).digest()))


def cheapest(rows, forced, truncated):
    """Least (cost, audit, what was done) by search over all edits, one letter at a time."""
    allowed = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state, "") in done:
            continue
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        done.add((i, state, ""))
        steps = []
        for role in ("user", "assistant"):
            if (role[0], state) in allowed:
                steps.append((3, "I", i, allowed[role[0], state], (f"{role}:",)))
                if i < len(rows) and not forced[i]:
                    steps.append((3 + 3 * truncated[i], "R", i + 1, allowed[role[0], state], (f"{role}:{rows[i][3]}",)))
        if i < len(rows):
            steps.append((4, "D", i + 1, state, ()))
            role = rows[i][2]
            if not forced[i] and (role[:1], state) in allowed:
                steps.append((3 * truncated[i], "K", i + 1, allowed[role[:1], state], (f"{role}:{rows[i][3]}",)))
        for more, letter, j, to, line in steps:
            heapq.heappush(heap, (cost + more, audit + letter, j, to, (*lines, *line)))


def brute(rows):
    out = []
    every = damaged(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        own = [r for r in every if r[0] == conv]
        seen, counts, forced, truncated = set(), [0, 0, 0], [], []
        for _, _, role, text in own:
            blank, again = not text.strip(BLANKS), (role, text) in seen
            cut = not blank and not again and text.rstrip(BLANKS)[-1] not in ".!?"
            for k, hit in enumerate((blank, again and not blank, cut)):
                counts[k] += hit
            seen.add((role, text))
            forced.append(blank or again)
            truncated.append(cut)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, forced, truncated)
        out.append((conv, gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, m.report(df).collect()), key=repr)


def made(seed, conversations=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ü"])
            text = rng.choice(["Yes.", "No!", "Why", "", " \n\t", None, "So it is?", "Ends. \n", " ", "Ω", "a.b", f"w{rng.randint(0, 99)}."])
            rows.append((c * 3, rng.choice([t, t, t, t + 2, None]), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, "user", "?"), (-5, -3, "user", "a."), (-5, 4, "user", "a."), (7, None, None, None)]
    return rows


def table(spark, rows):
    more = [(*r, 1, "k", 2, "c", "l") for r in rows]
    random.Random(1).shuffle(more)
    return spark.createDataFrame(more, SCHEMA).repartition(3)


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_equals_search_over_all_edits(spark, monkeypatch, piece):
    """Also with conversations cut into pieces of a few rows."""
    monkeypatch.setattr(m, "PIECE", piece)
    rows = made(piece)
    rows += rows[:9]
    assert found(table(spark, rows)) == brute(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(m, "PIECE", 50)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"w{rng.randint(0, 300)}{rng.choice(['.', ''])}") for t in range(700)] + [(1, 5, "user", "Same.")] * 40
    assert found(table(spark, rows)) == brute(rows)


def whole_cyk(kinds):
    """The classical table: every span at every split."""
    n = len(kinds)
    cells = {(i, i + 1): m.LEAVES[k] for i, k in enumerate(kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            tried = [m.combine(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            assert len(set(tried)) == 1  # wherever it is split
            cells[i, i + size] = tried[0]
    return cells[0, n]


def test_every_split_gives_the_same_cell():
    rng = random.Random(2)
    for _ in range(40):
        kinds = "".join(rng.choice("suaSUAx-+") for _ in range(rng.randint(1, 14)))
        assert m.parse(kinds) == whole_cyk(kinds)


def test_names_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.report(empty).count() == 0
    df = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "assistant", "Ho.")], "`my.conv` string, turn int, `a role` string, text string")
    row = m.report(df, conv="my.conv", role="a role").collect()[0]
    assert row["my.conv"] == "x" and row.illegal == 0


def test_edits_are_rows(spark):
    rows = table(spark, [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Ho.")]).select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.lit(1).alias("copies"))
    _, paths, edits = m.repair(rows)
    assert [r.letters for r in edits.orderBy("place").collect()] == ["R", "K"] and paths.collect()[0].cost == 3
