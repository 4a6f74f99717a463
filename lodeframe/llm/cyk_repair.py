"""Conversation structure repair by weighted CYK parsing over spans.

A conversation's role initials should read `(s?(ua)+)?`. The states between them are N (nothing yet), S (after a system row), U (after a user's)
and A (after an assistant's); the nonterminal `pq` derives what leads from state p to state q, and the Chomsky-normal-form rules are pq -> pr rq
for every r. A row is a terminal with weights: Keep 0, Rerole to user or assistant 3, Delete 4 (the only choice for blank and duplicate
rows), 3 more where a truncated row stays. Inserted empty rows cost 3 each; the cheapest ways to insert from state to state close each cell
on the left, so that a cell of one row is insertions, then the row's edit. A span's cell holds for each nonterminal the least (cost, audit),
where the audit spells the edits. Cells are combined bottom-up, from spans of one row to spans of two, four and so on: as every nonterminal
splits at every place, a span's cell is the same wherever it is split, and one split for each span is enough. (tests compare with all splits.)

The least audit of a span is made of least audits of its parts: audits that end with a row's own letter and spell the same number of rows
are never one the beginning of the other, so the first difference decides. Hence a long conversation can be cut into pieces of `PIECE` rows that
are parsed apart: a piece hands on the costs and the order of its audits, the cheapest sequence of states through all pieces follows from
the costs, ties from the orders, and the audits chosen are looked up in the pieces.

Rows are taken by turn (null first), then role, then the MD5 of the text, whatever their order in the table. Equal rows, turn included, are
one row with a count; all but the first are duplicates and are deleted right after it. Ranges of that order, cut by Spark, hold the rows,
so a conversation with a third of all rows lies in many tasks. Hashing the repaired text must follow its order: tasks join the texts of
their ranges, and one task for each conversation that crosses ranges reads these joined texts as a stream.

Null roles and texts are one space, as are null ids and turns where they are spelled for the damage; a null id is a conversation. Empty roles have
no initial and can only be reroled or deleted. A conversation without rows left has zeros, an empty audit and the hash of no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.session import cut

BLANKS = " \t\n\x0b\x0c\r"
PIECE = 4096
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Letters of the audit while it is made: I and J insert a user's and an assistant's row, R and S rerole to them; J and S become I and R in the end.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STEPS = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}

Cell = tuple  # sixteen entries, (cost, audit) or None, at 4 * p + q


def _closure() -> Cell:
    """Cheapest insertions from state to state."""
    cell = []
    for p in range(4):
        reached, state, letters = {p: (0, "")}, p, ""
        for _ in range(2):
            letter, to = ("J", ASSISTANT) if state == USER else ("I", USER)
            state, letters = to, letters + letter
            reached.setdefault(state, (INSERT * len(letters), letters))
        cell += [reached.get(q) for q in range(4)]
    return tuple(cell)


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * 16
    for p in range(0, 16, 4):
        for r in range(4):
            a = left[p + r]
            if a is not None:
                for q in range(4):
                    b = right[4 * r + q]
                    if b is not None:
                        cost, old = a[0] + b[0], out[p + q]
                        if old is None or cost < old[0]:
                            out[p + q] = (cost, a[1] + b[1])
                        elif cost == old[0]:
                            audit = a[1] + b[1]
                            if audit < old[1]:
                                out[p + q] = (cost, audit)
    return tuple(out)


CLOSURE = _closure()


def _leaf(kind: str) -> Cell:
    """A row's cell: a role initial (s, u, a or - for any other), upper case if the text is truncated, or x for a row that must go."""
    edits: list = [None] * 16
    for p in range(4):
        edits[5 * p] = (DELETE, "D")
        if kind != "x":
            more = TRUNCATED if kind.isupper() or kind == "+" else 0
            for letter, role in (("R", "u"), ("S", "a")):
                if (role, p) in STEPS:
                    edits[4 * p + STEPS[role, p]] = (REROLE + more, letter)
            if (kind.lower(), p) in STEPS:
                edits[4 * p + STEPS[kind.lower(), p]] = (more, "K")
    return combine(CLOSURE, tuple(edits))


LEAVES = {k: _leaf(k) for k in "suaSUAx-+"}


@lru_cache(1 << 14)
def _short(kinds: str) -> Cell:
    if len(kinds) == 1:
        return LEAVES[kinds]
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return combine(_short(kinds[:half]), _short(kinds[half:]))


def parse(kinds: str) -> Cell:
    """The cell of a span of rows, spans of 8, 16, 32, ... rows one after another."""
    if not kinds:
        return tuple((0, "") if p == q else None for p in range(4) for q in range(4))
    cells = [_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)]
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def ending(state: int) -> tuple[int, str] | None:
    """Cheapest insertions that end a conversation in this state."""
    return (0, "") if state == NOTHING else CLOSURE[4 * state + ASSISTANT]


def best_path(pieces: list[tuple[list, list]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost and states of the best way through pieces (costs, orders), sixteen entries each; costs are None where there is no way."""
    rest = [ending(s)[0] for s in range(4)]
    behind = [rest]
    for costs, _ in reversed(pieces):
        rest = [min((costs[4 * p + q] + rest[q] for q in range(4) if costs[4 * p + q] is not None), default=1 << 60) for p in range(4)]
        behind.append(rest)
    behind.reverse()
    state, path = NOTHING, []
    for (costs, orders), here, after in zip(pieces, behind, behind[1:]):
        ties = [q for q in range(4) if costs[4 * state + q] is not None and costs[4 * state + q] + after[q] == here[state]]
        to = min(ties, key=lambda q: orders[4 * state + q])
        path.append((state, to))
        state = to
    return behind[0][NOTHING], path


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies of the rows that stay, after damage by the row's checksum."""
    spelled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), spelled(role).alias("role"), spelled(text).alias("text"), (F.crc32(F.concat(spelled(conv), F.lit(":"), spelled(turn))) % 20).alias("hit"))
    changed = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("hit <> 0").select("conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))


ORDER = ("conv", "turn", "role", "digest")


def _by_order(df: DataFrame, *more: str) -> DataFrame:
    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys, *more)


def _with(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Joins rows whose keys are the same, null or not."""
    other = right.select(*(F.col(c).alias(f"{c}_" if c in keys else c) for c in right.columns))
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return left.join(other, same, how).drop(*(f"{c}_" for c in keys))


def keyed(rows: DataFrame) -> DataFrame:
    """The distinct rows of a damaged table in order, without texts: conv, turn, role, digest, copies, kind (as in `_leaf`), fault, and piece."""
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copies", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("short"))
    narrow = narrow.groupBy("conv", "turn", "role", "digest").agg(F.sum("copies").cast("long").alias("copies"), F.first("blank").alias("blank"), F.first("short").alias("short"))
    again = narrow.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("conv", "role", "digest", "first")
    met = _with(narrow, again, ("conv", "role", "digest"), "left")
    met = met.withColumn("seen", F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), F.when(F.col("short"), F.upper(initial)).otherwise(initial)).otherwise(F.when(F.col("short"), "+").otherwise("-"))
    met = met.select(*ORDER, "copies", F.when(F.col("blank") | F.col("seen"), "x").otherwise(kind).alias("kind"), F.when(F.col("blank"), "b").when(F.col("seen"), "d").when(F.col("short"), "t").otherwise("").alias("fault"))
    placed = _by_order(met).withColumn("row", F.monotonically_increasing_id())
    return cut(placed.withColumn("piece", F.floor(F.col("row") / PIECE).cast("long")))


PIECES = "conv {}, piece long, keys long, blank long, duplicate long, truncated long, illegal long, extra long, low long, high long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, costs array<long>, orders array<long>, audits array<string>"


def pieces(keys: DataFrame) -> DataFrame:
    """One row for each conversation and piece of rows, with counts and the parsed cell."""
    kind = keys.schema["conv"].dataType.simpleString()

    def summary(conv, piece: int, turns: list, roles: list, copies: list, kinds: list, faults: list) -> tuple:
        initials = [r[:1] for r in roles]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(copies) - len(copies)
        known = [t for t in turns if t is not None]
        cell = parse("".join(kinds))
        orders = [0] * 16
        for p in range(0, 16, 4):
            for place, q in enumerate(sorted((q for q in range(4) if cell[p + q]), key=lambda q: cell[p + q][1])):
                orders[p + q] = place
        blank = sum(n for n, f in zip(copies, faults) if f == "b")
        truncated = sum(f == "t" for f in faults)
        duplicate = sum(n if f == "d" else n - 1 for n, f in zip(copies, faults) if f != "b")
        return (
            conv, piece, len(turns), blank, duplicate, truncated, illegal, DELETE * (sum(copies) - len(copies)), min(known, default=None), max(known, default=None),
            sum(a != b for a, b in zip(known, known[1:])) + bool(known), known[0] if known else None, known[-1] if known else None, initials[0], initials[-1],
            [c and c[0] for c in cell], orders, [c and c[1] for c in cell],
        )

    names = [x.strip().split(" ")[0] for x in PIECES.format("x").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [[] for _ in range(5)]
        at = None
        for batch in batches:
            out = []
            for conv, turn, role, copies, sort, fault, piece in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if at != (conv, piece):
                    if at is not None:
                        out.append(summary(*at, *held))
                        held = [[] for _ in range(5)]
                    at = (conv, piece)
                for column, value in zip(held, (turn, role, copies, sort, fault)):
                    column.append(value)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, (pa.array(x, t) for x, t in zip(zip(*out), types)))))
        if at is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, (pa.array([x], t) for x, t in zip(summary(*at, *held), types)))))

    from pyspark.sql.pandas.types import to_arrow_type

    schema = PIECES.format(kind)
    types = [to_arrow_type(f.dataType) for f in keys.sparkSession.createDataFrame([], schema).schema]
    return cut(keys.select("conv", F.col("turn").cast("long"), "role", "copies", "kind", "fault", "piece").mapInArrow(run, schema))


def chosen(found: DataFrame) -> DataFrame:
    """For each piece the states it leads from and to, how many rows of its conversation come before, and the conversation's figures with its first."""
    kind = found.schema["conv"].dataType.simpleString()
    narrow = found.drop("audits").repartition("conv").sortWithinPartitions("conv", "piece")
    schema = f"conv {kind}, piece long, p int, q int, before long, keys long, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

    def settle(rows: list[dict]) -> list[dict]:
        cost, path = best_path([(r["costs"], r["orders"]) for r in rows])
        known = [r for r in rows if r["low"] is not None]
        turns = sum(r["turns"] for r in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
        gaps = max(r["high"] for r in known) - min(r["low"] for r in known) + 1 - turns if known else 0
        total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "extra", "keys")}
        illegal = total["illegal"] + sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out, before = [], 0
        for i, (row, (p, q)) in enumerate(zip(rows, path)):
            figures = {"gaps": gaps, "blank": total["blank"], "duplicate": total["duplicate"], "truncated": total["truncated"], "illegal": illegal, "cost": cost + total["extra"]} if i == 0 else dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
            out.append({"conv": row["conv"], "piece": row["piece"], "p": p, "q": q, "before": before, "keys": total["keys"], "tail": ending(q)[1] if i + 1 == len(rows) else ""} | figures)
            before += row["keys"]
        return out

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    out += settle(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if held:
            yield pa.RecordBatch.from_pylist(settle(held), arrow)

    picked = narrow.mapInArrow(run, schema)
    out = _with(picked, found.select("conv", "piece", "audits"), ("conv", "piece"))
    audit = F.element_at("audits", F.col("p") * 4 + F.col("q") + 1)
    return cut(out.withColumn("letters", F.regexp_extract_all(audit, F.lit("[IJ]*[KRSD]"), F.lit(0))).drop("audits"))


def edits(keys: DataFrame, paths: DataFrame) -> DataFrame:
    """The edits of every distinct row: conv, turn, role, digest, letters (those of insertions before it and its own, later copies' as D), place, keys."""
    first = keys.groupBy("conv", "piece").agg(F.min("row").alias("from"))
    path = paths.select("conv", "piece", "letters", "before", F.col("keys").alias("all"), "tail")
    met = _with(keys, _with(path, first, ("conv", "piece")), ("conv", "piece"))
    at = F.col("row") - F.col("from")
    place = F.col("before") + at
    own = F.concat(F.element_at("letters", (at + 1).cast("int")), F.expr("repeat('D', int(copies - 1))"))
    return met.select(*ORDER, own.alias("letters"), place.alias("place"), F.col("all").alias("keys"), F.when(place + 1 == F.col("all"), F.col("tail")).otherwise("").alias("tail"))


def _spoken(role: str, text: str, edit: dict) -> str:
    """The repaired lines of a row, each with a line break before."""
    out = []
    for letter in edit["letters"] + edit["tail"]:
        if letter in "IJ":
            out.append("\nuser:" if letter == "I" else "\nassistant:")
        elif letter != "D":
            out.append(f"\n{ {'K': role, 'R': 'user', 'S': 'assistant'}[letter] }:{text}")
    return "".join(out)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, place, keys, last and lines: repaired lines of runs of a conversation's rows, compressed, whole conversations where a range holds them."""
    kind = rows.schema["conv"].dataType.simpleString()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies within a batch are left out before they are dealt."""
        for batch in batches:
            seen, some = set(), []
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                if key not in seen:
                    seen.add(key)
                    some.append(i)
            yield batch.take(pa.array(some, pa.int64())) if len(some) < len(batch) else batch

    texts = rows.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text")
    texts = texts.mapInArrow(once, texts.schema)
    both = found.select(*ORDER, F.lit(None).cast("string").alias("text"), F.struct("letters", "place", "keys", "tail").alias("edit"))
    both = both.unionByName(texts.withColumn("edit", F.lit(None).cast(both.schema["edit"].dataType)))
    both = _by_order(both.withColumn("kind", F.col("edit").isNull().cast("int")), "kind").select("conv", "role", "text", "edit")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("conv", to_arrow_type(rows.schema["conv"].dataType)), ("place", pa.int64()), ("rows", pa.int64()), ("keys", pa.int64()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit, conv, place, count, lines, size = None, None, 0, 0, [], 0

        def made() -> dict:
            return {"conv": conv, "place": place, "rows": count, "keys": edit["keys"], "lines": zstandard.compress("".join(lines).encode("utf-8", "surrogatepass"), 1)}

        current = None
        for batch in batches:
            out = []
            for c, role, text, new in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if new is not None:
                    if edit is not None and (c != conv or size > 1 << 20):
                        out.append(made())
                        lines, size, count = [], 0, 0
                    if not count:
                        conv, place = c, new["place"]
                    edit = current = new
                    count += 1
                elif current is not None:  # the first copy
                    lines.append(_spoken(role, text, current))
                    size += len(lines[-1])
                    current = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if edit is not None:
            yield pa.RecordBatch.from_pylist([made()], schema)

    return both.mapInArrow(run, f"conv {kind}, place long, rows long, keys long, lines binary")


def hashes(runs: DataFrame) -> DataFrame:
    """conv, sha: of its repaired lines; runs of a conversation are read one after another."""
    kind = runs.schema["conv"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    type_ = to_arrow_type(runs.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, fresh = None, None, True
        for batch in batches:
            ids, shas = [], []
            for c, place, lines in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if place == 0:
                    if state is not None:
                        ids.append(conv)
                        shas.append(state.hexdigest())
                    state, conv, fresh = sha256(), c, True
                lines = zstandard.decompress(lines)
                state.update(lines[1:] if fresh else lines)  # the first line has no break before it
                fresh = fresh and not lines
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(shas, pa.string())], ["conv", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([state.hexdigest()], pa.string())], ["conv", "sha"])

    return runs.select("conv", "place", "lines").repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, f"conv {kind}, sha string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a table of rows (conv, turn, role, text, copies), as `damage` gives: its keys, the chosen paths, and the edits of every distinct row."""
    keys = keyed(df)
    paths = chosen(pieces(keys))
    return keys, paths, edits(keys, paths)


def report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damages the table, repairs it, and returns one row for each conversation with its faults, cost, audit and the hash of what was repaired."""
    rows = damage(df, conv, turn, role, text)
    _, paths, found = repair(rows)
    sha = hashes(repaired(rows, found))
    whole = F.translate(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "letters", "tail"))), lambda e: F.concat(e["letters"], e["tail"]))), "JS", "IR")
    audits = found.groupBy("conv").agg(whole.alias("audit"))
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    columns = {**dict.fromkeys(figures, "long"), "audit": "string", "sha": "string"}
    every = df.select(F.col(f"`{conv}`").alias("conv")).distinct()
    parts = [every, paths.where("cost is not null").select("conv", *figures), audits, sha]
    filled = [p.select("conv", *(F.col(c) if c in p.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items())) for p in parts]
    union = filled[0].unionByName(filled[1]).unionByName(filled[2]).unionByName(filled[3])
    out = union.groupBy("conv").agg(*(F.max(c).alias(c) for c in columns))
    none = sha256(b"").hexdigest()
    return out.select(F.col("conv").alias(conv), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in figures), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(none)).alias("repaired_sha256"))
