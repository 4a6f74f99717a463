"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the matches of three patterns. Every candidate value, those and long loose tokens, is hashed and counted by distinct
repositories and owners over the whole table. A value that `WIDE` owners or more share is an example that people copy; one of fewer owners
that looks alive (letters and digits mixed, enough distinct characters, no placeholder word) is a credential of its owner. Loose tokens of
the second sort add spans to the base ones. All positions are code points, ends exclusive.

Positions come from splitting the text at the pattern: what lies between matches and the matches themselves add up, in runs, so that a
text with very many matches does not cost their square. Owners are counted from
distinct (hash, repository, owner), so a value in a third of all rows is a few rows there. Null and empty texts have no spans. Repeated rows
have the same spans; a null owner or repository counts as none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.session import cut

#: Fixed: the three kinds of base spans; assignments need six characters of value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: A loose token of the alphabet of keys, not part of a longer one.
LOOSE = r"[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "loose")
VALUE_CHARS, WIDE = 6, 3
#: A live value has so many distinct characters, or seven of ten of its own if it is short.
DISTINCT, SHARE = 10, 0.7
#: Matches of a text are added up in runs of so many.
RUN = 256
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|1234567|abcdef0|todo"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """The pattern's leftmost matches that don't overlap, as spans; the value is what `group` holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value"))
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda n, x: n + x)
    run = lambda i: F.floor(i / RUN).cast("int")

    def placed(steps: Column, lengths: Column, before: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            begin = F.element_at(before, run(i) + 1) + total(F.slice(lengths, run(i) * RUN + 1, i % RUN)) + x.gap
            return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + x.size).alias("end"), x.value.alias("value"))

        return F.transform(steps, span)

    def runs(lengths: Column) -> Column:
        """What lies before each run of matches."""
        return F.transform(F.sequence(F.lit(0), run(F.size(lengths))), lambda r: total(F.slice(lengths, F.lit(1), r * RUN)))

    spans = _let(steps, lambda s: _let(F.transform(s, lambda x: x.gap + x.size), lambda n: _let(runs(n), lambda before: placed(s, n, before))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    assigned = F.filter(matches(text, ASSIGN, "assign", 2), lambda s: F.length(s.value) >= VALUE_CHARS)
    return F.array_sort(F.concat(assigned, matches(text, ACCESS, "access"), matches(text, HEX, "hex")))


def loose_spans(text: Column, base: Column) -> Column:
    """Tokens that look like keys and overlap no base span."""
    shaped = F.filter(matches(text, LOOSE, "loose"), lambda s: alive(s.value))
    return F.when(F.size(base) == 0, shaped).otherwise(F.filter(shaped, lambda s: ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end))))


def alive(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= F.least(F.lit(DISTINCT), F.ceil(F.length(value) * SHARE))) & ~value.rlike(PLACEHOLDER)


def text_of(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s.start.cast("string"), s.end.cast("string"))), ",")


def found_in(df: DataFrame, text: str, id_col: str, repository: Column, owner: Column) -> DataFrame:
    """Written rows of id, digest of the text, repository, owner, base and loose: each pattern runs once over each text."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), repository.alias("repository"), owner.alias("owner"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t"))).withColumn("loose", loose_spans(F.col("t"), F.col("base")))
    return cut(rows.select("id", F.xxhash64("t").alias("digest"), "repository", "owner", "base", "loose"))


def ownership(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """hash, repositories, owners and whether the value is owner-specific and alive, for each candidate value."""
    spans = found.select("repository", "owner", F.explode(F.concat("base", "loose")).alias("s"))
    seen = spans.select(F.sha2("s.value", 256).alias("hash"), alive(F.col("s.value")).alias("alive"), "repository", "owner").distinct()
    counted = seen.groupBy("hash", "alive").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    return counted.select("hash", "repositories", "owners", ((F.col("owners") < wide) & F.col("alive")).alias("live"))


def scan(df: DataFrame, text: str = "text", id_col: str = "doc_id", repository: Column | None = None, owner: Column | None = None, wide: int = WIDE) -> DataFrame:
    """One row for each row: id, digest, base spans, and `live`, the spans (base or loose) of owner-specific live-looking values."""
    found = found_in(df, text, id_col, repository if repository is not None else F.lit(None).cast("string"), owner if owner is not None else F.lit(None).cast("string"))
    known = ownership(found, wide).where("live").select("hash")
    spans = found.where(F.size("base") + F.size("loose") > 0).select("id", "digest", "base", "loose").distinct()
    spans = spans.select("id", "digest", F.explode(F.concat("base", "loose")).alias("s"))
    live = spans.withColumn("hash", F.sha2("s.value", 256)).join(known, "hash").groupBy("id", "digest").agg(F.array_sort(F.collect_set("s")).alias("live"))
    out = found.join(live.withColumnRenamed("id", "own").withColumnRenamed("digest", "of"), F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left")
    return out.select("id", "digest", "base", F.coalesce("live", F.array().cast(f"array<{SPAN}>")).alias("live")).withColumnRenamed("id", id_col)


def redact(df: DataFrame, text: str = "text", id_col: str = "doc_id", repository: Column | None = None, owner: Column | None = None, mark: str = "<secret>") -> DataFrame:
    """The rows, all of them and with all columns; values of owner-specific live-looking credentials are replaced by the mark in the text."""
    spans = scan(df, text, id_col, repository, owner).where(F.size("live") > 0).select(F.col(id_col).alias("own"), F.col("digest").alias("of"), "live").distinct()
    rows = df.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    rows = rows.withColumn("digest", F.xxhash64(body))
    joined = rows.join(spans, F.col("row").getField(id_col).eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left")

    def replace(state: Column, s: Column) -> Column:
        begin = s.end - F.length(s.value)
        return F.when(begin < state.at, F.struct(F.greatest(state.at, s.end).alias("at"), state.out.alias("out"))).otherwise(F.struct(s.end.alias("at"), F.concat(state.out, F.substring(body, state.at + 1, begin - state.at), F.lit(mark)).alias("out")))

    changed = F.aggregate("live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), replace, lambda s: F.concat(s.out, F.substring(body, s.at + 1, F.length(body))))
    new = F.when(F.col("live").isNull(), F.col("row").getField(text)).otherwise(changed)
    columns = {text: new} | ({"n_chars": F.when(F.col("live").isNull(), F.col("row").getField("n_chars")).otherwise(F.length(new).cast(df.schema["n_chars"].dataType))} if "n_chars" in df.columns else {})
    return joined.select(*(columns.get(c, F.col("row").getField(c)).alias(c) for c in df.columns))
