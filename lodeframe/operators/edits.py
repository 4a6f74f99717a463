"""Pairs of texts within a number of edits, found by the pieces they must share.

Of two texts at most d edits apart, cut one into d + 1 pieces: one piece at least is untouched and lies in the other text, shifted by no
more than the edits before and after it allow. Pieces are keys of an equi-join, so only texts that share one are compared. The
number of edits allowed depends on both lengths; it is fixed for each pair of lengths that occurs. A key that many texts share is dealt
over several tasks. Texts shorter than the pieces needed meet by length alone; there are only so many of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indexed texts that share one key in one task.
TOGETHER = 1000


def _pieces(size: Column, edits: Column) -> Column:
    """(i, at, size) of each piece of a text of that length; without letters for all pieces only the empty first one."""
    n = edits + 1
    base, longer = F.floor(size / n).cast("int"), (size % n)
    first_longer = n - longer
    all_ = F.transform(
        F.sequence(F.lit(0), edits),
        lambda i: F.struct(i.alias("i"), (i * base + F.greatest(F.lit(0), i - first_longer)).alias("at"), (base + (i >= first_longer).cast("int")).alias("size")),
    )
    return F.filter(all_, lambda p: (base > 0) | (p["i"] == 0))


def _inside(text: Column, size: Column, other: Column, edits: Column) -> Column:
    """(i, piece): the parts of a text where the pieces of one of length `other` may lie."""
    shift = size - other

    def places(p: Column) -> Column:
        left = F.greatest(p["at"] - p["i"], p["at"] + shift - (edits - p["i"]), F.lit(0))
        right = F.least(p["at"] + p["i"], p["at"] + shift + (edits - p["i"]), size - p["size"])
        found = F.transform(F.sequence(left, right), lambda s: F.struct(p["i"].alias("i"), F.substring(text, s + 1, p["size"]).alias("piece")))
        return F.when(left <= right, F.array_distinct(found)).otherwise(F.array().cast("array<struct<i:int,piece:string>>"))

    return F.flatten(F.transform(_pieces(other, edits), places))


def near_texts(some: DataFrame, known: DataFrame, edits: Callable[[Column, Column], Column], reach: Callable[[Column], Column]) -> DataFrame:
    """(v, f, d): each text v of `some` with every f of `known` at most edits(length, length) apart, letters' case aside.

    `reach` gives the lengths of known texts (an array) that a text of some length has to be compared with. A pair can come more than once.
    """
    low = lambda c: F.lower(F.col(c))
    some = some.select("v", low("v").alias("x"), F.char_length("v").alias("own"), F.char_length(low("v")).alias("size"))
    known = known.select("f", low("f").alias("y"), F.char_length("f").alias("their"), F.char_length(low("f")).alias("other"))
    lengths = some.select("own", "size").distinct().withColumn("other", F.explode(reach(F.col("size"))))
    lengths = lengths.join(known.select("their", "other").distinct(), "other").withColumn("edits", edits(F.col("own"), F.col("their")).cast("int"))
    lengths = lengths.where(F.abs(F.col("size") - F.col("other")) <= F.col("edits"))
    key = F.xxhash64("their", "other", "edits", "p.i", "p.piece").alias("key")
    cut_up = F.transform(_pieces(F.col("other"), F.col("edits")), lambda p: F.struct(p["i"].alias("i"), F.substring("y", p["at"] + 1, p["size"]).alias("piece")))
    index = known.join(lengths.select("their", "other", "edits").distinct(), ["their", "other"])
    index = index.select("f", "y", "their", "other", "edits", F.explode(cut_up).alias("p")).select("f", "y", key)
    asked = some.join(lengths, ["own", "size"])
    asked = asked.select("v", "x", "their", "other", "edits", F.explode(_inside(F.col("x"), F.col("size"), F.col("other"), F.col("edits"))).alias("p")).select("v", "x", "edits", key)
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("key", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts"))
    index = index.join(shared, "key", "left").select("key", F.pmod(F.xxhash64("f"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "f", "y")
    asked = asked.join(shared, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "v", "x", "edits")
    return asked.join(index, ["key", "part"]).select("v", "f", "edits", F.levenshtein("x", "y").alias("d")).where("d <= edits").select("v", "f", "d")
