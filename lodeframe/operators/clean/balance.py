"""Class imbalance and imputation from neighbours. Every draw is a hash of the row's key, never a random number."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, facts, numeric_columns, q
from lodeframe.operators.clean.rows import attach
from lodeframe.operators.neighbours import nearest, points
from lodeframe.operators.ordered import with_position
from lodeframe.session import cut


#: Copies of a row are dealt over tasks in runs of this many.
RUN = 1_024


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    """(class, n): a row for each class that is not null, joined wherever sizes are needed, so that classes may be many."""
    return df.where(q(target).isNotNull()).groupBy(q(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _extremes(sizes: DataFrame) -> tuple[int, int]:
    found = facts(sizes, {"most": F.max("n"), "least": F.min("n")})
    return found["most"] or 0, found["least"] or 0


def draw(seed: int, *columns: Column) -> Column:
    """A number below 2^60 from the spelled columns: the first 15 hex digits of their MD5."""
    spelled = F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(spelled), 1, 15), 16, 10).cast("long")


def _drawn(df: DataFrame, target: str, key: str, seed: int) -> DataFrame:
    """_pos: the row's place in its class by the draw of its key."""
    hashed = df.withColumn("_h", draw(seed, q(key)))
    return with_position(hashed, "_h", key, [target]).drop("_h")


def _with_sizes(df: DataFrame, target: str, sizes: DataFrame) -> DataFrame:
    """_size: of the row's class, null where the class is."""
    return df.join(sizes.select(F.col("class").alias("_class"), F.col("n").alias("_size")), q(target) == F.col("_class"), "left").drop("_class")


def _repeated(df: DataFrame, copies: Column) -> DataFrame:
    """Each row as often as `copies` says, with `_i` from 1; long runs of copies of one row are made by many tasks."""
    counted = df.withColumn("_copies", copies)
    many = (facts(counted, {"m": F.max("_copies")})["m"] or 0) > RUN
    runs = counted.where("_copies > 0").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN))))
    runs = runs.repartition("_run", "_copies") if many else runs
    last = F.least(F.col("_copies"), (F.col("_run") + 1) * RUN)
    return runs.withColumn("_i", F.explode(F.sequence(F.col("_run") * RUN + 1, last))).drop("_run", "_copies")


def oversample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Every class raised to the size of the largest by repeating rows, all rows of a class equally often give or take one."""
    sizes = class_sizes(df, target)
    most, _ = _extremes(sizes)
    placed = _with_sizes(_drawn(df, target, key, seed), target, sizes)
    copies = F.floor(F.lit(most) / F.col("_size")) + (F.col("_pos") < F.lit(most) % F.col("_size")).cast("long")
    return _repeated(placed, F.coalesce(copies, F.lit(1).cast("long"))).select(*[q(c) for c in df.columns])


def undersample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest."""
    _, least = _extremes(class_sizes(df, target))
    placed = _drawn(df.where(q(target).isNotNull()), target, key, seed)
    return placed.where(F.col("_pos") < least).drop("_pos")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (classes * n_class), to four places."""
    sizes = class_sizes(df, target)
    total = facts(sizes, {"n": F.sum("n"), "classes": F.count(F.lit(1))})
    return sizes.select("class", F.round(F.lit(float(total["n"] or 0)) / (F.lit(total["classes"]) * F.col("n")), 4).alias("weight"))


def smote_points(df: DataFrame, target: str, key: str, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """(class, id, i, neighbour, u, point): the i-th new point of a row, a share u of the way to one of its k nearest of the same class."""
    sizes = class_sizes(df, target)
    most, _ = _extremes(sizes)
    vector = F.array(*[F.coalesce(clean(df, c).cast("double"), F.lit(0.0)) for c in features])
    small = sizes.where(F.col("n") < most).select(F.col("class").alias("_class"), "n")
    own = cut(points(df.join(small, q(target) == F.col("_class")), key, vector, q(target).alias("g"), F.col("n")))
    near = cut(nearest(own.drop("n"), own.drop("n"), k, other=True))
    placed = with_position(own.withColumn("_h", draw(seed, F.col("id"))), "_h", "id", ["g"]).drop("_h")
    short = F.lit(most) - F.col("n")
    draws = _repeated(placed, F.floor(short / F.col("n")) + (F.col("_pos") < short % F.col("n")).cast("long")).drop("_pos", "n")
    draws = draws.withColumns({
        "rank": (F.pmod(draw(seed, F.col("id"), F.col("_i")), F.lit(k)) + 1).cast("int"),
        "u": F.pmod(draw(seed + 1, F.col("id"), F.col("_i")), F.lit(1 << 30)) / F.lit(float(1 << 30)),
    })
    chosen = draws.join(near.select("id", "rank", "neighbour"), ["id", "rank"])
    ends = chosen.join(own.select(F.col("id").alias("neighbour"), F.col("v").alias("w")), "neighbour")
    between = F.zip_with("v", "w", lambda a, b: a + F.col("u") * (b - a))
    return ends.select(F.col("g").alias("class"), "id", F.col("_i").alias("i"), "neighbour", "u", between.alias("point"))


def smote(df: DataFrame, target: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows of the smaller classes joined by new points on the way to one of their k nearest of the same class.

    New rows have numbers only; their other columns and their key are null.
    """
    _, least = _extremes(class_sizes(df, target))
    k = min(k, least - 1)
    features = [c for c in numeric_columns(df) if c not in (target, key)]
    if k < 1 or not features:
        return oversample(df, target, key, seed)
    new = cut(smote_points(df, target, key, features, k, seed).select("class", "point"))
    at = {f: F.col("point")[i] for i, f in enumerate(features)}
    made = new.select(*[(at[x] if x in at else F.col("class") if x == target else F.lit(None)).cast("double" if x in at else df.schema[x].dataType).alias(x) for x in df.columns], F.lit(True).alias("_new"))
    plain = df.select(*[q(x).cast("double").alias(x) if x in at else q(x) for x in df.columns], F.lit(False).alias("_new"))
    return plain.unionByName(made)


def impute_knn(df: DataFrame, cols: list[str], key: str, k: int = 5) -> DataFrame:
    """Nulls replaced by the mean over the k nearest rows that know the value.

    Distance is Euclidean over the columns both rows know, scaled up for those they do not. Rows are taken by which columns
    they know (a few patterns per table), so that within one pair of patterns it is a plain distance.
    """
    numbers = [c for c in numeric_columns(df) if c != key]
    cols = [c for c in cols if c in numbers]
    wide = df.select(q(key).alias("id"), F.array(*[clean(df, c).cast("double") for c in numbers]).alias("x"))
    known = F.concat(*[F.when(F.col("x")[i].isNull(), "0").otherwise("1") for i in range(len(numbers))])
    wide = wide.withColumn("pattern", known)
    patterns = sorted(r["pattern"] for r in wide.select("pattern").distinct().collect())
    found = None
    for c in cols:
        at = numbers.index(c)
        askers, givers = [p for p in patterns if p[at] == "0"], [p for p in patterns if p[at] == "1"]
        candidates = None
        for a, g in product(askers, givers):
            common = [i for i in range(len(numbers)) if a[i] == "1" and g[i] == "1"]
            if not common:
                continue
            vector = F.array(*[F.col("x")[i] for i in common])
            side = {p: wide.where(F.col("pattern") == p).select("id", vector.alias("v"), "x") for p in (a, g)}
            near = nearest(side[a].select("id", "v"), side[g].select("id", "v"), k)
            factor = (len(numbers) / len(common)) ** 0.5
            near = near.select("id", "neighbour", (F.col("distance") * F.lit(factor)).alias("distance"))
            candidates = near if candidates is None else candidates.unionByName(near)
        if candidates is None:
            continue
        w = Window.partitionBy("id").orderBy("distance", "neighbour")
        best = candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        values = wide.select(F.col("id").alias("neighbour"), F.col("x")[at].alias("y"))
        means = best.join(values, "neighbour").groupBy("id").agg(F.avg("y").alias("y")).withColumn("c", F.lit(c))
        found = means if found is None else found.unionByName(means)
    if found is None:
        return df
    filled = found.groupBy("id").agg(*[F.max(F.when(F.col("c") == c, F.col("y"))).alias(f"_f_{i}") for i, c in enumerate(cols)])
    joined = attach(df, filled.withColumnRenamed("id", key), [key])
    fills = {c: F.coalesce(clean(df, c).cast("double"), F.col(f"_f_{i}")) for i, c in enumerate(cols)}
    return joined.select(*[fills[c].alias(c) if c in fills else q(c) for c in df.columns])
