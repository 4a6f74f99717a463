"""Licence families of paragraphs by a trained classifier, in DataFrame functions and Spark's own logistic regression.

A paragraph is a line with a word. Its features are the words and pairs of neighbouring words that occur in the templates, except those
that the unknown class uses too, in one of `USUAL` of its paragraphs or more: a sparse vector without entries for ordinary prose. The
classes are the families and `unknown`, which is learned from every distinct paragraph without licence words and without agreement with a
template of any family, half of them kept back for calibration, beside sentences that use licence words for something else. A paragraph
counts once, however many rows have it; those of equal features are one row with a weight. A prediction counts if its probability exceeds
what all but `FALSE_SHARE` of the paragraphs kept back reach, and is confirmed if pairs of words agree with a template of the family:
`CONFIRM` of the template's or of the paragraph's.

Learning and scoring cover every paragraph of every text; a caller may bound the paragraphs learned (`unknown`, those of up to
`UNKNOWN_CHARS` characters with the least hashes). One without any feature gets the unknown class without asking the model. Null and
empty texts have no paragraphs. Repeated rows give repeated findings.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators.ordered import cumulative
from lodeframe.session import cut

#: Fixed: the notices and characteristic sentences by which licences of each family are announced.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
#: Licence words in another sense, for the unknown class.
OTHER = [
    "The driver showed his license to the officer.", "A fishing license costs twenty dollars this year.", "The version of the story that the public heard was not complete.", "Researchers at MIT published a general study of public software.",
    "The new version 2.0 of the game was released on Friday.", "She works for a software foundation in the city.", "The work was published under the title of an earlier novel.", "Apache helicopters flew over the valley, version after version of the report said.",
    "All rights reserved by the author and the publisher.", "Permission to enter the building was granted by the manager.", "The terms of the contract are subject to a later review.", "He is free to use the common room under the general rules.",
    "The license plate was found in the public park.", "Creative work is common in this school.", "The source of the river is in the mountains.", "They released the birds under the bridge.",
]
UNKNOWN_CHARS, USUAL, FALSE_SHARE, CONFIRM, FLOOR = 2000, 2000, 0.001, 0.6, 0.5
#: Distinct feature vectors in a partition that the model is fitted to.
PART = 50_000
NONE = "unknown"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and plus signs, with full stops inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9+](?:[a-z0-9.+]*[a-z0-9+])?"), F.lit(0))


def pairs_of(words: Column) -> Column:
    last = F.size(words) - 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(words, F.lit(1), F.greatest(last, F.lit(0))), F.slice(words, F.lit(2), F.greatest(last, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def grams_of(words: Column) -> Column:
    return F.concat(words, pairs_of(words))


def lines_of(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """id, paragraph (line number from 0) and line."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(F.col(f"`{text}`").cast("string"), "\n")).alias("paragraph", "line"))


def with_words(lines: DataFrame) -> DataFrame:
    """The lines with a word, and their words. Exploding a list of one keeps them from being worked out again by each filter on them."""
    return lines.select("*", F.explode(F.array(words_of(F.col("line")))).alias("words")).where(F.size("words") > 0)


def templates_of(spark: SparkSession) -> DataFrame:
    """family, line and words of each template."""
    texts = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.createDataFrame(texts, "family string, line string").withColumn("words", words_of(F.col("line")))


def pairs_by_family(templates: DataFrame) -> dict[str, list[list[str]]]:
    found: dict = {f: [] for f in TEMPLATES}
    for r in templates.select("family", pairs_of(F.col("words")).alias("p")).collect():
        found[r.family].append(r.p)
    return found


def agreement(pairs: dict[str, list[list[str]]], family: Column | None = None, own: Column | None = None, size: Column | None = None) -> Column:
    """The best share of word pairs in common with a template of the family, or of any family.

    `own` and `size`, if given, are the distinct word pairs, at least those of templates, and how many there are in all."""
    own = F.array_distinct(pairs_of(F.col("words"))) if own is None else own
    size = F.size(own) if size is None else size
    templates = F.array(*(F.struct(F.lit(f).alias("family"), F.array_distinct(F.array(*map(F.lit, t))).alias("pairs")) for f, ts in pairs.items() for t in ts if t))

    def share(t: Column) -> Column:
        both = F.size(F.array_intersect(own, t.pairs))
        return F.greatest(both / F.size(t.pairs), F.when(both > 1, both / size).otherwise(0.0))

    meant = templates if family is None else F.filter(templates, lambda t: t.family == family)
    return F.coalesce(F.array_max(F.transform(meant, share)), F.lit(0.0))


def plain_line() -> Column:
    """Whether a line may stand for the unknown class: it has a word and no licence word."""
    return F.lower("line").rlike("[a-z0-9]") & ~F.lower("line").rlike(r"licen[cs]e|copyright|\bcc[ 0]|gnu")


def learned(rows: DataFrame, pairs: dict[str, list[list[str]]], vocabulary: list[str]) -> DataFrame:
    """half, grams (sorted, of the vocabulary) and n, the number of distinct lines that have them, of the rows (line, words) that agree with
    no template. Lines are told apart by 128 bits of hashes, so no text is shuffled."""

    listed = {kind: [g for g in vocabulary if (" " in g) == kind] for kind in (False, True)}

    def among(words: Column, kind: bool) -> Column:
        return F.array_distinct(F.filter(words, lambda g: g.isin(listed[kind])))

    def once(df: DataFrame, **columns: Column) -> DataFrame:
        made = df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_made"))
        return made.select(*df.columns, *(f"_made.{k}" for k in columns))

    rows = once(rows.select("line", "words"), single=among(F.col("words"), False))
    close = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.when(a.isin(listed[False]) & b.isin(listed[False]), F.concat_ws(" ", a, b)))
    rows = once(rows, double=F.when(F.size("single") > 0, among(close, True)).otherwise(F.array().cast("array<string>")))
    rows = once(rows, size=F.when(F.size("double") > 0, F.size(F.array_distinct(pairs_of(F.col("words"))))).otherwise(0))
    rows = rows.where((F.size("double") == 0) | (agreement(pairs, own=F.col("double"), size=F.col("size")) < CONFIRM))
    half = F.pmod(F.xxhash64(F.array_join("words", " "), F.lit(1)), F.lit(2))
    grams = F.array_sort(F.concat("single", "double"))
    lines = rows.select(F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(2)).alias("h2"), half.alias("half"), grams.alias("grams"))
    return lines.dropDuplicates(["h", "h2"]).groupBy("half", "grams").agg(F.count("*").alias("n"))


def drawn(lines: DataFrame, pairs: dict[str, list[list[str]]], unknown: int) -> DataFrame:
    """line and words of the `unknown` first distinct paragraphs by hash that neither use licence words nor agree with a template.

    Distinct hashes are counted by their number of bits, which tells below what size of hash there are enough; only paragraphs below it
    are compared as texts, so no task sees more than a few times the sample."""
    bits = F.floor(F.log2(F.shiftrightunsigned("h", 1).cast("double") + 1))
    plain = (F.length("line") <= UNKNOWN_CHARS) & plain_line()
    counts = lines.where(plain).select(F.xxhash64("line").alias("h")).distinct().groupBy(bits.alias("bits")).count().collect()  # one row for each number of bits
    most, total = -1, 0
    for r in sorted(counts, key=lambda r: r.bits):
        if total < 2 * unknown:
            most, total = r.bits, total + r["count"]
    low = lines.select("line", F.xxhash64("line").alias("h")).where(bits <= most).where(plain).select("line", F.shiftrightunsigned("h", 1).alias("h"))
    once = with_words(low.dropDuplicates(["h", "line"]))
    return once.where(agreement(pairs) < CONFIRM).orderBy("h", "line").limit(unknown).select("line", "words")


class Classifier:
    """Vocabulary, model, probability that a prediction must exceed, and the templates' word pairs."""

    def __init__(self, lines: DataFrame, unknown: int | None = None):
        """`lines` has the paragraphs (line) from which the unknown class is learned: all, or `unknown` of them."""
        spark = lines.sparkSession
        templates = templates_of(spark)
        self.pairs = pairs_by_family(templates)
        vocabulary = sorted({r.g for r in templates.select(F.explode(grams_of(F.col("words"))).alias("g")).distinct().collect()})
        source = with_words(lines.where(plain_line())) if unknown is None else drawn(lines, self.pairs, unknown)
        paragraphs = cut(learned(source, self.pairs, vocabulary))
        self.n_learned, self.n_kept_back = (paragraphs.where(F.col("half") == h).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for h in (0, 1))
        other = spark.createDataFrame([(t,) for t in OTHER], "line string").select(words_of(F.col("line")).alias("words"))
        often = {r.g: r.n for r in paragraphs.where("half = 0").select(F.explode("grams").alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n")).collect()}  # of the vocabulary
        known = [g for g in vocabulary if USUAL * often.get(g, 0) < max(1, self.n_learned)]
        self.known = known
        # A paragraph without one of these words, the rarer of each pair, has no gram of the vocabulary.
        self.needed = sorted({min(g.split(" "), key=lambda w: (often.get(w, 0), w)) for g in known})
        self.vectors = CountVectorizerModel.from_vocabulary(known, inputCol="grams", outputCol="features", minTF=0.0)
        self.vectors.setBinary(True)
        self.families = [*TEMPLATES, NONE]
        # A template also stands for its parts: quotations break off.
        n = F.size("words")
        part = lambda a, b: F.slice("words", F.greatest(F.lit(1), F.ceil(n * a).cast("int")), F.greatest(F.lit(3), F.ceil(n * b).cast("int")))
        positive = templates.select("family", F.explode(F.array("words", part(0.0, 0.75), part(0.25, 0.75))).alias("words"))
        label = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")) - 1
        given = positive.unionByName(other.withColumn("family", F.lit(NONE))).select("family", grams_of(F.col("words")).alias("grams"), F.lit(1).cast("long").alias("n"))
        vectors = paragraphs.select("half", F.filter("grams", lambda g: g.isin(known)).alias("grams"), "n").groupBy("half", "grams").agg(F.sum("n").alias("n"))
        vectors = cut(vectors)
        rows = given.unionByName(vectors.where("half = 0").select(F.lit(NONE).alias("family"), "grams", "n"))
        # Families and the unknown class weigh the same in all.
        rows = self.vectors.transform(rows).withColumn("label", label.cast("double"))
        counts = {r.family: r.n for r in rows.groupBy("family").agg(F.sum("n").alias("n")).collect()}
        most = sum(counts.values())
        weight = F.lit(1.0)
        for f, c in counts.items():
            weight = F.when(F.col("family") == f, F.lit(most / len(counts) / c)).otherwise(weight)
        parts = 2 + vectors.count() // PART
        self.model: LogisticRegressionModel = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60, weightCol="weight").fit(rows.select("features", "label", (weight * F.col("n")).alias("weight")).coalesce(parts))
        self.least = max(FLOOR, self._reached(vectors.where((F.col("half") == 1) & (F.size("grams") > 0)), int(FALSE_SHARE * self.n_kept_back)))

    def _reached(self, rows: DataFrame, allowed: int) -> float:
        """The probability that `allowed` paragraphs kept back (grams, n) may exceed; 0 where no more than these are taken for a family."""
        if not self.known:
            return 0.0
        counts = self._scored(rows).where(F.col("family") != NONE).groupBy("probability").agg(F.sum("n").alias("n"))
        running = cumulative(counts, "probability", ["n"]).where(f"total_n > {allowed} and cum_n >= total_n - {allowed}")
        return running.agg(F.min("probability")).first()[0] or 0.0

    def _scored(self, rows: DataFrame) -> DataFrame:
        """Adds family and probability to the rows (grams)."""
        scored = self.model.transform(self.vectors.transform(rows))
        p = vector_to_array("probability")
        return scored.withColumn("family", F.element_at(F.array(*map(F.lit, self.families)), F.col("prediction").cast("int") + 1)).withColumn("probability", F.array_max(p)).drop("grams", "features", "rawPrediction", "prediction")

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds family and probability to the rows (words) that have any feature; the rest is unknown and left out."""
        if not self.known:
            return rows.where(F.lit(False)).withColumns({"family": F.lit(NONE), "probability": F.lit(0.0)})
        some = rows.where(F.arrays_overlap("words", F.array(*map(F.lit, self.needed)))).select("*", F.explode(F.array(grams_of(F.col("words")))).alias("grams"))
        return self._scored(some.where(F.arrays_overlap("grams", F.array(*map(F.lit, self.known)))))


def find(df: DataFrame, text: str = "text", id_col: str = "doc_id", unknown: int | None = None) -> DataFrame:
    """id, paragraph, line, family, probability, agreement and confirmed for each paragraph that is not of the unknown class."""
    lines = lines_of(df, text, id_col)
    model = Classifier(lines, unknown)
    rows = with_words(lines)
    found = model.predict(rows).where((F.col("family") != NONE) & (F.col("probability") > model.least))
    found = found.withColumn("agreement", agreement(model.pairs, F.col("family")))
    return found.select(F.col("id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), "line", "family", "probability", "agreement", (F.col("agreement") >= CONFIRM).alias("confirmed"))
