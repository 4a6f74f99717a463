import random
from collections import Counter

import pytest
from conftest import words

from lodeframe.llm import license_lines as l

LINES = {
    "MIT": ["This project is released under the MIT License.", "Released under the MIT license, see the file."],
    "Apache-2.0": ["licensed under the Apache License Version 2.0", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."],
    "GPL-3.0": ["The text is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC": ["The photos are licensed under CC BY-NC 4.0."],
    None: ["My driving license was released under the door.", "The public version of the work is free.", "Apache is a name.", "", "ndble thonre hesta"],
}


def test_families_of_changed_notices_and_unknown_lines(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for family, lines in LINES.items():
        for line in lines:
            i = len(rows)
            rows.append((i, f"{words(rng, 12)}\n{line}\n{words(rng, 9)}", "x", "y"))
            if family:
                want[(i, 1)] = family
    rows += [rows[0], (77, None, None, None), (78, "", "", ""), (None, "Released under the MIT License.", "", "")]
    found = l.find(spark.createDataFrame(rows, "doc_id long, text string, family string, words string")).collect()
    got = {(r.doc_id, r.paragraph): r.family for r in found if r.doc_id is not None and r.confirmed}
    assert got == want
    assert sum(r.doc_id == 0 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1


def test_empty_table(empty):
    assert l.find(empty).count() == 0


KEYLESS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


@pytest.mark.parametrize("n_rows, common", [(60, False), (600, False), (600, True)])
def test_notices_without_licence_words_are_found(spark, n_rows, common):
    """Tables of fewer and of more paragraphs than the sample; with and without one line in a third of the rows."""
    rng = random.Random(n_rows)
    rows, want = [], {}
    for i in range(n_rows):
        lines = [words(rng, 12) for _ in range(9)]
        if i % 10 == 0:
            family = list(KEYLESS)[i // 10 % 3]
            want[(i, 4)] = family
            lines[4] = KEYLESS[family] if i % 20 else f"{KEYLESS[family]} {words(rng, 3)}"
        if common and i % 3 == 0:
            lines[8] = "a line that many rows have in common"
        rows.append((i, "\n".join(lines)))
    found = l.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc_id, r.paragraph): r.family for r in found if r.confirmed} == want


def test_a_frequent_line_is_drawn_once(spark):
    rng = random.Random(5)
    lines = [words(rng, 12) for _ in range(80)] + ["the same again"] * 400
    table = spark.createDataFrame([(t,) for t in lines], "line string")
    drawn = [tuple(r.words) for r in l.drawn(table, l.pairs_by_family(l.templates_of(spark)), 50).collect()]
    assert len(drawn) == len(set(drawn)) == 50


def test_the_unknown_class_is_learned_from_all_distinct_paragraphs(spark):
    """More distinct paragraphs than the former sample of 4000; some use grams of templates, rarely or often, and many rows repeat."""
    rng = random.Random(9)
    lines = []
    for i in range(9000):
        said = [words(rng, 6)]
        said += ["sell copies"] * (i == 17) + ["redistribute it"] * (i % 400 == 3) + ["common development"] * (i % 7 == 0) + ["software foundation"] * (i % 5 == 0)
        lines.append(" ".join([*said, f"n{i}"]))
    table = spark.createDataFrame([(t,) for t in lines + lines[:3000]], "line string").repartition(4)
    model = l.Classifier(table)
    assert model.n_learned + model.n_kept_back == 9000

    vocabulary = {g for t in l.templates_of(spark).select(l.grams_of(l.F.col("words")).alias("g")).collect() for g in t.g}
    split = table.distinct().withColumn("words", l.words_of(l.F.col("line"))).select("words", l.F.pmod(l.F.xxhash64(l.F.array_join("words", " "), l.F.lit(1)), l.F.lit(2)).alias("half"))
    own = [r.words for r in split.where("half = 0").collect()]
    often = Counter(g for w in own for g in {*w, *map(" ".join, zip(w, w[1:]))} & vocabulary)
    assert model.n_learned == len(own)
    assert model.known == sorted(g for g in vocabulary if often[g] * 2000 < len(own))
    assert not {"redistribute", "redistribute it", "software foundation"} & set(model.known)


def test_the_limit_follows_from_all_paragraphs_kept_back(spark):
    """Its value is the one that a sort of all probabilities gives."""
    rng = random.Random(4)
    parts = ["free of charge to any person", "granted to any person", "warranty of merchantability", "permitted provided that", "source and binary forms", "waived all copyright"]
    table = spark.createDataFrame([(f"{words(rng, 5)} {rng.choice(parts) if rng.random() < 0.004 else ''} n{i}",) for i in range(6000)], "line string")
    model = l.Classifier(table)
    rows = spark.createDataFrame([(["hereby", "granted"], 3), (["hereby granted"], 2), (["encumbered", "unencumbered software"], 4), (["binary forms"], 1)], "grams array<string>, n long")
    reached = sorted((r.probability for r in model._scored(rows).where("family <> 'unknown'").collect() for _ in range(r.n)), reverse=True)
    for allowed in range(len(reached) + 2):
        assert model._reached(rows, allowed) == (reached[allowed] if allowed < len(reached) else 0.0)
