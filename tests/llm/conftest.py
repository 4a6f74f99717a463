import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, node string, sha string, part string, `row` string, live string, t string"
LETTERS = "the of and stone river cloud lamp green seven door é ß 中文 x1 it's".split()


def words(rng, n):
    return " ".join(rng.choice(LETTERS) + str(rng.randint(0, 400)) for _ in range(n))


def make_texts(seed=1):
    """Ordinary texts, exact and near copies, repeated lines, and odd ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(12, 120)) for _ in range(25)]
    texts = list(base)
    for t in base[:8]:
        w = t.split(" ")
        texts += [t, t.upper()]
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(len(v))] = "new" + str(rng.randint(0, 99))
            texts.append(" ".join(v))
    line = words(rng, 14)
    texts += [f"{line}\n{words(rng, 30)}\n{line}\n{line}", "a b c d e " * 40, "", " \n\t ", "one", "two words", "\u00a0 \u3000", "é" * 50, words(rng, 4000), "\n\n\n", "<|endoftext|> # $ % & | <>"]
    return texts


def rows_of(texts, seed=2):
    rng = random.Random(seed)
    rows = [(i, t, "en", f"src{i % 4}", len(t), "k", "i", "n", "s", "p", "r", "l", "t") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (900, None, None, None, None, *[None] * 8), (None, texts[2], "en", "src1", 3, *[None] * 8), (None, None, *[None] * 11)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows_of(make_texts()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
