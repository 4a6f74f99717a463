"""Text normalisation, counts, stop words, TF-IDF and consistent spelling."""

from __future__ import annotations

import html
import math
import unicodedata

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import words
from lodeframe.functions.columns import facts, is_string, q, rows
from lodeframe.functions.stem import stem

# Language codes and the names of their stop word lists.
LANGUAGES = {
    "en": "english", "es": "spanish", "fr": "french", "de": "german", "it": "italian", "pt": "portuguese", "nl": "dutch",
    "sv": "swedish", "no": "norwegian", "da": "danish", "fi": "finnish", "ru": "russian",
}

#: Most words that are listed in a condition.
LISTED = 1000


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: [stem(t) for t in ts], na_action="ignore")


def squeezed(c: Column) -> Column:
    """White space trimmed and collapsed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def without_markup(c: Column) -> Column:
    """Entities resolved, tags and Markdown marks removed. Only texts with an ampersand leave the JVM."""
    c = F.when(c.contains("&"), _unescape(F.when(c.contains("&"), c))).otherwise(c)
    c = F.regexp_replace(c, words.HTML_TAG, "")
    c = F.regexp_replace(c, r"#{1,6}\s*", "")
    for mark in (r"\*{1,3}(.*?)\*{1,3}", r"_{1,3}(.*?)_{1,3}", r"~~(.*?)~~", r"`{1,3}(.*?)`{1,3}", r"\[([^\]]+)\]\([^\)]+\)"):
        c = F.regexp_replace(c, mark, "$1")
    return c


def expanded(c: Column) -> Column:
    """Contractions written out; texts without an apostrophe are passed by."""
    long = c
    for short, full in words.CONTRACTIONS.items():
        long = F.regexp_replace(long, rf"(?iU)\b{short}\b", full)
    return F.when(c.contains("'"), long).otherwise(c)


def normalize_text(df: DataFrame, cols: list[str], mode: str = "full") -> DataFrame:
    """full: markup, case, emoji, links and contractions; light: white space and case; html_only: markup."""
    def normal(c: Column) -> Column:
        c = squeezed(c.cast("string"))
        if mode in ("full", "html_only"):
            c = without_markup(c)
        if mode in ("full", "light"):
            c = F.lower(c)
        if mode == "full":
            c = F.regexp_replace(F.regexp_replace(c, words.EMOJI, ""), words.URL_INSIDE, "")
            c = squeezed(expanded(c))
        return c

    return df.withColumns({c: normal(q(c)) for c in cols})


def tokens(c: Column) -> Column:
    """White-space separated words."""
    text = squeezed(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def text_features(df: DataFrame, cols: list[str], mode: str = "all") -> DataFrame:
    """Counts and shares of characters per text; null counts as empty."""
    out = {}
    for c in cols:
        text = F.coalesce(q(c).cast("string"), F.lit(""))
        n = F.greatest(F.char_length(text), F.lit(1))
        found = tokens(text)
        letters = F.char_length(F.regexp_replace(text, r"(?U)\s+", ""))
        out[f"{c}_token_count"] = F.size(found).cast("long")
        out[f"{c}_char_count"] = F.char_length(text).cast("long")
        out[f"{c}_avg_word_length"] = F.coalesce(F.round(F.try_divide(letters, F.size(found)), 2), F.lit(0.0))
        for name, chars in (("capitalization_ratio", r"\p{Lu}"), ("digit_ratio", r"\p{Nd}"), ("punctuation_density", r"[.,;:!?\-()\[\]{}\"']")):
            out[f"{c}_{name}"] = F.round(F.regexp_count(text, F.lit(chars)) / n, 3)
        if mode in ("all", "basic"):
            out[f"{c}_sentence_count"] = F.regexp_count(text, F.lit(r"[.!?]+")).cast("long")
    return df.withColumns(out)


def stop_words(language: str = "en") -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(LANGUAGES.get(language, "english"))


def remove_stopwords(df: DataFrame, cols: list[str], language: str = "en", stemming: bool = False, stops: list[str] | None = None) -> DataFrame:
    """Words of letters only, lower-cased, without stop words; optionally reduced to Porter stems."""
    stops = [w for w in (stop_words(language) if stops is None else stops) if w.isalpha()]

    def kept(c: Column) -> Column:
        found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}_]+)"), 1)
        found = F.filter(found, lambda w: w.rlike(r"^\p{L}+$") & ~w.isin(*stops))
        return F.array_join(_stems(found) if stemming else found, " ")

    return df.withColumns({c: kept(q(c).cast("string")) for c in cols})


def _words(df: DataFrame, c: Column, key: str, stops: list[str]) -> DataFrame:
    """(key, words): words of two or more characters without stop words, in the order of the text."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w\w+"), F.lit(0))
    return df.select(q(key).alias("key"), F.filter(found, lambda w: ~w.isin(*stops)).alias("words") if stops else found.alias("words"))


def _grams(n: int) -> Column:
    """The n-grams of `words`; none holds a null."""
    grams = F.col("words")
    for k in range(2, n + 1):
        following = F.slice("words", F.lit(k), F.greatest(F.size("words"), F.lit(1)))
        grams = F.zip_with(grams, following, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.filter(grams, lambda g: g.isNotNull())


def _only(docs: DataFrame, listed: list[str]) -> DataFrame:
    """The other words become null, so the rest keep their places."""
    return docs.withColumn("words", F.transform("words", lambda w: F.when(w.isin(*listed), w)))


def _vocabulary(docs: DataFrame, ngram_range: tuple[int, int], max_features: int, fits) -> list:
    """The `max_features` most used of the terms that fit: (term, tf, df), both counted from one row for each use of a term.

    A text's terms are sorted, and the first of equal ones counts the text. An n-gram is used no more often than any of its words, so it
    can be among the first only if its words are used as often as the last of those found so far: longer ones are counted of such words.
    """
    best, least, uses_of, known_to = [], 0, {}, 0
    for n in range(ngram_range[0], ngram_range[1] + 1):
        often = [w for w, tf in uses_of.items() if tf >= least]
        counted = _only(docs, often) if n > 1 and known_to <= least and 0 < least and often else docs
        uses = F.transform("s", lambda w, i: F.struct(w.alias("term"), F.when((i > 0) & (F.get("s", i - 1) == w), 0).otherwise(1).alias("first")))
        rows_ = counted.select(F.sort_array(_grams(n)).alias("s")).select(F.explode(uses).alias("c"))
        counts = rows_.groupBy("c.term").agg(F.count(F.lit(1)).alias("tf"), F.sum("c.first").alias("df")).where(F.col("tf") >= least)
        order = (F.col("tf").desc(), "term")
        top = counts.orderBy(*order).limit(max(LISTED, max_features)).collect()
        fitting = [r for r in top if fits(r["df"])]
        if len(fitting) < max_features and len(top) >= max(LISTED, max_features):
            fitting = counts.where(fits(F.col("df"))).orderBy(*order).limit(max_features).collect()
        best = sorted(best + fitting[:max_features], key=lambda r: (-r["tf"], r["term"]))[:max_features]
        least = best[-1]["tf"] if len(best) == max_features else 0
        if n == 1:  # words used `known_to` times or more are all among these
            uses_of = {r["term"]: r["tf"] for r in top}
            known_to = top[-1]["tf"] + 1 if len(top) >= max(LISTED, max_features) else 0
    return best


def tfidf_weights(
    df: DataFrame, c: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 2), min_df: int = 2, max_df: float = 0.95,
    stops: list[str] | None = None,
) -> DataFrame:
    """(key, term, weight) of each text: smooth idf, each text's weights scaled to length one.

    The vocabulary is fitted first; its terms are then counted, weighed and scaled inside the row of their text.
    """
    stops = stop_words("en") if stops is None else stops
    docs = _words(df, F.coalesce(q(c).cast("string"), F.lit("")), key, stops)
    total = df.count()
    vocabulary = _vocabulary(docs, ngram_range, max_features, lambda n: (n >= min_df) & (n <= max_df * total))
    if not vocabulary:
        return docs.select(F.col("key").alias(key), F.lit("").alias("term"), F.lit(0.0).alias("weight")).where(F.lit(False))
    idf = F.create_map(*[F.lit(x) for r in vocabulary for x in (r["term"], math.log((1.0 + total) / (1.0 + r["df"])) + 1.0)])
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # a lambda's variable is worked out once
    docs = _only(docs, sorted({w for r in vocabulary for w in r["term"].split(" ")}))
    docs = docs.select("key", F.concat(*[_grams(n) for n in range(ngram_range[0], ngram_range[1] + 1)]).alias("terms"))
    known = F.filter("terms", lambda w: w.isin(*[r["term"] for r in vocabulary]))
    weighed = let(known, lambda k: F.transform(F.array_distinct(k), lambda t: F.struct(t.alias("term"), (F.size(F.filter(k, lambda x: x == t)) * F.element_at(idf, t)).alias("w"))))
    scaled = let(weighed, lambda ws: let(F.sqrt(F.aggregate(ws, F.lit(0.0), lambda a, x: a + x["w"] * x["w"])), lambda norm: F.transform(ws, lambda x: F.struct(x["term"].alias("term"), (x["w"] / norm).alias("weight")))))
    return docs.select(F.col("key").alias(key), F.explode(scaled).alias("x")).select(key, "x.term", "x.weight")


def tfidf(df: DataFrame, c: str, key: str, max_features: int = 100, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """One column per vocabulary term, at most max_features."""
    weights = tfidf_weights(df, c, key, max_features, ngram_range)
    terms = sorted(r["term"] for r in weights.select("term").distinct().collect())
    wide = weights.groupBy(q(key).alias("_k")).agg(*[F.max(F.when(F.col("term") == t, F.col("weight"))).alias(f"{c}_tfidf_{t}") for t in terms])
    joined = df.join(wide, q(key) == F.col("_k"), "left").drop("_k")
    return joined.withColumns({f"{c}_tfidf_{t}": F.coalesce(q(f"{c}_tfidf_{t}"), F.lit(0.0)) for t in terms}) if terms else joined


def casing(df: DataFrame, cols: list[str], mode: str = "lower") -> DataFrame:
    change = {"lower": F.lower, "upper": F.upper, "title": F.initcap}[mode]
    return df.withColumns({c: change(q(c).cast("string")) for c in cols})


def whitespace(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: squeezed(q(c).cast("string")) for c in cols})


def unicode_nfc(df: DataFrame, cols: list[str]) -> DataFrame:
    """Composed characters; texts of plain ASCII stay in the JVM."""
    def composed(c: Column) -> Column:
        plain = ~c.rlike(r"[^\x00-\x7F]")
        return F.when(plain, c).otherwise(_nfc(F.when(~plain, c)))

    return df.withColumns({c: composed(q(c).cast("string")) for c in cols})


def map_values(df: DataFrame, c: str, clusters: list[dict]) -> DataFrame:
    """Variants replaced by the canonical value of their cluster: a literal map while it is small, a join beyond."""
    mapping = {v: cl["canonical"] for cl in clusters for v in cl["variants"] if v != cl["canonical"]}
    if not mapping:
        return df
    if len(mapping) <= 1000:
        pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        return df.withColumn(c, F.coalesce(F.element_at(pairs, q(c)), q(c)))
    return map_values_from(df, c, rows(df.sparkSession, mapping.items(), "variant string, canonical string"))


def map_values_from(df: DataFrame, c: str, mapping: DataFrame) -> DataFrame:
    """As map_values, with the mapping as a (variant, canonical) table of any size."""
    names = df.columns
    side = mapping.select(F.col("variant").alias("_variant"), F.col("canonical").alias("_canonical"))
    joined = df.join(side, q(c) == F.col("_variant"), "left")
    return joined.select(*[F.coalesce(F.col("_canonical"), q(x)).alias(x) if x == c else q(x) for x in names])


def standardize_email(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.lower(F.regexp_replace(q(c).cast("string"), r"(?U)^\s+|\s+$", "")) for c in cols})


def precision(df: DataFrame, cols: list[str], d: int = 2) -> DataFrame:
    """Half to even."""
    return df.withColumns({c: F.bround(q(c), d) for c in cols})
