import collections

from pyspark.sql import functions as F

from labelflow.constants import NA_TOKENS
from labelflow.functions.text import (
    is_blank, na_to_null, ngrams_1_2, normalise_label, run_starts, strip, term_frequencies, word_tokens)

SAMPLES = [
    "  plain  ",
    " nbsp word ",
    "　ideographic　",
    "\x1cfile sep\x1f",
    "\ttab\nnewline\r\n",
    "\u0085next line ",
    "inner space kept",
    "",
    "   ",
    "Привет мир",
]


def test_strip_equals_python_strip(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = [r[0] for r in df.select(strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in SAMPLES]


def test_blank_and_label(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), (" Positive ",)], "s string")
    rows = df.select(is_blank(F.col("s")).alias("b"), normalise_label(F.col("s")).alias("n")).collect()
    assert [r.b for r in rows] == [True, True, True, False]
    assert rows[3].n == "positive"


def test_na_tokens(spark):
    vals = list(NA_TOKENS) + ["na", "Null ", "text, with comma"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(na_to_null(F.col("s"))).collect()]
    assert got[: len(NA_TOKENS)] == [None] * len(NA_TOKENS)
    assert got[len(NA_TOKENS):] == ["na", "Null ", "text, with comma"]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame(
        [("Das ist ein großartiger Film",), ("Мне всё понравилось",), ("a b c",), ("one",), ("x_y 12 ab",), ("",)],
        "t string")
    rows = df.select(word_tokens(F.col("t")).alias("w")).select("w", ngrams_1_2(F.col("w")).alias("g")).collect()
    assert rows[0].w == ["das", "ist", "ein", "großartiger", "film"]
    assert rows[0].g[-1] == "großartiger film" and len(rows[0].g) == 9
    assert rows[1].w == ["мне", "всё", "понравилось"]
    assert rows[2].w == [] and rows[2].g == []
    assert rows[3].g == ["one"]
    assert rows[4].w == ["x_y", "12", "ab"]
    assert rows[5].g == []


def test_term_frequencies_match_counter(spark):
    texts = ["b a b a c b", "", "solo", "the cat the cat the dog"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    toks = df.select("id", F.split("t", " ").alias("w")).select(
        "id", F.sort_array(F.filter("w", lambda x: x != "")).alias("s"))
    toks = toks.select("id", "s", run_starts(F.col("s")).alias("st"))
    got = {r.id: {x.term: x.tf for x in r.f} for r in toks.select("id", term_frequencies("s", "st").alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == dict(collections.Counter(t.split()))
