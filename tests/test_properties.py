"""Randomised properties against Python brute force (one Spark job per property)."""

import collections
import math
import random

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelflow.constants import WORD_PATTERN
from labelflow.functions.text import strip
from labelflow.operators import features, split

ALPHABET = list("abcxyzäöüßéèçПривет_0123") + [" ", " ", "\t", "\n", " ", "　", "\x1c", ",", ".", "-"]


def _random_texts(n, seed, max_len=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len))) for _ in range(n)]


def test_strip_random(spark):
    texts = _random_texts(400, 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.s for r in df.select("i", strip(F.col("t")).alias("s")).collect()}
    assert all(got[i] == t.strip() for i, t in enumerate(texts))


def test_term_counts_random(spark):
    texts = _random_texts(300, 2, max_len=200)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    got = collections.defaultdict(dict)
    for r in features.term_counts(df).collect():
        got[r.row_id][r.term] = r.tf
    word = regex.compile(WORD_PATTERN)
    for i, t in enumerate(texts):
        toks = word.findall(t.lower())
        want = collections.Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])
        assert got.get(i, {}) == dict(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(min_value=2, max_value=10_000), min_size=1, max_size=6),
       st.floats(min_value=0.05, max_value=0.9))
def test_quota_invariants(sizes, frac):
    counts = {f"c{i}": n for i, n in enumerate(sizes)}
    n = sum(sizes)
    n_test = math.ceil(frac * n)
    if n - n_test < len(sizes) or n_test < len(sizes):
        return
    q = split.split_quotas(counts, frac)
    assert sum(v[0] for v in q.values()) == n - n_test
    for lab, (tr, te) in q.items():
        share = counts[lab] / n * (n - n_test)
        assert math.floor(share) <= tr <= math.floor(share) + 1 and tr + te == counts[lab]


def test_split_random_sizes(spark):
    rnd = random.Random(3)
    rows, rid = [], 0
    sizes = {"a": 9, "b": 1700, "c": 41, "d": 260}
    for lab, n in sizes.items():
        for _ in range(n):
            rid += rnd.randint(1, 5)
            rows.append((rid, lab))
    df = spark.createDataFrame(rows, "row_id long, label string")
    out = split.split_70_15_15(df)
    got = collections.Counter((r.label, r.split) for r in out.collect())
    q = split.split_quotas(sizes, 0.3, 0.5)
    for lab, (tr, va, te) in q.items():
        assert (got[(lab, "train")], got[(lab, "val")], got[(lab, "test")]) == (tr, va, te)
    assert out.select("row_id").distinct().count() == len(rows)


def test_second_split_needs_two_rows_per_class():
    import pytest

    with pytest.raises(ValueError, match="least populated"):
        split.split_quotas({"a": 3, "b": 1700, "c": 41, "d": 260}, 0.3, 0.5)
