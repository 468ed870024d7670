import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelflow.llm.quality import (BASE, CORE, DIMENSIONS, TAIL, P, chi_square, chi_square_quantile, op9_quality, rate,
                                   with_statistics, with_vector)
from tests.conftest import SF01

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_statistics_equal_brute_force(awkward_docs, awkward):
    frame = rate(awkward_docs)
    assert frame.columns == [c for c in awkward_docs.columns if c != "n_words"] + [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = frame.collect()
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
                 for r in rows)
    assert got == sorted(str((r[0], *brute(r[1]))) for r in awkward)
    assert not any(r.kept and r.base_failed for r in rows)


def test_statistics_of_random_repeats(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choice(["a ", "b ", "a\n", "c\t", "#|", "é "]) for _ in range(pick.randrange(200)))
             for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string")
    for r in rate(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)


def test_outliers_go_and_clean_documents_stay(spark):
    pick = random.Random(8)
    # words of their own for each document, so that none is a repeat of another
    clean = [" ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9)))
                      for _ in range(pick.randrange(25, 400))) for _ in range(900)]
    junk = [" ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9))) + "***" for _ in range(90))
            for _ in range(200)]
    rows = [(i, t, "en", f"s{i % 2}", i >= 900) for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    kept = {r.doc_id: r.kept for r in rate(docs).collect()}
    assert all(kept[i] for i in range(900))
    assert not any(kept[i] for i in range(900, 1100))


def test_duplicate_lines_and_repeats_each_reject_alone(spark):
    pick = random.Random(9)

    def words(n):
        return ["".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9))) + str(pick.random())[2:5] for _ in range(n)]

    def lines_of(n, pool):  # short lines in random order: few windows of eight words occur twice
        pool = [" ".join(words(2)) for _ in range(pool)]
        return "\n".join(pick.choice(pool) for _ in range(n))

    clean = [" ".join(words(pick.randrange(25, 400))) for _ in range(600)]
    clean += ["\n".join(" ".join(words(3)) for _ in range(pick.randrange(10, 90))) for _ in range(300)]
    # one line or one window that comes twice is no reason to go
    clean += ["\n".join([*x.split("\n"), x.split("\n")[0]]) for x in clean[600:640]]
    clean += [" ".join([*w, *words(9), *w, *words(40)]) for w in (words(8) for _ in range(20))]
    duplicates = [lines_of(70, 14) for _ in range(40)]
    repeats = [" ".join([*w, *words(424), *w]) for w in (words(88) for _ in range(40))]
    texts = clean + duplicates + repeats
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in rate(docs).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert [i for i in range(len(clean)) if not rows[i].kept] == []
    assert [i for i in range(len(clean), len(texts)) if rows[i].kept] == []


def test_small_groups_are_judged_by_all_rows_above_them(spark):
    pick = random.Random(10)

    def text(mark=""):
        return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9))) + mark
                        for _ in range(pick.randrange(60, 200)))

    groups = [("en", "big", 700, 0), ("en", None, 250, 0), ("en", "small", 60, 60), ("en", "junk", 0, 50),
              ("fr", "few", 0, 40), (None, "small", 30, 5)]
    rows = [(text("***" if j >= good else ""), lang, source, j >= good)
            for lang, source, good, bad in groups for j in range(good + bad)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, junk boolean")
    got = rate(docs).collect()
    assert len(got) == len(rows)
    assert [(r.lang, r.source) for r in got if r.kept == r.junk] == []


def plain_mcd(x, least, core):
    """Exact concentration from many random starts, in numpy: the covariance of least determinant."""
    n, p = x.shape
    h, pick, best = int(math.ceil(core * n)), np.random.default_rng(1), None
    for start in range(40):
        at = pick.choice(n, p + 1, replace=False) if start else np.arange(n)
        for _ in range(100):
            mean, cov = x[at].mean(axis=0), np.cov(x[at].T, bias=True) + np.diag(np.square(least))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d, kind="stable")[:h]
            if np.array_equal(np.sort(new), np.sort(at)):
                break
            at = new
        value = np.linalg.slogdet(cov)[1]
        if best is None or value < best[0]:
            best = value, d, h
    return best[1], best[2]


def test_verdict_follows_a_plain_mcd(spark):
    """Distances and verdicts of one group against exact concentration; near the limit either verdict is right."""
    pick = random.Random(21)

    def text(i):
        words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9))) for _ in range(pick.randrange(60, 300))]
        if i % 9 == 0:  # some symbols, from none to many
            words = [w + "*" * (pick.random() < i / 900) for w in words]
        if i % 11 == 0:
            words = [w + "x" * (i // 60) for w in words]
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i), "en", "s") for i in range(900)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rate(docs).collect()}
    x = with_vector(with_statistics(docs)).select("doc_id", "base_failed", *DIMENSIONS).toPandas()
    x = x[~x.base_failed]
    d, h = plain_mcd(x[list(DIMENSIONS)].to_numpy(), list(DIMENSIONS.values()), CORE)
    core = chi_square_quantile(CORE, P // 2)
    d = d / (CORE / chi_square(core, P // 2 + 1))
    free = (h - P) / 2
    z = 1 / (1 + d / (h - 1))
    tail = z ** free * (1 + free * (1 - z))
    for doc_id, t in zip(x.doc_id, tail, strict=True):
        if not TAIL / 10 < t < TAIL * 10:
            assert kept[doc_id] == (t >= TAIL), (doc_id, t)
    assert 20 < (tail < TAIL / 10).sum() < 200


def test_columns_called_like_inner_ones_stay(spark):
    names = ["group", "n", "m0", "log_det", "_group", "_text", "_words", "_row", "_language", "n_lines", "x_symbols", "bin", "start", "a.b"]
    rows = [(i, "word " * 3 + " ".join(f"w{j}" for j in range(30 + i)), "en", "s", *range(len(names))) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                  + ", ".join(f"`{n}` int" for n in names)).withColumn("Kept", F.lit(1))
    got = rate(frame)
    assert got.columns == ["doc_id", "text", "lang", "source", *names, *BASE, "kept"]
    assert all([r[4 + i] for i in range(len(names))] == list(range(len(names))) for r in got.collect())


def test_a_small_corpus_loses_its_outliers(spark):
    pick = random.Random(11)
    rows = [(i, " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9)))
                         + "***" * (i >= 100) for _ in range(90)), "en", "s") for i in range(120)]
    got = rate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id < 100) for r in got)


def test_labels_of_the_test_data(spark):
    labels = pd.read_parquet(f"{SF01}/labels.parquet")
    got = op9_quality(spark, SF01).toPandas().merge(labels, on="doc_id")
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.all()
    assert (~passed[passed.quality == 0].kept).mean() > 0.9


def test_few_documents_have_no_outliers(spark):
    docs = spark.createDataFrame([(i, "word " * 3 + " ".join(f"w{j}***" for j in range(i * 9)), "en", "s")
                                  for i in range(12)], "doc_id long, text string, lang string, source string")
    assert all(r.kept == (not r.base_failed) for r in rate(docs).collect())


def test_chi_square():
    assert chi_square(5.991464547, 1) == pytest.approx(0.95)
    assert chi_square_quantile(0.99, 2) == pytest.approx(13.2767, abs=1e-3)


def test_empty_table(no_docs):
    assert rate(no_docs).collect() == []
