"""TF-IDF and encodings against a brute-force Python implementation."""

import collections
import math

import pytest
import re

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from labelflow.constants import PAD_ID, UNK_ID
from labelflow.operators import features

CORPUS = [
    "The cat sat on the mat",
    "the dog sat",
    "Кот сидит на ковре, кот спит",
    "a b c",  # no token of two letters
    "dog dog dog cat",
    "new_words and 42 numbers",
]
WORD = re.compile(r"[^\W]{2,}", re.UNICODE)


def brute_terms(text):
    toks = [t for t in re.findall(r"\w+", text.lower()) if len(t) >= 2]
    return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


def brute_tfidf(fit_docs, apply_docs, k):
    tf_total, df = collections.Counter(), collections.Counter()
    for d in fit_docs:
        c = collections.Counter(brute_terms(d))
        tf_total.update(c)
        df.update(c.keys())
    vocab = sorted(tf_total, key=lambda t: (-tf_total[t], t.encode()))[:k]
    n = len(fit_docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = []
    for d in apply_docs:
        c = collections.Counter(brute_terms(d))
        w = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / norm for t, v in w.items()} if norm else {})
    return vocab, out


def _df(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "row_id long, text string")


def test_tfidf_long_and_vectors_match_brute_force(spark):
    fit_docs, apply_docs, k = CORPUS[:5], CORPUS, 12
    vocab, want = brute_tfidf(fit_docs, apply_docs, k)
    fit_df, apply_df = _df(spark, fit_docs), _df(spark, apply_docs)
    top = features.vocabulary_topk(features.term_counts(fit_df), k).orderBy("rank").collect()
    assert [r.term for r in top] == vocab
    got = collections.defaultdict(dict)
    for r in features.tfidf_of_texts(apply_df, features.fit_tfidf(fit_df, max_features=k)).collect():
        got[r.row_id][r.term] = r.weight
    for i, w in enumerate(want):
        assert set(got.get(i, {})) == set(w)
        for t, v in w.items():
            assert math.isclose(got[i][t], v, rel_tol=1e-9)
    # the persistable ML stages give the same weights per row
    fit = features.fit_tfidf(fit_df, max_features=k)
    vec = PipelineModel(features.tfidf_stages(fit)).transform(apply_df).select("row_id", "features").collect()
    for r in vec:
        dense = dict(zip(fit.vocabulary, r.features.toArray()))
        for t in fit.vocabulary:
            assert math.isclose(dense[t], want[r.row_id].get(t, 0.0), abs_tol=1e-12)


def test_encode_fixed_length(spark):
    df = _df(spark, ["dog cat dog", "unknownword dog", "", "a"])
    vocab = features.word_vocabulary(df.where(F.col("row_id") < 1), k=10)
    ids = {r.term: r.id for r in vocab.collect()}
    assert ids == {"dog": UNK_ID + 1, "cat": UNK_ID + 2}
    out = {r.row_id: r for r in features.encode(df, vocab, 4).collect()}
    assert out[0].input_ids == [ids["dog"], ids["cat"], ids["dog"], PAD_ID]
    assert out[0].attention_mask == [1, 1, 1, 0]
    assert out[1].input_ids == [UNK_ID, ids["dog"], PAD_ID, PAD_ID]
    assert out[2].input_ids == [PAD_ID] * 4 and out[2].attention_mask == [0] * 4
    assert features.longest_length(df) == 3
    cut = {r.row_id: r for r in features.encode(df, vocab, 2).collect()}
    assert cut[0].input_ids == [ids["dog"], ids["cat"]]


def test_whole_vocabulary_has_no_cap_and_dense_ids(spark):
    words = [f"w{i}" for i in range(6000)] + ["often"] * 5 + ["twice"] * 2
    docs = _df(spark, [" ".join(words[i::7]) for i in range(7)])
    got = {r.term: r.id for r in features.word_vocabulary(docs).collect()}
    counts = collections.Counter(words)
    want = sorted(counts, key=lambda t: (-counts[t], t))
    assert got == {t: i + 2 for i, t in enumerate(want)}


def test_encode_rejects_repeated_ids(spark):
    df = spark.createDataFrame([(1, "two words"), (1, "and two")], "row_id long, text string")
    with pytest.raises(ValueError, match="duplicate ids"):
        features.encode(df, features.word_vocabulary(df), 4)


def test_local_counts_sum_to_the_term_counts(spark, monkeypatch):
    texts = [*CORPUS, None, "", "one", "aa aa aa aa", "aa", *[f"w{i % 7} w{i % 3} w{i}" for i in range(40)]]
    df = _df(spark, texts).coalesce(1)
    want = collections.defaultdict(lambda: [0, 0])
    for text in texts:
        for term, n in collections.Counter(brute_terms(text or "")).items():
            want[term][0] += n
            want[term][1] += 1
    for words, rows, terms in ((features.COUNT_WORDS, features.COUNT_ROWS, features.COUNT_TERMS), (5, 3, 4), (1, 1, 1)):
        monkeypatch.setattr(features, "COUNT_WORDS", words)
        monkeypatch.setattr(features, "COUNT_ROWS", rows)
        monkeypatch.setattr(features, "COUNT_TERMS", terms)
        got = {r.term: [r.tf_total, r.df] for r in features.term_totals(df).collect()}
        assert got == dict(want)
    assert features.term_totals(df.limit(0)).collect() == []


def test_a_large_vocabulary_is_never_broadcast(spark):
    from labelflow.operators import vocabulary

    df = _df(spark, CORPUS)
    weights = vocabulary.tfidf_weights(df, vocabulary.fit_vocabulary(df, 1000))
    _, want = brute_tfidf(CORPUS, CORPUS, 1000)
    got = collections.defaultdict(dict)
    for r in weights.collect():
        got[r.row_id][r.term] = r.weight
    assert {i: set(x) for i, x in got.items()} == {i: set(x) for i, x in enumerate(want) if x}
    assert all(math.isclose(w, want[i][t], rel_tol=1e-12) for i, x in got.items() for t, w in x.items())
    # the offsets of the sorted partitions are one row each; the terms themselves pass no driver
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [term" not in plan and "SortMergeJoin [term" in plan
