import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm.ppm import Shared, byte_counts, code_lengths, op6_lm_scoring, parts_of, score
from tests.conftest import SF001


def train_model(texts, order):
    counts = defaultdict(Counter)
    for t in texts:
        s = b"\0" * order + (t or "").encode().lower() + b"\0"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k:i]][s[i]] += 1
    return counts


def symbol_log(counts, context, symbol):
    out, log = set(), 0.0
    for k in range(len(context), -1, -1):
        seen = {a: n for a, n in counts.get(context[len(context) - k:], {}).items() if a not in out}
        if not seen:
            continue
        total = sum(seen.values())
        if symbol in seen:
            return log + math.log10((seen[symbol] - 0.5) / total)
        log += math.log10(len(seen) / 2 / total)
        out |= set(seen)
    return log - math.log10(max(1, 256 - len(out)))


def text_log(counts, text, order):
    s = b"\0" * order + (text or "").encode().lower() + b"\0"
    return sum(symbol_log(counts, s[i - order:i], s[i]) for i in range(order, len(s)))


@pytest.mark.parametrize(("order", "block", "hot"), [(5, 1 << 24, 1 << 23), (5, 1 << 14, 20), (3, 1 << 14, 1), (2, 1 << 16, 50)])
def test_equals_brute_force(awkward_docs, awkward, order, block, hot):
    # the 20,000-word rows are left to test_query: brute force is slow on them
    short = [r for r in awkward if len(r[1] or "") < 3000]
    docs = awkward_docs.where("text is null or length(text) < 3000").withColumn(
        "held_out", F.when(F.col("doc_id").isNotNull(), F.col("doc_id") % 3 == 0))
    rows = score(docs, order=order, block_bytes=block, hot_pair=hot).collect()
    assert len(rows) == len(short)
    trains = [r for r in short if r[0] is None or r[0] % 3]
    tokens = Counter()
    for r in trains:
        tokens.update([*(r[1] or "").encode().lower().split(), None])
    total, kinds = sum(tokens.values()), len(tokens)
    counts = train_model([r[1] for r in trains], order)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    for i, r in enumerate(short):
        mine = [*(r[1] or "").encode().lower().split(), None]
        row = [x for x in got[r[0]] if x.n_tokens == len(mine)][0]
        assert (row.n_known, row.train_tokens) == (sum(tokens[w] > 0 for w in mine), total)
        assert row.base_score == pytest.approx(sum(math.log10((tokens[w] + 1) / (total + kinds + 1)) for w in mine))
        if i % 5 == 0 or i >= len(short) - 25:
            assert row.score == pytest.approx(text_log(counts, r[1], order), rel=1e-9)


def test_probabilities_sum_to_one():
    texts = ["the cat sat", "on the mat", "a cat", "\x00\xff"]
    counts = train_model(texts, 3)
    for context in (b"the", b" ca", b"zzz", b"\0\0\0"):
        assert sum(10 ** symbol_log(counts, context, s) for s in range(256)) == pytest.approx(1)


def test_trie_sums_to_one():
    pick = np.random.default_rng(0)
    data = pick.integers(97, 101, 400).astype(np.uint64)
    seen = Counter(int(data[i - 2] << np.uint64(16) | data[i - 1] << np.uint64(8) | data[i]) for i in range(2, 400))
    context = int(data[5] << np.uint64(8) | data[6])
    keys = np.array(sorted(set(seen) | {context << 8 | s for s in range(256)}), np.uint64)
    pairs = np.zeros((256, 256), np.int64)
    for key, n in seen.items():
        pairs[key >> 8 & 255, key & 255] += n
    logs = code_lengths(keys, np.array([seen[int(k)] for k in keys]), Shared(pairs), 2)
    assert (10 ** logs[[int(k) >> 8 == context for k in keys]]).sum() == pytest.approx(1)


def test_query_beats_uniform_bytes(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = op6_lm_scoring(spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in rows if r.held_out]
    bits = -sum(r.score for r in held) / math.log10(2) / sum(len(docs[r.doc_id].encode()) + 1 for r in held)
    assert bits < 3


def test_no_training_document_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(1, "ab", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    rows = {r.doc_id: r for r in score(docs).collect()}
    assert rows[1].score == pytest.approx(-3 * math.log10(256)) and rows[1].train_tokens == 0
    assert rows[2].n_tokens == 1 and rows[2].n_known == 0
    assert score(no_docs.withColumn("held_out", F.lit(False))).collect() == []


def test_hot_pairs_are_cut_by_the_byte_before(spark):
    texts = [f"{a}{b}he {c}" for a in "abcdefgh" for b in "stuvwxyz" for c in "klmn"]
    docs = spark.createDataFrame([(t, i % 5 == 0) for i, t in enumerate(texts)], "text string, held_out boolean")
    shared = byte_counts(docs, len(texts))
    assert {(p >> 8, p & 255) for p in np.flatnonzero(shared.hot)} == {(0, 0), (ord("h"), ord("e")), (ord("e"), 32)}
    triples = Counter()
    for i, t in enumerate(texts):
        s = b"\0\0" + t.encode() + b"\0"
        if i % 5:
            triples.update(s[j - 2] << 16 | s[j - 1] << 8 | s[j] for j in range(2, len(s)))
    hot = {k: n for k, n in triples.items() if shared.hot[k >> 8]}
    assert dict(zip(shared.triples.tolist(), shared.counts.tolist(), strict=True)) == hot
    strings = np.array([int.from_bytes(bytes([97, third]) + b"he" + b" ", "big") for third in range(97, 123)], np.uint64)
    assert len(set(parts_of(strings, 1 << 20, shared.hot))) > 20
    assert len(set(parts_of(strings, 1 << 20, np.zeros(1 << 16, bool)))) == 1
