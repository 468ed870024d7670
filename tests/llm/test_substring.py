import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from labelflow.llm import queries
from labelflow.llm.substring import COVERS, op2_query, op2_substring, remove_repeats
from tests.conftest import SF001


def brute(texts, width):
    """Removed flags of every text's words."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    removed = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        removed.append(gone)
    return words, removed


@pytest.mark.parametrize("period", sorted(COVERS))
def test_covers_meet_at_every_shift(period):
    for shift in range(period):
        assert any((d + shift) % period in COVERS[period] for d in COVERS[period])


def test_query_equals_brute_force(awkward_docs, awkward):
    words, removed = brute([r[1] for r in awkward], 35)
    want = sorted(str((r[0], len(w), sum(g), hashlib.sha256(b" ".join(x for x, d in zip(w, g) if not d)).hexdigest()))
                  for r, w, g in zip(awkward, words, removed))
    got = op2_query(awkward_docs).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert any(0 < r.n_removed < r.n_words for r in got)


@pytest.mark.parametrize(("width", "period", "block"), [(8, 7, 1 << 8), (14, 13, 1 << 12), (35, 21, 1 << 9)])
def test_small_alphabet_many_blocks(spark, width, period, block):
    pick = random.Random(width)
    texts = [" ".join(pick.choice("ab") for _ in range(pick.randrange(60))) for _ in range(40)]
    texts += texts[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = remove_repeats(docs, width, period=period, block_bytes=block, one_space=True).orderBy("doc_id").collect()
    words, removed = brute(texts, width)
    for row, w, gone in zip(rows, words, removed, strict=True):
        assert row.n_removed == sum(gone)
        assert row.text == b" ".join(x for x, d in zip(w, gone) if not d).decode()


def test_kept_spacing_and_other_columns(awkward_docs, awkward):
    frame = remove_repeats(awkward_docs, 35)
    assert frame.columns == [c for c in awkward_docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    rows = frame.collect()
    given = {(r[0], r[1]) for r in awkward}
    assert all((r.doc_id, r.text) in given for r in rows if not r.n_removed)
    assert [r.text for r in rows if r.doc_id in (1_000_007, 1_000_008)] in (["", "", "", "after"], ["after", "", "", ""],
                                                                           ["", "after", "", ""], ["", "", "after", ""])


def test_columns_called_like_inner_ones_stay(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"a {passage}", 7, 8, 9, "x", "y"), (2, f"{passage} b", 70, 80, 90, "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, block int, `range` int, stage int, `c.0` string, N_WORDS string")
    got = remove_repeats(frame, 35)
    assert got.columns == ["doc_id", "text", "block", "range", "stage", "c.0", "n_words", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a ", 7, 8, 9, "x", 41, 40), (2, "b", 70, 80, 90, "x", 41, 40)]


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF001}/documents.parquet'")
    want = con.execute(queries.ORACLE["op2_substring"]).fetchdf()
    got = op2_substring(spark, SF001).toPandas()[list(want.columns)]
    assert np.array_equal(got.sort_values("doc_id").values, want.sort_values("doc_id").values)


def test_empty_table(no_docs):
    assert remove_repeats(no_docs, 35).collect() == []
