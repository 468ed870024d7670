import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import queries
from labelflow.llm.search import ImpactIndex, op8_topk, top_k
from tests.conftest import SF001

SCHEMA = "vec_id long, embedding array<float>, query_id long, score string"


def brute(rows, k):
    def whole(v):
        fine = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(1024 * float(np.float32(x))) for x in v] if fine else None

    kept = [(key, whole(vector)) for key, vector in rows]
    kept = [(key, v) for key, v in kept if v is not None]
    out = []
    for i, (q, v) in enumerate(kept):
        if q is not None and q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c is None, c or 0, c) for j, (c, w) in enumerate(kept) if j != i)
            out += [(q, n + 1, c, -s) for n, (s, _, _, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def random_rows(seed, n, dims):
    pick = random.Random(seed)
    rows = [(i, [pick.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0, None]), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims),
             (None, [1.0] * dims), (200, [9.0] * dims), (n + 5, [1.0]), rows[1], rows[1],
             rows[0], (0, [8.0] * dims), (300, []), (7, [2.0] * (dims - 1))]
    rows += [(n + 10 + i, [0.5] * dims) for i in range(30)]  # ties
    return rows


@pytest.mark.parametrize(("n", "dims", "block", "group"), [(500, 8, 4096, 512), (700, 3, 64, 2), (5, 4, 2, 1)])
def test_equals_brute_force(spark, n, dims, block, group):
    rows = random_rows(n, n, dims)
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = top_k(frame, F.col("vec_id") % 100 == 0, 10, block_vectors=block, group_queries=group)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 10)


def test_index_stops_only_on_proof():
    pick = np.random.default_rng(5)
    vectors = pick.integers(-2000, 2000, (3000, 16))
    vectors[::7] = vectors[0]
    index = ImpactIndex(np.arange(3000), vectors)
    for q in pick.integers(-2000, 2000, (20, 16)):
        members, scores = index.search(-1, q, 10)
        want = np.lexsort((np.arange(3000), -(vectors @ q)))[:10]
        assert (members == want).all() and (scores == (vectors @ q)[want]).all()


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF001}/embeddings.parquet'")
    want = con.execute(queries.ORACLE["op8_topk"]).fetchall()
    assert sorted(tuple(r) for r in op8_topk(spark, SF001).collect()) == sorted(want)


def test_rows_that_repeat_a_key_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (3, [9.0, 9.0]), (3, [1.0, 1.0]), (4, []), (100, [2.0, 0.0]), (None, [1.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, 10)
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows, 10) and sum(r[2] == 3 for r in got) == 4 and sum(r[2] == 4 for r in got) == 2


def test_scores_beyond_64_bits_raise(spark):
    frame = spark.createDataFrame([(100, [1e300, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(frame, F.col("vec_id") % 100 == 0, 10)
    large = spark.createDataFrame([(100, [1e5, 1.0]), (2, [-1e5, 1.0])], "vec_id long, embedding array<double>")
    assert top_k(large, F.col("vec_id") % 100 == 0, 10).first()["score"] == -(102_400_000 ** 2) + 1024 ** 2


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0, 10).collect() == []
