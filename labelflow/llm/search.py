"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors of integers are dealt to blocks, queries to groups, and every (block,
group) cell is searched by itself; a query's best of all blocks are merged. A
cell's index cuts each dimension into levels of equal width; a posting segment
lists the vectors of one (dimension, level). For a query a segment's impact is
the least it adds above the dimension's smallest contribution, so impacts are
never negative. Segments are processed by falling impact. What a vector can
still gain is bounded by the best segment left in each dimension plus the level
width; as soon as few vectors can reach the k-th best lower bound, processing
stops, and all vectors that can are scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, ship, stored

BLOCK_VECTORS = 4096
GROUP_QUERIES = 512
LEVELS = 32
#: Segments are accumulated in so many waves; the proof is tried after each.
WAVES = 16
#: A wave's proof is accepted when at most so many vectors are left to score exactly.
RESCORE = 256
#: Scores must stay below this, so that 64 bits and the sums of bounds hold them.
TOO_LARGE = float(1 << 62)


class ImpactIndex:
    """Posting segments of one block of integer vectors; ``rows`` name them, ``places`` break ties."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, places: np.ndarray | None = None, levels: int = LEVELS):
        self.rows, self.vectors = rows, vectors
        self.places = rows if places is None else places
        n, dims = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = (high - low) // levels + 1
        level = (vectors - low) // self.width
        self.low = low + np.arange(levels)[:, None] * self.width  # least value of a segment, [level, dimension]
        segment = (np.arange(dims) * levels + level).T.ravel()
        order = np.argsort(segment, kind="stable")
        self.postings = np.tile(np.arange(n), dims)[order]
        self.borders = np.searchsorted(segment[order], np.arange(dims * levels + 1))
        self.levels = levels

    def search(self, query_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best vectors, ties to the smaller place."""
        sizes = np.diff(self.borders)
        least = np.minimum(query * self.low, query * (self.low + self.width - 1)).T.ravel()
        slack = np.abs(query) * (self.width - 1)
        filled = np.flatnonzero(sizes)
        dimension = filled // self.levels
        floor = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(floor, dimension, least[filled])
        impact = least[filled] - floor[dimension]
        order = np.argsort(-impact, kind="stable")
        filled, dimension, impact = filled[order], dimension[order], impact[order]
        total = np.zeros(len(self.rows))
        own = self.rows == query_row
        total[own] = -np.inf
        wave = max(1, math.ceil(len(filled) / WAVES))
        able = ~own
        for lo in range(0, len(filled), wave):
            part = filled[lo:lo + wave]
            posted = np.concatenate([self.postings[self.borders[s]:self.borders[s + 1]] for s in part])
            total += np.bincount(posted, np.repeat(impact[lo:lo + wave], sizes[part]), len(self.rows))
            left = np.zeros(len(query), np.int64)
            np.maximum.at(left, dimension[lo + wave:], impact[lo + wave:])
            if len(total) > k:
                reach = np.partition(total, len(total) - k)[len(total) - k]
                able = (total + float(left.sum() + slack.sum()) >= reach) & ~own
                if np.count_nonzero(able) <= RESCORE:
                    break
        member = np.flatnonzero(able)
        scores = self.vectors[member] @ query
        best = np.lexsort((self.places[member], -scores))[:k]
        return member[best], scores[best]


def integer_vector(vector: str, scale: int) -> Column:
    """Each component as floor(scale * x), a whole double; null unless all are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # of a double, floor gives a long, which huge values do not fit: they are told apart first
    whole = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < TOO_LARGE, F.floor(x.cast("double") * scale).cast("double"))
                        .otherwise(x.cast("double") * scale))
    return F.when(F.col(vector).isNotNull() & finite, whole)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
          scale: int = 1024, block_vectors: int = BLOCK_VECTORS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k best other rows.

    Every row is a candidate of every query but itself, whatever its key: rows
    that repeat a key are rows of their own, on either side, and a null key
    comes last among equal scores. A null vector, or one with a null or
    non-finite component, takes no part; an empty one scores 0. A vector shorter
    than the longest has zeros after its end. Ties go to the smaller key; with
    fewer other rows all are returned; an empty table gives an empty table.
    Components so large that a score could pass 64 bits raise ``ValueError``.
    Other columns are not carried."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), integer_vector(vector, scale).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("query")).where("v is not null")
    # stored with its number, so that a row is the same row wherever it is sent
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shape = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q"), F.max(F.size("v")).alias("d"),
                     F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    n_blocks = max(1, math.ceil(shape["n"] / block_vectors))
    n_groups = max(1, math.ceil(shape["q"] / group_queries))
    dims = shape["d"] or 1
    if (shape["m"] or 0.0) >= math.sqrt(TOO_LARGE / dims):
        raise ValueError(f"components up to {shape['m']:g} in {dims} dimensions: scores may pass 64 bits")
    rows = rows.withColumn("v", F.col("v").cast("array<bigint>"))

    def everywhere(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cells = (rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
             .select("block", everywhere(n_groups).alias("group"), "row", "id", "v", F.lit(False).alias("query"))
             .unionByName(
                 rows.where("query").withColumn("group", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(n_groups)).cast("int"))
                 .select(everywhere(n_blocks).alias("block"), "group", "row", "id", "v", "query")))

    def run(table: pa.Table) -> pa.Table:
        number = table.column("row").to_numpy()
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        values = table.column("v").combine_chunks()
        ends = np.asarray(values.offsets)
        matrix = np.zeros((len(number), dims), np.int64)
        lengths = np.diff(ends)
        matrix[np.arange(dims) < lengths[:, None]] = np.asarray(values.values)[ends[0]:ends[-1]]
        ids = table.column("id").combine_chunks()
        at, asked = np.flatnonzero(~query), np.flatnonzero(query)
        owner, member, score = [], [], []
        if len(at) and len(asked):
            by_key = np.argsort(pc.array_sort_indices(ids.take(at), null_placement="at_end").to_numpy(), kind="stable")
            index = ImpactIndex(number[at], matrix[at], by_key)
            for q in asked:
                found, scores = index.search(number[q], matrix[q], k)
                owner += [q] * len(found)
                member += at[found].tolist()
                score += scores.tolist()
        owner, member = pa.array(owner, pa.int64()), pa.array(member, pa.int64())
        return pa.table([table.column("row").take(owner), ids.take(owner), ids.take(member), pa.array(score, pa.int64())],
                        names=["query_row", "query_id", "vec_id", "score"])

    key_type = vectors.schema[key].dataType.simpleString()
    best = cells.groupBy("block", "group").applyInArrow(
        run, f"query_row bigint, query_id {key_type}, vec_id {key_type}, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every vector whose id is divisible by 100."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


TOPK_SQL = """
with whole as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.r, q.vec_id as query_id, c.vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) as bigint) as score
  from whole q join whole c on q.r <> c.r
  where q.vec_id % 100 = 0
), ranked as (
  select query_id, row_number() over (partition by r order by score desc, vec_id nulls last) as rank, vec_id, score
  from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""
