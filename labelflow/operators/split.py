"""Exact, reproducible stratified splits (M1, M2) and distribution counts.

Semantics: ``n_test = ceil(n * test_size)``, ``n_train = n - n_test``; the
train quota of each class is ``floor(n_train * c / n)`` plus one for the
classes with the largest remainders (ties: label order); the rest is test.
Rows are ranked within their class by ``md5("<seed>-<row_id>")`` then
``row_id``: a deterministic order, so a lost task recomputes the same split.

Scale: a plain ``row_number().over(partitionBy(label))`` would put a whole
class -- possibly a third of all rows -- into one task, with its text. Instead
the part borders are found from ids alone: rows are counted in 16**4 hash
buckets per class (partial aggregation), prefix sums tell the one bucket per
class and cut that holds the border, and only the ids of those buckets are
ranked. The border is the (hash, row_id) of the last row of a part: at most
two small rows per class. One narrow pass over the input then compares each
row with its class's borders; the text is neither shuffled nor sorted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RANDOM_STATE, SPLIT_BUCKET_HEX_DIGITS, TEST_SIZE, VAL_TEST_SIZE
from ..session import materialize, store


def approximate_mode(counts: Mapping[str, int], n_draws: int) -> dict[str, int]:
    """Per-class quotas summing to ``n_draws``: floor of the proportional share
    plus one for the largest remainders; equal remainders go in label order."""
    n = sum(counts.values())
    labels = sorted(counts)
    cont = {lab: counts[lab] / n * n_draws for lab in labels}
    quota = {lab: math.floor(cont[lab]) for lab in labels}
    need = n_draws - sum(quota.values())
    for lab in sorted(labels, key=lambda x: (-(cont[x] - quota[x]), x))[:need]:
        quota[lab] += 1
    return quota


def _check_split(counts: Mapping[str, int], n_train: int, n_test: int) -> None:
    k = len(counts)
    if k and min(counts.values()) < 2:
        raise ValueError("the least populated class has only 1 member; stratification needs at least 2")
    if n_train < k:
        raise ValueError(f"train size {n_train} is smaller than the number of classes {k}")
    if n_test < k:
        raise ValueError(f"test size {n_test} is smaller than the number of classes {k}")


def split_quotas(counts: Mapping[str, int], test_size: float = TEST_SIZE,
                 second_test_size: float | None = None) -> dict[str, list[int]]:
    """Quotas per class: ``[train, test]`` or, with a second split of the
    held-out part, ``[train, val, test]``."""
    n = sum(counts.values())
    n_test = math.ceil(float(test_size) * n)
    n_train = n - n_test
    _check_split(counts, n_train, n_test)
    train = approximate_mode(counts, n_train)
    rest = {lab: counts[lab] - train[lab] for lab in counts}
    if second_test_size is None:
        return {lab: [train[lab], rest[lab]] for lab in counts}
    n2 = sum(rest.values())
    n_test2 = math.ceil(float(second_test_size) * n2)
    n_val = n2 - n_test2
    _check_split(rest, n_val, n_test2)
    val = approximate_mode(rest, n_val)
    return {lab: [train[lab], val[lab], rest[lab] - val[lab]] for lab in counts}


def _hash_key(seed: int, id_col: str):
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))


def _bucket(h):
    return F.conv(F.substring(h, 1, SPLIT_BUCKET_HEX_DIGITS), 16, 10).cast("int")


def _bucket_counts(df: DataFrame, label_col: str, id_col: str, seed: int) -> DataFrame:
    return df.select(label_col, _bucket(_hash_key(seed, id_col)).alias("_b")).groupBy(label_col, "_b").agg(
        F.count(F.lit(1)).alias("_n"))


def class_counts_of(bucket_counts: DataFrame, label_col: str) -> dict[str, int]:
    """Rows per class: one row per class comes to the driver."""
    rows = bucket_counts.groupBy(label_col).agg(F.sum("_n").alias("n")).collect()
    if any(r[0] is None for r in rows):
        raise ValueError("null labels cannot be stratified; clean the input first")
    return {r[0]: int(r[1]) for r in rows}


def part_borders(df: DataFrame, quotas: Mapping[str, Sequence[int]], bucket_counts: DataFrame, seed: int,
                 label_col: str, id_col: str) -> DataFrame:
    """``(label, borders)``: for each class the (hash, id) of the last row of
    every part but the last, in order; a part without rows has the border of
    the one before it (or an empty hash). At most two borders per class."""
    spark = df.sparkSession
    types = f"_l {df.schema[label_col].dataType.simpleString()}, _cut int, _rank long"
    cuts = spark.createDataFrame(
        [(lab, i, c) for lab, q in quotas.items() for i, c in enumerate(_cumulative(q)[:-1])], types)
    upto = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = bucket_counts.withColumn("_hi", F.sum("_n").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    held = ranges.join(cuts, (F.col(label_col) == F.col("_l")) & (F.col("_rank") > F.col("_lo"))
                       & (F.col("_rank") <= F.col("_hi"))).select(label_col, "_b", "_lo", "_cut", "_rank")
    ids = df.select(label_col, F.col(id_col).alias("_id"), _hash_key(seed, id_col).alias("_h"))
    inside = ids.withColumn("_b", _bucket(F.col("_h"))).join(
        held.groupBy(label_col, "_b", "_lo").agg(F.collect_list(F.struct("_cut", "_rank")).alias("_cuts")),
        [label_col, "_b"])
    place = F.col("_lo") + F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", "_id"))
    last = inside.withColumn("_place", place).select(
        label_col, "_h", "_id", "_place", F.explode("_cuts").alias("_c")).where("_place = _c._rank")
    found = last.groupBy(label_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_c._cut").alias("cut"), "_h", "_id"))).alias("borders"))
    return cuts.select(F.col("_l").alias(label_col)).distinct().join(found, label_col, "left")


def assign_parts(df: DataFrame, borders: DataFrame, parts: Sequence[str], seed: int = RANDOM_STATE,
                 label_col: str = "label", id_col: str = "row_id", out_col: str = "split") -> DataFrame:
    """Give each row the part it falls in: the number of its class's borders
    that it lies behind. Cuts without a border (empty parts at the start) are
    behind every row."""
    n_cuts = len(parts) - 1
    here = F.struct(_hash_key(seed, id_col).alias("_h"), F.col(id_col).alias("_id"))
    borders = borders.withColumnRenamed("borders", "_borders")
    joined = df.join(borders, label_col, "left")
    marks = F.coalesce(F.col("_borders"), F.array().cast(borders.schema["_borders"].dataType))
    missing = F.lit(n_cuts) - F.size(marks)
    ahead = F.size(F.filter(marks, lambda m: F.struct(m["_h"].alias("_h"), m["_id"].alias("_id")) < here))
    names = F.array(*[F.lit(p) for p in parts])
    return joined.withColumn(out_col, F.element_at(names, missing + ahead + 1)).drop("_borders")


def _cumulative(q: Sequence[int]) -> list[int]:
    out, s = [], 0
    for x in q:
        s += int(x)
        out.append(s)
    return out


def stratified_split(df: DataFrame, test_size: float = TEST_SIZE, seed: int = RANDOM_STATE,
                     label_col: str = "label", id_col: str = "row_id",
                     parts: Sequence[str] = ("train", "test")) -> DataFrame:
    """M1: one exact stratified split; adds ``split`` (train / test)."""
    return _split(df, test_size, None, seed, label_col, id_col, parts)


def split_70_15_15(df: DataFrame, seed: int = RANDOM_STATE, label_col: str = "label",
                   id_col: str = "row_id", test_size: float = TEST_SIZE,
                   second_test_size: float = VAL_TEST_SIZE) -> DataFrame:
    """M2: train / val / test from one rank with two quota levels."""
    return _split(df, test_size, second_test_size, seed, label_col, id_col, ("train", "val", "test"))


def _split(df, test_size, second, seed, label_col, id_col, parts):
    # The counts feed the quotas (a row per class on the driver) and the borders.
    counts = materialize(_bucket_counts(df, label_col, id_col, seed))
    quotas = split_quotas(class_counts_of(counts, label_col), test_size, second)
    if not quotas:
        return df.withColumn("split", F.lit(parts[0]))
    borders = store(part_borders(df, quotas, counts, seed, label_col, id_col).coalesce(1), "part-borders")
    return assign_parts(df, borders, parts, seed, label_col, id_col)


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1: rows per class, most frequent first (ties by label)."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label_col)


def distinct_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A3."""
    return df.select(label_col).distinct()


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """A2: all part sizes in one job."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))


def train_val_union(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Train and val rows together, duplicates kept."""
    return df.where(F.col(split_col).isin("train", "val"))
