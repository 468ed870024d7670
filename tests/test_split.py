import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelflow.operators import split
from labelflow.plans.base import labelled
from tests.conftest import SF01


def test_quotas_worked_example():
    q = split.split_quotas({"negative": 51, "neutral": 49, "positive": 299}, 0.3, 0.5)
    assert q == {"negative": [36, 8, 7], "neutral": [34, 7, 8], "positive": [209, 45, 45]}


def test_quotas_reference_shape():
    # 120 rows, 40 per class -> 84 / 18 / 18, 28 / 6 / 6 per class
    q = split.split_quotas({"negative": 40, "neutral": 40, "positive": 40}, 0.3, 0.5)
    assert all(v == [28, 6, 6] for v in q.values())


def test_single_member_class_raises():
    with pytest.raises(ValueError, match="least populated"):
        split.split_quotas({"a": 10, "b": 1}, 0.3)


def test_split_counts_on_test_data(spark):
    s = split.split_70_15_15(labelled(spark, SF01))
    got = {(r.split, r.label): r.n for r in s.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert got[("train", "negative")] == 36 and got[("val", "negative")] == 8 and got[("test", "negative")] == 7
    assert got[("train", "positive")] == 209 and got[("val", "neutral")] == 7 and got[("test", "neutral")] == 8
    assert s.count() == 399 and s.select("row_id").distinct().count() == 399


def test_bucketed_rank_equals_brute_force(spark):
    # a skewed fixture: one class holds most rows, so many buckets straddle nothing
    df = spark.range(0, 20000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("label"))
    got = split.split_70_15_15(df).select("row_id", F.col("split").alias("got"))
    h = F.md5(F.concat_ws("-", F.lit("42"), F.col("row_id").cast("string")))
    rk = F.row_number().over(Window.partitionBy("label").orderBy(h, "row_id"))
    counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    quotas = split.split_quotas(counts, 0.3, 0.5)
    qm = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    want = df.withColumn("rk", rk).select(
        "row_id",
        F.when(F.col("rk") <= qm[F.col("label")][0], "train")
        .when(F.col("rk") <= qm[F.col("label")][0] + qm[F.col("label")][1], "val").otherwise("test").alias("want"))
    j = got.join(want, "row_id")
    assert j.count() == 20000
    assert j.where(F.col("got") != F.col("want")).count() == 0


def test_split_independent_of_partitioning(spark):
    lab = labelled(spark, SF01)
    a = {r.row_id: r.split for r in split.stratified_split(lab).collect()}
    b = {r.row_id: r.split for r in split.stratified_split(lab.repartition(3)).collect()}
    assert a == b


def test_one_huge_class_and_a_thousand_small_ones(spark):
    df = spark.range(0, 60000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 54000, F.lit("huge")).otherwise(
            F.concat(F.lit("c"), (F.col("id") % 1000).cast("string"))).alias("label"))
    rows = split.stratified_split(df).groupBy("label", "split").count().collect()
    got = {(r.label, r.split): r["count"] for r in rows}
    assert len({r.label for r in rows}) == 1001 and sum(got.values()) == 60000
    assert got[("huge", "train")] == 37800 and got[("huge", "test")] == 16200
    assert sum(n for (_, part), n in got.items() if part == "test") == 18000


def test_part_without_rows(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)] + [(10 + i, "b") for i in range(2)], "row_id long, label string")
    borders = split.part_borders(df, {"a": [0, 4, 6], "b": [2, 0, 0]}, split._bucket_counts(df, "label", "row_id", 1), 1,
                                 "label", "row_id")
    got = split.assign_parts(df, borders, ("train", "val", "test"), 1).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {("a", "val"): 4, ("a", "test"): 6, ("b", "train"): 2}
