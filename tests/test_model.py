"""Optional G9, save/load, sweep, batch = stream."""

import math

import pytest
from pyspark.sql import functions as F

from labelflow.operators import clean
from labelflow.operators.model import fit_classifier, load_model, predict, save_model
from labelflow.operators.scoring import score_texts
from labelflow.plans.experiments import split_table
from labelflow.sources.labelled import read_labelled_csv
from labelflow.streaming import score_stream
from tests.conftest import GOLDEN_PREDICTIONS, GOLDEN_TEST, GOLDEN_TRAIN, SF01


@pytest.fixture(scope="module")
def fitted(spark):
    s = split_table(spark, SF01)
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test").select("row_id", "text", "language", "label", "label_id")
    return fit_classifier(train), train, test


def _lab(spark, path):
    df = read_labelled_csv(spark, [path]).withColumn("row_id", F.monotonically_increasing_id())
    return clean.label_encode(clean.clean_labelled(df, require=("text", "label")))


@pytest.mark.skipif(not (GOLDEN_TRAIN and GOLDEN_TEST and GOLDEN_PREDICTIONS),
                    reason="set LABELFLOW_GOLDEN_TRAIN / _TEST / _PREDICTIONS to run G9")
def test_g9_golden_predictions(spark):
    model = fit_classifier(_lab(spark, GOLDEN_TRAIN).cache())
    got = predict(model, _lab(spark, GOLDEN_TEST)).select("row_id", "predicted_label").orderBy("row_id").collect()
    want = [r.predicted_label for r in spark.read.option("header", True).csv(GOLDEN_PREDICTIONS).collect()]
    assert [r.predicted_label for r in got] == want


def test_save_load_same_predictions(spark, fitted, tmp_dir):
    model, _, test = fitted
    save_model(model, f"{tmp_dir}/model")
    again = load_model(f"{tmp_dir}/model")
    a = predict(model, test).orderBy("row_id").collect()
    b = predict(again, test).orderBy("row_id").collect()
    assert [r.predicted_label for r in a] == [r.predicted_label for r in b]
    for r in a:
        assert math.isclose(sum(r.probabilities), 1.0, abs_tol=1e-9)


def test_blank_guard_and_stream_equals_batch(spark, fitted, tmp_dir):
    model, _, test = fitted
    texts = test.select("row_id", "text").union(
        spark.createDataFrame([(1000, "   "), (1001, None), (1002, "Sehr gut")], "row_id long, text string"))
    src = f"{tmp_dir}/src"
    texts.coalesce(2).write.parquet(src)
    batch = score_texts(model, spark.read.parquet(src)).select("row_id", "predicted_label", "status")
    stream = score_stream(spark, model, src, texts.schema, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    b = sorted(tuple(r) for r in batch.collect())
    s = sorted(tuple(r) for r in stream.select("row_id", "predicted_label", "status").collect())
    assert b == s
    blank = {r[0]: r for r in b if r[0] >= 1000}
    assert blank[1000][2] == "empty_input" and blank[1000][1] is None
    assert blank[1001][2] == "empty_input" and blank[1002][2] == "ok"


def test_sweep_one_table_per_run(spark, fitted):
    from labelflow.operators import evaluate
    from labelflow.operators.model import sweep

    _, train, test = fitted
    grid = [("c1", {}), ("c01", {"inverse_reg": 0.1}), ("it5", {"max_iter": 5})]
    runs = sweep(train, test, grid)
    n = test.count()
    counts = {r.model: r["count"] for r in runs.groupBy("model").count().collect()}
    assert counts == {"c1": n, "c01": n, "it5": n}
    met = {r.model: r for r in evaluate.metrics_record(runs).collect()}
    assert set(met) == {"c1", "c01", "it5"} and all(0.0 <= m.accuracy <= 1.0 for m in met.values())


def test_score_texts_probability_map(spark, fitted):
    from labelflow.constants import LABELS

    model, _, test = fitted
    out = score_texts(model, test.select("row_id", "text"), digits=4).collect()
    assert out and all(r.status == "ok" for r in out)
    for r in out:
        assert sorted(r.probabilities) == sorted(LABELS)
        assert all(round(v, 4) == v for v in r.probabilities.values())
        assert math.isclose(sum(r.probabilities.values()), 1.0, abs_tol=2e-4)
        assert r.probabilities[r.predicted_label] == max(r.probabilities.values())


def test_input_columns_travel_unchanged(spark, fitted):
    model, _, _ = fitted
    rows = [(1, "  padded  ", "keep"), (2, None, "x"), (3, " ", "y")]
    out = score_texts(model, spark.createDataFrame(rows, "row_id long, text string, terms string")).collect()
    assert sorted((r.row_id, r.text, r.terms) for r in out) == sorted(rows, key=lambda r: r[0])
    assert {r.row_id: r.status for r in out} == {1: "ok", 2: "empty_input", 3: "empty_input"}


def test_absent_last_class_and_null_labels(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} text {i}", i % 2) for i in range(20)] + [(99, "not counted " * 5, None)]
    train = spark.createDataFrame(rows, "row_id long, text string, label_id int")
    model = fit_classifier(train)
    got = score_texts(model, train.select("row_id", "text")).first()
    assert sorted(got.probabilities) == ["negative", "neutral"]
    vocabulary = next(st for st in model.stages if hasattr(st, "vocabulary")).vocabulary
    assert "counted" not in vocabulary


def test_run_returns_four_results(spark, fitted, tmp_dir):
    from labelflow.operators.model import run_experiment, write_results

    _, train, test = fitted
    results = run_experiment("r", train, test, max_iter=20)
    write_results(results, tmp_dir)
    sizes = {name: spark.read.parquet(f"{tmp_dir}/{name}").count() for name in results}
    assert sizes == {"metrics": 1, "report": 6, "confusion": 9, "predictions": test.count()}


def test_score_stream_reads_a_table_of_one_file_or_of_many(spark, tmp_dir):
    import glob
    import os

    from labelflow.plans.experiments import score_stream_query

    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i % 5}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    for kind in ("folder", "file"):
        d = f"{tmp_dir}/{kind}"
        labels.write.parquet(f"{d}/labels.parquet")
        if kind == "folder":
            docs.repartition(3).write.parquet(f"{d}/documents.parquet")
        else:
            docs.coalesce(1).write.parquet(f"{d}-parts")
            os.link(glob.glob(f"{d}-parts/part-*")[0], f"{d}/documents.parquet")
        assert [tuple(r) for r in score_stream_query(spark, d).collect()] == [(60, 0)]


def test_training_features_are_made_of_the_text_once(spark):
    from labelflow.operators.features import fit_tfidf
    from labelflow.operators.model import training_features

    rows = [(i, f"{'good' if i % 2 else 'bad'} text {i % 5}", i % 2 if i % 7 else None) for i in range(40)]
    train = spark.createDataFrame(rows, "row_id long, text string, label_id int")
    feats = training_features(train, fit_tfidf(train), rows_per_partition=10)
    # a fit reads its rows several times: what it reads holds features, not the steps from the text
    assert "regexp_extract_all" not in feats._jdf.queryExecution().toString()
    assert sorted(r["_y"] for r in feats.collect()) == sorted(float(r[2]) for r in rows if r[2] is not None)
    assert feats.rdd.getNumPartitions() <= 4


def test_a_stream_of_one_file_is_spread_over_tasks(spark, fitted, tmp_dir):
    from labelflow.streaming import count_stream

    model, _, test = fitted
    rows = test.select("row_id", "text", "label")
    rows.coalesce(1).write.parquet(f"{tmp_dir}/src")
    found = [sorted(tuple(r) for r in count_stream(spark, model, f"{tmp_dir}/src", rows.schema, f"{tmp_dir}/sink{n}", f"{tmp_dir}/ckpt{n}",
                                                   max_files_per_trigger=1, spread_over=n).collect()) for n in (None, 3)]
    assert found[0] == found[1] and sum(r[2] for r in found[0]) == test.count()


def test_a_model_without_the_last_class_scores_and_counts_a_stream(spark, tmp_dir):
    from labelflow.plans.experiments import score_stream_query
    from labelflow.streaming import count_stream

    # no row is positive, so the fitted model has probabilities for two classes only
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i % 5}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    docs.write.parquet(f"{tmp_dir}/sf/documents.parquet")
    labels.write.parquet(f"{tmp_dir}/sf/labels.parquet")
    s = split_table(spark, f"{tmp_dir}/sf")
    assert {r.label for r in s.select("label").distinct().collect()} == {"negative", "neutral"}
    assert [tuple(r) for r in score_stream_query(spark, f"{tmp_dir}/sf").collect()] == [(60, 0)]

    model = fit_classifier(s.where("split = 'train'"))
    rows = s.select("row_id", "text", "label")
    rows.write.parquet(f"{tmp_dir}/src")
    counted = count_stream(spark, model, f"{tmp_dir}/src", rows.schema, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    batch = predict(model, rows).groupBy("label", "predicted_label").count()
    assert sorted(tuple(r) for r in counted.collect()) == sorted(tuple(r) for r in batch.collect())


@pytest.mark.parametrize("layout", ["folder", "file", "partitioned"])
def test_score_stream_reads_what_the_batch_reads(spark, tmp_dir, layout):
    import glob
    import os

    from labelflow.plans.experiments import score_stream_query

    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i % 5}", "en" if i % 4 else "de") for i in range(60)],
                                 "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    d = f"{tmp_dir}/sf" if layout == "partitioned" else f"{tmp_dir}/2026-01-01T00:00/sf=1"  # no pattern takes a colon in a path
    labels.write.parquet(f"{d}/labels.parquet")
    if layout == "partitioned":
        docs.write.partitionBy("lang").parquet(f"{d}/documents.parquet")
    elif layout == "folder":
        docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    else:
        docs.coalesce(1).write.parquet(f"{d}/parts")
        os.link(glob.glob(f"{d}/parts/part-*")[0], f"{d}/documents.parquet")
    assert [tuple(r) for r in score_stream_query(spark, d).collect()] == [(60, 0)]


def test_a_stream_of_a_partitioned_table_keeps_its_columns(spark, fitted, tmp_dir):
    from labelflow.streaming import table_source

    model, _, _ = fitted
    rows = [(i, "Sehr gut" if i % 2 else None, "en" if i % 3 else "de") for i in range(12)]
    spark.createDataFrame(rows, "row_id long, text string, lang string").write.partitionBy("lang").parquet(f"{tmp_dir}/docs")
    source, path_glob = table_source(spark, f"{tmp_dir}/docs")
    out = score_stream(spark, model, source, spark.read.parquet(f"{tmp_dir}/docs").schema, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt", path_glob=path_glob)
    assert sorted((tuple(r) for r in out.select("row_id", "text", "lang").collect()), key=lambda r: r[0]) == rows
