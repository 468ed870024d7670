"""K1-K4 round trips and the X1/X3 batch-map helper."""

from pyspark.sql import functions as F

from labelflow.operators import evaluate
from labelflow.operators.scoring import map_batches
from labelflow.sinks import write_keyed_csv, write_metrics_json, write_split_table, write_table_csv
from labelflow.sources.labelled import read_split
from labelflow.sources.records import read_keyed_csv, read_metrics, read_table_csv


def _preds(spark):
    rows = [(1, "m", "negative", "negative"), (2, "m", "neutral", "positive"), (3, "m", "positive", "positive"),
            (4, "m", "positive", "neutral")]
    return spark.createDataFrame(rows, "row_id long, model string, label string, predicted_label string")


def test_table_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'text, with "quotes"', "de"), (2, "Привет\nмир", "ru")],
                               "row_id long, text string, language string")
    write_table_csv(df, f"{tmp_dir}/t")
    back = read_table_csv(spark, f"{tmp_dir}/t", multi_line=True).select(F.col("row_id").cast("long"), "text", "language")
    assert sorted(back.collect()) == sorted(df.collect())


def test_blanks_and_byte_order_mark(spark, tmp_dir):
    import glob

    df = spark.createDataFrame([(" padded ", "x")], "text string, language string")
    write_table_csv(df, f"{tmp_dir}/b", byte_order_mark=True)
    with open(glob.glob(f"{tmp_dir}/b/*.csv")[0], "rb") as fh:
        assert fh.read(3) == b"\xef\xbb\xbf"
    back = read_table_csv(spark, f"{tmp_dir}/b")
    assert back.columns == ["text", "language"] and back.first().text == " padded "


def test_keyed_report_round_trip(spark, tmp_dir):
    rep = evaluate.classification_report(_preds(spark)).drop("model")
    write_keyed_csv(rep, f"{tmp_dir}/rep")
    back = read_keyed_csv(spark, f"{tmp_dir}/rep").collect()
    assert [r.row_name for r in back] == ["negative", "neutral", "positive", "accuracy", "macro avg", "weighted avg"]
    assert float(back[3].precision) == 0.5


def test_metrics_json_round_trip(spark, tmp_dir):
    met = evaluate.metrics_record(_preds(spark))
    write_metrics_json(met, f"{tmp_dir}/met")
    import glob

    files = glob.glob(f"{tmp_dir}/met/*.json")
    back = read_metrics(spark, files).first()
    assert back.model == "m" and back.accuracy == 0.5


def test_split_table_partition_pruning(spark, tmp_dir):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "row_id long, split string")
    write_split_table(df, f"{tmp_dir}/s")
    val = read_split(spark, f"{tmp_dir}/s", "val")
    assert [r.row_id for r in val.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()


def test_map_batches_loads_once_per_task(spark):
    df = spark.range(0, 100, numPartitions=4).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("x"))

    def make():
        table = {i: i * i for i in range(7)}  # stands for a model loaded once per task
        return lambda pdf: pdf.assign(y=pdf["x"].map(table))

    out = map_batches(df, make, "row_id long, x long, y long")
    assert all(r.y == r.x * r.x for r in out.collect())


def test_scratch_is_dropped_only_when_asked(spark, tmp_dir, monkeypatch):
    import os

    from labelflow import session

    monkeypatch.setattr(session, "checkpoint_root", lambda _: tmp_dir)
    frame = session.store(spark.range(5), "numbers")
    assert frame.count() == 5 and os.listdir(f"{tmp_dir}/labelflow")
    session.drop_scratch(spark)
    assert not os.path.exists(f"{tmp_dir}/labelflow") and os.path.exists(tmp_dir)
