"""End-to-end runs on the test data.

Fitting is iterative (L-BFGS), so SQL cannot give the fitted numbers. These
queries return what must hold of them instead -- which rows come out, that
labels are known, that the optimiser's gradient has vanished, that a saved
model and a stream score like the model itself -- and tests compare the
numbers with brute force on small fixtures.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.text import na_to_null
from ..operators import clean, compare, evaluate, split
from ..operators.model import (RESULTS, assemble, fit_classifier, fit_grid, largest_gradient, load_model, predict, run_experiment,
                               save_model, score_grid, sweep, write_results)
from ..operators.rounds import run_rounds
from ..operators.scoring import score_texts
from ..operators.stacked import Setting, as_model
from ..session import scratch_path, store
from ..streaming import count_stream, score_stream, stream_metrics, table_source
from .base import labelled, raw_labelled, table

BASELINE = "tfidf_lr"
SWEEP = (
    ("lr_c1", {}),
    ("lr_c0.1", {"inverse_reg": 0.1}),
    ("lr_c10_it50", {"inverse_reg": 10.0, "max_iter": 50}),
    ("lr_prior", {"inverse_reg": 1e-6}),
)
#: So strong a penalty leaves the classes' shares alone: such a run predicts the commonest class of its training
#: rows everywhere, and SQL can tell all its numbers.
PRIOR = {"inverse_reg": 1e-6}


#: The tuned run's own parameters.
TUNED = {"inverse_reg": 4.0, "max_iter": 300, "max_features": 8000}


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded labelled rows stored by part: fit and evaluation read their files only."""
    lab = clean.label_encode(labelled(spark, sf_dir))
    return store(split.split_70_15_15(lab), "splits", partition_by="split")


def _part(s: DataFrame, *names: str) -> DataFrame:
    return s.where(F.col("split").isin(*names))


def lr_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 + M6: fit on train, predict test; the largest gradient entry to two places."""
    s = split_table(spark, sf_dir)
    model = fit_classifier(_part(s, "train"))
    gradient = round(largest_gradient(model, _part(s, "train")).first()["gradient"], 2)
    return predict(model, _part(s, "test"), keep=["row_id", "label"]).select(
        "row_id", "label", F.col("predicted_label").isin(*LABELS).alias("known_label"),
        F.lit(abs(gradient)).alias("gradient"))


def baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split -> TF-IDF -> LR -> classification report on test."""
    s = split_table(spark, sf_dir)
    results = run_experiment(BASELINE, _part(s, "train"), _part(s, "test"))
    return results["report"].select("model", "row_name", "row_idx",
                                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def _written(spark: SparkSession, results: dict[str, DataFrame]) -> DataFrame:
    """Rows of each result, written and read back."""
    path = scratch_path(spark, "results")
    write_results(results, path)
    out = None
    for name in results:
        n = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("result"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def _clean_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty rows, cleaned, with a known label, split and stored by part."""
    raw = raw_labelled(spark, sf_dir).select("row_id", na_to_null(F.col("text")).alias("text"),
                                             na_to_null(F.col("label")).alias("label"))
    good = clean.clean_labelled(raw, require=("text", "label"), strict=False).where(F.col("label").isin(*LABELS))
    return store(split.split_70_15_15(good), "splits", partition_by="split")


def baseline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty rows -> clean -> split -> fit -> metrics, report, confusion and predictions on test."""
    s = _clean_split(spark, sf_dir)
    return _written(spark, run_experiment(BASELINE, _part(s, "train"), _part(s, "test")))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: score every document: its status, whether it got a label, and the sum of its probabilities."""
    model = fit_classifier(_part(split_table(spark, sf_dir), "train"))
    scored = score_texts(model, _documents(spark, sf_dir))
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda acc, p: acc + p)
    return scored.select("row_id", "status", F.col("predicted_label").isin(*LABELS).alias("labelled"),
                         F.round(total, 6).alias("p_sum")).na.fill({"labelled": False})


def _difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of the first, and how many of all are scored otherwise or only in one."""
    both = one.join(other.withColumnsRenamed({"predicted_label": "l", "status": "s"}), "row_id", "full")
    same = F.col("predicted_label").eqNullSafe(F.col("l")) & F.col("status").eqNullSafe(F.col("s"))
    return both.agg(F.count("status").alias("n_rows"), F.count_if(~same).cast("int").alias("n_different"))


def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a saved and loaded model scores every document like the model itself."""
    model = fit_classifier(_part(split_table(spark, sf_dir), "train"))
    path = scratch_path(spark, "model")
    save_model(model, path)
    docs, columns = _documents(spark, sf_dir), ("row_id", "predicted_label", "status")
    return _difference(score_texts(load_model(path), docs).select(*columns), score_texts(model, docs).select(*columns))


def experiment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: several parameter settings fitted in the same passes, one scan of the
    evaluation text. Rows evaluated per run, the largest gradient entry to two
    places, and of the run whose penalty leaves the classes' shares alone its F1."""
    s = split_table(spark, sf_dir)
    fit, found = fit_grid(_part(s, "train"), SWEEP)
    names = [name for name, _ in SWEEP]
    runs = store(score_grid(fit, names, found.weights(), _part(s, "val").select("row_id", "text", "label")), "sweep")
    known = F.col("predicted_label").isin(*LABELS)
    rows = runs.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(~known).cast("int").alias("n_unknown"))
    gradients = F.create_map(*[F.lit(x) for name, g in zip(names, found.gradients(), strict=True) for x in (name, abs(round(g, 2)))])
    f1 = evaluate.metrics_record(runs).select("model", F.when(F.col("model") == "lr_prior", F.col("f1_weighted")).alias("prior_f1"))
    return rows.join(f1, "model").withColumn("gradient", gradients[F.col("model")])


def run_rounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep's settings trained in rounds with evaluation on val after each.

    Round 0 (the classes' shares in train) with its numbers; whether the best
    step is the maximum of the history; whether the restored best model scores
    val as the history says; whether the loss on train fell in every round."""
    s = split_table(spark, sf_dir)
    train, val = _part(s, "train"), _part(s, "val")
    settings = [Setting(name, **params) for name, params in SWEEP]
    done = run_rounds(train, val, settings, scratch_path(spark, "rounds"), rounds=5, steps_per_round=4)
    history = store(done.history(spark), "history")
    start = history.where("step = 0").select("run", F.round("eval_accuracy", 6).alias("accuracy_0"), F.round("eval_loss", 6).alias("loss_0"),
                                             F.round("eval_f1_weighted", 6).alias("f1_0"))
    best = compare.best_step(history)
    highest = history.groupBy("run").agg(
        F.max("eval_f1_weighted").alias("highest"),
        (F.max_by("loss", "step") <= F.min("loss") + 1e-12).alias("loss_fell"))
    models = done.best(spark)
    weights = [next(st for st in m.stages if hasattr(st, "coefficientMatrix")) for m in models.values()]
    restored = score_grid(done.tfidf, list(models), [_weights_of(lr) for lr in weights], val.select("row_id", "text", "label"))
    again = evaluate.metrics_record(restored).select(F.col("model").alias("run"), F.col("f1_weighted").alias("again"))
    return (start.join(best, "run").join(highest, "run").join(again, "run")
            .select("run", "accuracy_0", "loss_0", "f1_0", (F.col("best_metric") == F.col("highest")).alias("best_is_highest"),
                    (F.col("best_metric") == F.col("again")).alias("best_restored"), "loss_fell"))


def _weights_of(lr) -> np.ndarray:
    """A classifier's coefficients with its intercepts as the last column."""
    return np.column_stack([lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()])


def experiment_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the four results of two complete runs, written and read
    back: dirty rows -> clean -> split -> fit on train, or on train and val -> test."""
    s = _clean_split(spark, sf_dir)
    out = None
    for name, train in (("baseline", _part(s, "train")), ("tuned", split.train_val_union(s))):
        path = scratch_path(spark, "results")
        write_results(run_experiment(name, train, _part(s, "test"), **PRIOR), path)
        found = _values({r: spark.read.parquet(f"{path}/{r}") for r in RESULTS})
        out = found if out is None else out.unionByName(found)
    return out


def _values(results: dict[str, DataFrame]) -> DataFrame:
    """Every value of the four results: ``model, result, key1, key2, value``."""
    def cells(name: str, key: str, columns: tuple[str, ...]) -> DataFrame:
        df = results[name]
        entries = F.array(*[F.struct(F.lit(c).alias("key2"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in columns])
        return df.select("model", F.lit(name).alias("result"), F.col(key).cast("string").alias("key1"), F.inline(entries))

    confusion = results["confusion"].select("model", F.lit("confusion").alias("result"), F.col("label").alias("key1"),
                                            F.col("predicted_label").alias("key2"), F.col("n").cast("double").alias("value"))
    predictions = results["predictions"].select(
        "model", F.lit("predictions").alias("result"), F.col("row_id").cast("string").alias("key1"),
        F.col("predicted_label").alias("key2"), F.lit(1.0).alias("value"))
    metrics = cells("metrics", "model", ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted"))
    report = cells("report", "row_name", ("precision", "recall", "f1_score", "support"))
    return metrics.unionByName(report).unionByName(confusion).unionByName(predictions)


def experiment_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: fit on train + val with its own parameters, all results on test."""
    s = split_table(spark, sf_dir)
    return _written(spark, run_experiment("tfidf_lr_tuned", split.train_val_union(s), _part(s, "test"), **TUNED))


def sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the metrics of all parameter settings by one model-keyed job."""
    s = split_table(spark, sf_dir)
    return evaluate.metrics_record(sweep(_part(s, "train"), _part(s, "val").select("row_id", "text", "label"), SWEEP))


def score_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table scored as a stream (availableNow) into parquet, against the batch."""
    model = fit_classifier(_part(split_table(spark, sf_dir), "train"))
    path = f"{sf_dir}/documents.parquet"
    source, path_glob = table_source(spark, path)
    out = score_stream(
        spark, model, source, spark.read.parquet(path).schema, path_glob=path_glob,
        sink=scratch_path(spark, "stream-sink"), checkpoint=scratch_path(spark, "stream-ckpt"),
    )
    columns = ("predicted_label", "status")
    return _difference(out.select(F.col("doc_id").alias("row_id"), *columns),
                       score_texts(model, _documents(spark, sf_dir)).select("row_id", *columns))


def evaluate_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Val and test evaluated as a stream of several files, and as a batch, by the same model."""
    s = split_table(spark, sf_dir)
    fit, found = fit_grid(_part(s, "train"), [("prior", {"max_iter": 0})])  # where every fit starts: the classes' shares
    model = assemble(fit, as_model(found.weights()[0]))
    rows = _part(s, "val", "test").select("row_id", "text", "label")
    source, sink = scratch_path(spark, "labelled-stream"), scratch_path(spark, "stream-counts")
    rows.repartitionByRange(4, "row_id").write.parquet(source)
    counts = count_stream(spark, model, source, rows.schema, sink, scratch_path(spark, "stream-ckpt"), max_files_per_trigger=1,
                          spread_over=spark.sparkContext.defaultParallelism)
    batch = predict(model, rows, ["label"]).withColumn("model", F.lit("batch"))
    return stream_metrics(counts, "stream").unionByName(evaluate.metrics_record(batch))


MODEL_QUERIES = {
    "evaluate_stream": evaluate_stream_query,
    "lr_fit_predict": lr_fit_predict,
    "score_batch": score_batch,
    "save_load": save_load,
    "experiment_sweep": experiment_sweep,
    "sweep_metrics": sweep_metrics,
    "run_rounds": run_rounds_query,
    "experiment_outputs": experiment_outputs,
    "experiment_tuned": experiment_tuned,
    "baseline_report": baseline_report,
    "baseline_end_to_end": baseline_end_to_end,
    "score_stream": score_stream_query,
}
