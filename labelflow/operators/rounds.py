"""Training in rounds (M10): evaluate after each round, keep a history, restore the best.

A round is a number of optimiser steps that go on from where the last round
stopped. After each the settings are evaluated on the validation rows, all in
one pass over stored feature blocks; round 0 is the model without features.
What is written below the run folder:

* ``history/``: a JSON record per run and round with its log so far and the best
  step by then, read by ``sources.read_run_history``;
* ``weights/``: every round's coefficients, one row per (run, step, class).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABELS
from ..sinks import write_run_state
from ..sources.records import read_run_history
from . import stacked
from .compare import best_step
from .evaluate import record_of_counts
from .features import TfidfFit, fit_tfidf
from .model import assemble, labelled_rows, training_features

PAIRS = "run string, step long, label string, predicted_label string, n long"
WEIGHTS = "run string, step long, class int, weights array<double>"
ENTRY = ("struct<epoch: double, step: long, loss: double, eval_loss: double, eval_accuracy: double, "
         "eval_precision_weighted: double, eval_recall_weighted: double, eval_f1_weighted: double>")
STATE = f"run string, global_step long, best_metric double, best_global_step long, log_history array<{ENTRY}>"


@dataclass
class Rounds:
    """A finished training: the shared TF-IDF fit, and where its history and weights are."""

    tfidf: TfidfFit
    labels: Sequence[str]
    path: str
    passes: int

    def history(self, spark: SparkSession) -> DataFrame:
        """One row per run and evaluated step (``read_run_history``)."""
        return read_run_history(spark, [f"{self.path}/history"], pretty=False)

    def best(self, spark: SparkSession) -> dict[str, PipelineModel]:
        """Each run's model of its best round: highest weighted F1 on the validation rows, the earliest of equals."""
        steps = best_step(self.history(spark)).select("run", F.col("best_step").alias("step"))
        rows = spark.read.parquet(f"{self.path}/weights").join(steps, ["run", "step"]).collect()
        found: dict[str, dict[int, list[float]]] = {}
        for r in rows:
            found.setdefault(r["run"], {})[r["class"]] = r["weights"]
        return {run: assemble(self.tfidf, stacked.as_model(np.array([w[k] for k in sorted(w)])), self.labels)
                for run, w in found.items()}


def _metrics(spark: SparkSession, names: Sequence[str], step_of: Sequence[int], pairs: np.ndarray, labels: Sequence[str]) -> dict:
    """A11 of each run from its pair counts (as many rows as runs x classes x classes)."""
    rows = [(name, step, labels[i], labels[j], int(n)) for name, step, table in zip(names, step_of, pairs, strict=True)
            for i, line in enumerate(table) for j, n in enumerate(line) if n]
    record = record_of_counts(spark.createDataFrame(rows, PAIRS), None, keys=("run", "step"))
    return {r["run"]: r for r in record.collect()}


def run_rounds(train: DataFrame, val: DataFrame, settings: Sequence[stacked.Setting], path: str, rounds: int = 7,
               steps_per_round: int = 10, patience: int | None = None, labels: Sequence[str] = LABELS,
               tfidf: TfidfFit | None = None) -> Rounds:
    """Train all settings together for ``rounds`` rounds, evaluating on ``val`` after each.

    Rows without a known label count on neither side; a side without any
    raises. A setting stops when its optimiser has converged, or, with
    ``patience``, when so many rounds in a row were no better than its best; its
    history then ends. Metrics are those of ``metrics_record``, rounded to four
    places, so equal rounds are equal."""
    spark = train.sparkSession
    fit = tfidf or fit_tfidf(labelled_rows(train))
    blocks = stacked.feature_blocks(training_features(train, fit, rows_per_partition=stacked.PASS_ROWS), len(fit.vocabulary), len(labels))
    held_out = stacked.feature_blocks(training_features(val, fit, rows_per_partition=stacked.PASS_ROWS), len(fit.vocabulary), len(labels))
    if not held_out.n_rows:
        raise ValueError("no labelled rows to evaluate on")
    training = stacked.StackedFit(blocks, settings)
    training.evaluate_start()
    logs: dict[str, list[tuple]] = {s.name: [] for s in settings}
    best: dict[str, tuple[float, int]] = {}
    waited = dict.fromkeys(logs, 0)
    going = list(range(len(settings)))
    for number in range(rounds + 1):
        if number:
            training.advance(steps_per_round)
        weights = training.weights()[going]
        losses, pairs = stacked.evaluate_stacked(held_out, weights)
        names = [settings[i].name for i in going]
        steps = [training.runs[i].iteration for i in going]
        metrics = _metrics(spark, names, steps, pairs, labels)
        states = []
        for i, name, step, loss in zip(going, names, steps, losses, strict=True):
            m = metrics[name]
            logs[name].append((float(number), step, float(training.runs[i].value), float(loss), m["accuracy"],
                               m["precision_weighted"], m["recall_weighted"], m["f1_weighted"]))
            better = name not in best or m["f1_weighted"] > best[name][0]
            waited[name] = 0 if better else waited[name] + 1
            if better:
                best[name] = (m["f1_weighted"], step)
            states.append((name, step, *best[name], logs[name]))
        write_run_state(spark.createDataFrame(states, STATE), f"{path}/history")
        rows = [(name, step, k, w.tolist()) for name, step, ws in zip(names, steps, weights, strict=True) for k, w in enumerate(ws)]
        spark.createDataFrame(rows, WEIGHTS).write.mode("append").parquet(f"{path}/weights")
        for i, name in zip(list(going), names, strict=True):
            if patience is not None and waited[name] >= patience:
                training.runs[i].done = True
        going = [i for i in going if not training.runs[i].done]
        if not going:
            break
    blocks.release()
    held_out.release()
    return Rounds(fit, labels, path, training.passes)
