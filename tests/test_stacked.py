"""Stacked fits and training in rounds."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelflow.operators import compare, evaluate, rounds, stacked
from labelflow.operators.model import fit_logistic, load_model, predict, save_model
from labelflow.operators.stacked import Setting
from labelflow.plans.experiments import split_table
from tests.conftest import SF001


def data(spark, n=300, d=12, partitions=5, dense=False):
    pick = np.random.default_rng(3)
    rows = []
    for i in range(n):
        at = np.sort(pick.choice(d, 4, replace=False))
        x = pick.normal(size=4)
        y = int(np.argmax([x.sum(), x[0] - x[1], pick.normal()]))
        dots = np.zeros(d)
        dots[at] = x
        rows.append((Vectors.dense(dots) if dense else Vectors.sparse(d, at.tolist(), x.tolist()), float(y)))
    rows.append((Vectors.sparse(d, [], []), 1.0))
    return spark.createDataFrame(rows, ["features", "_y"]).repartition(partitions)


SETTINGS = [Setting("a", tol=1e-8), Setting("b", inverse_reg=0.05, tol=1e-8), Setting("c", inverse_reg=30.0, max_iter=4)]


def test_stacked_equals_fits_of_their_own(spark):
    blocks = stacked.feature_blocks(data(spark), 12, 3)
    assert (blocks.n_rows, sum(blocks.class_counts)) == (301, 301)
    together = stacked.fit_stacked(blocks, SETTINGS)
    alone = [stacked.fit_stacked(blocks, [s]) for s in SETTINGS]
    assert together.passes == max(f.passes for f in alone) < sum(f.passes for f in alone)
    for i, f in enumerate(alone):
        np.testing.assert_allclose(together.weights()[i], f.weights()[0], atol=1e-9)
    assert [r.iteration for r in together.runs][2] == 4
    assert max(together.gradients()[:2]) <= 1e-8


def test_converged_fit_equals_the_library(spark):
    feats = data(spark)
    blocks = stacked.feature_blocks(feats, 12, 3)
    found = stacked.fit_stacked(blocks, SETTINGS[:2]).weights()
    for s, w in zip(SETTINGS[:2], found, strict=True):
        want = fit_logistic(feats, 301, 1000, s.inverse_reg, 1e-12)
        np.testing.assert_allclose(w[:, :-1], want.coefficientMatrix.toArray(), atol=1e-4)
        np.testing.assert_allclose(w[:, -1], want.interceptVector.toArray(), atol=1e-4)
        ours = stacked.as_model(w).transform(feats).select(vector_to_array("probability")).collect()
        theirs = want.transform(feats).select(vector_to_array("probability")).collect()
        np.testing.assert_allclose(sorted(r[0] for r in ours), sorted(r[0] for r in theirs), atol=1e-4)


def test_gradient_by_differences(spark):
    blocks = stacked.feature_blocks(data(spark, 60), 12, 3)
    pick = np.random.default_rng(1)
    w = pick.normal(size=(1, 3, 13))
    sums = stacked.one_pass(blocks, w, stacked._loss_and_gradient)[0]
    for _ in range(8):
        at = tuple(int(pick.integers(n)) for n in w.shape)
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        change = stacked.one_pass(blocks, np.concatenate([up, down]), stacked._loss_and_gradient)[:, 0]
        slope = (change[0] - change[1]) / 2e-5
        assert math.isclose(sums[1:].reshape(3, 13)[at[1:]], slope, rel_tol=1e-5, abs_tol=1e-5)


def test_many_partitions_and_dense_vectors_give_the_same_sums(spark, monkeypatch):
    few = stacked.feature_blocks(data(spark), 12, 3)
    many = stacked.feature_blocks(data(spark, partitions=23, dense=True), 12, 3)
    monkeypatch.setattr(stacked, "FAN_IN", 4)  # sums are added on executors first
    w = np.random.default_rng(2).normal(size=(2, 3, 13))
    for what in (stacked._loss_and_gradient, stacked._loss_and_pairs):
        np.testing.assert_allclose(stacked.one_pass(few, w, what), stacked.one_pass(many, w, what), rtol=1e-9, atol=1e-9)


def test_bad_input_raises(spark):
    feats = data(spark, 20)
    with pytest.raises(Exception, match="labels must be numbers from 0 to 1"):
        stacked.feature_blocks(feats, 12, 2)
    with pytest.raises(ValueError, match="different names"):
        stacked.StackedFit(stacked.feature_blocks(feats, 12, 3), [Setting("a"), Setting("a")])
    with pytest.raises(ValueError, match="no labelled rows"):
        stacked.StackedFit(stacked.feature_blocks(feats.limit(0), 12, 3), [Setting("a")])


@pytest.fixture(scope="module")
def parts(spark):
    s = split_table(spark, SF001)
    return s.where("split = 'train'"), s.where("split = 'val'")


def test_rounds_write_a_history_and_restore_the_best(spark, parts, tmp_path):
    train, val = parts
    settings = [Setting("weak", inverse_reg=0.01), Setting("strong", inverse_reg=50.0), Setting("short", max_iter=3)]
    done = rounds.run_rounds(train, val, settings, str(tmp_path), rounds=4, steps_per_round=2)
    history = done.history(spark).collect()
    by_run = {s.name: sorted((r.step, r) for r in history if r.run == s.name) for s in settings}
    assert [step for step, _ in by_run["strong"]] == [0, 2, 4, 6, 8]
    assert [step for step, _ in by_run["short"]] == [0, 2, 3]  # stopped by its own limit
    losses = [r.eval_loss for _, r in by_run["strong"]]
    own = [r.loss for _, r in by_run["strong"]]
    assert own == sorted(own, reverse=True) and own[-1] < own[0]
    # round 0 is the classes' shares in train
    n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    labels = [r.label for r in val.collect()]
    assert math.isclose(losses[0], -sum(math.log(n[x] / sum(n.values())) for x in labels) / len(labels), rel_tol=1e-9)
    best = {r.run: (r.best_step, r.best_metric) for r in compare.best_step(done.history(spark)).collect()}
    models = done.best(spark)
    assert set(models) == set(best) == {"weak", "strong", "short"}
    for run, model in models.items():
        assert best[run][1] == max(r.eval_f1_weighted for _, r in by_run[run])
        pred = predict(model, val).withColumn("model", F.lit(run))
        assert evaluate.metrics_record(pred).first()["f1_weighted"] == best[run][1]
    save_model(models["strong"], f"{tmp_path}/saved")
    again = predict(load_model(f"{tmp_path}/saved"), val).select("row_id", "predicted_label")
    assert sorted(again.collect()) == sorted(predict(models["strong"], val).select("row_id", "predicted_label").collect())


def test_rounds_go_on_where_they_stopped(spark, parts, tmp_path):
    train, val = parts
    one = rounds.run_rounds(train, val, [Setting("a")], f"{tmp_path}/one", rounds=1, steps_per_round=6)
    three = rounds.run_rounds(train, val, [Setting("a")], f"{tmp_path}/three", rounds=3, steps_per_round=2, tfidf=one.tfidf)
    assert one.passes == three.passes

    def last(done):
        rows = spark.read.parquet(f"{done.path}/weights").where("step = 6").orderBy("class").collect()
        return np.array([r.weights for r in rows])

    np.testing.assert_allclose(last(one), last(three), atol=1e-12)


def test_patience_ends_a_run(spark, parts, tmp_path):
    train, val = parts
    done = rounds.run_rounds(train, val, [Setting("a", inverse_reg=1e-9)], str(tmp_path), rounds=6, steps_per_round=1, patience=2)
    # almost no weight is allowed: no round beats round 0
    assert sorted(r.step for r in done.history(spark).collect())[-1] <= 2
    assert compare.best_step(done.history(spark)).first()["best_step"] == 0
