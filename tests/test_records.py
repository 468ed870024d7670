"""S7/S8/S10 and A13/A15 on record files written by the tests (numbers invented here)."""

import json

import pytest

from labelflow.operators import compare
from labelflow.sources.records import read_metrics, read_run_history

# model -> accuracy / precision / recall / F1: a maximum, a tie, a missing F1
METRICS = [
    ("alpha", 0.9, 0.8, 0.7, 0.75),
    ("beta", 0.5, 0.25, 0.5, 0.3),
    ("gamma", 0.5, 0.25, 0.5, 0.3),
    ("delta", 0.6, 0.6, 0.6, None),
]


def _write_metrics(tmp_dir):
    paths = []
    for i, (m, a, p, r, f) in enumerate(METRICS):
        path = f"{tmp_dir}/m{i}_metrics.json"
        with open(path, "w", encoding="utf-8") as fh:
            json.dump({"model": m, "accuracy": a, "precision_weighted": p, "recall_weighted": r,
                       "f1_weighted": f}, fh, ensure_ascii=False, indent=4)
        paths.append(path)
    return paths


def test_gather_metrics_and_best(spark, tmp_dir):
    paths = _write_metrics(tmp_dir)
    met = read_metrics(spark, paths)
    rows = met.orderBy("ordinal").collect()
    assert [r.source_file.rsplit("/", 1)[1] for r in rows] == [p.rsplit("/", 1)[1] for p in paths]
    assert [r.model for r in rows] == [m[0] for m in METRICS] and [r.ordinal for r in rows] == [1, 2, 3, 4]
    best = compare.best_model(met).first()
    assert best.model == "alpha" and best.ordinal == 1 and best.f1_weighted == 0.75
    # a tie goes to the earlier file; a missing F1 is skipped
    assert compare.best_model(read_metrics(spark, paths[1:])).first().model == "beta"
    assert compare.best_model(read_metrics(spark, [paths[2], paths[1]])).first().model == "gamma"
    assert compare.best_model(read_metrics(spark, paths[3:])).collect() == []


def test_equal_base_names_and_folders(spark, tmp_dir):
    import os

    from labelflow.sinks import write_metrics_json

    paths = []
    for run, (m, a, p, r, f) in zip(("r2", "r1"), METRICS):
        os.makedirs(f"{tmp_dir}/{run}")
        paths.append(f"{tmp_dir}/{run}/metrics.json")
        with open(paths[-1], "w") as fh:
            json.dump({"model": m, "accuracy": a, "f1_weighted": f}, fh)
    assert {r.model: r.ordinal for r in read_metrics(spark, paths).collect()} == {"alpha": 1, "beta": 2}
    folder = f"{tmp_dir}/out/metrics.json"
    write_metrics_json(read_metrics(spark, paths).drop("ordinal", "source_file"), folder)
    again = read_metrics(spark, [f"{tmp_dir}/r2/metrics.json", folder], pretty=False).collect()
    assert sorted((r.model, r.ordinal) for r in again) == [("alpha", 1), ("alpha", 2), ("beta", 2)]


def test_malformed_metrics_raise(spark, tmp_dir):
    with open(f"{tmp_dir}/bad.json", "w") as fh:
        fh.write('{"model": "a", "accuracy": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_metrics(spark, [f"{tmp_dir}/bad.json"]).collect()


def _history(path, evals, trains=()):
    log = [{"epoch": float(e), "step": s, "loss": 1.1, "learning_rate": 1e-5} for e, s in trains]
    log += [{"epoch": float(e), "step": s, "eval_loss": 1.12, "eval_f1_weighted": f, "eval_runtime": 0.12}
            for e, s, f in evals]
    with open(path, "w") as fh:
        json.dump({"best_global_step": None, "best_metric": None, "log_history": log, "global_step": 15}, fh, indent=2)


def test_run_history_best_step(spark, tmp_dir):
    import os

    for run in ("run_a", "run_b"):
        os.makedirs(f"{tmp_dir}/{run}/checkpoint-1", exist_ok=True)
    a, b = f"{tmp_dir}/run_a/checkpoint-1/state.json", f"{tmp_dir}/run_b/checkpoint-1/state.json"
    _history(a, [(1, 5, 0.25), (2, 10, 0.25), (3, 15, 0.25)], trains=[(1, 5), (2, 10)])
    _history(b, [(1, 5, 0.1), (2, 10, 0.4)])
    hist = read_run_history(spark, [a, b])
    assert hist.count() == 5  # training log lines are not evaluation steps
    best = {r.run: r for r in compare.best_step(hist).collect()}
    assert best["run_a"].best_step == 5 and best["run_a"].best_metric == 0.25  # earliest of a tie
    assert best["run_b"].best_step == 10 and best["run_b"].best_metric == 0.4


def test_missing_metrics_file_raises(spark, tmp_dir):
    paths = _write_metrics(tmp_dir)
    assert read_metrics(spark, paths[:1]).first().model == "alpha"
    with pytest.raises(Exception):
        read_metrics(spark, [paths[0], f"{tmp_dir}/absent.json"]).collect()


def test_checkpoints_of_one_run_repeat_no_step(spark, tmp_dir):
    import os

    paths = []
    for i, evals in enumerate(([(1, 5, 0.3)], [(1, 5, 0.3), (2, 10, 0.5)])):
        os.makedirs(f"{tmp_dir}/run/checkpoint-{i}")
        paths.append(f"{tmp_dir}/run/checkpoint-{i}/state.json")
        _history(paths[-1], evals)
    rows = read_run_history(spark, paths).orderBy("step").collect()
    assert [(r.run, r.step, r.eval_f1_weighted) for r in rows] == [("run", 5, 0.3), ("run", 10, 0.5)]
    _history(paths[0], [])
    assert read_run_history(spark, paths[:1]).collect() == []  # no file has an evaluation
