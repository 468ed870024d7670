"""Goldens G1-G5: predictions rebuilt from the reference's confusion counts."""

import math

import pytest
from pyspark.sql import functions as F

from labelflow.constants import LABELS
from labelflow.operators import compare, evaluate

# rows true, columns predicted, order negative / neutral / positive
CONFUSION = {
    "baseline": [[2, 1, 3], [1, 5, 0], [3, 2, 1]],
    "3ep": [[0, 0, 6], [0, 0, 6], [0, 0, 6]],
    "6ep": [[0, 6, 0], [0, 6, 0], [0, 6, 0]],
    "tuned": [[4, 0, 2], [4, 1, 1], [4, 0, 2]],
}
# accuracy / precision / recall / F1 (weighted, 4 places)
METRICS = {
    "baseline": (0.4444, 0.4028, 0.4444, 0.4159),
    "3ep": (0.3333, 0.1111, 0.3333, 0.1667),
    "6ep": (0.3333, 0.1111, 0.3333, 0.1667),
    "tuned": (0.3889, 0.5778, 0.3889, 0.3646),
}
ORDER = ["baseline", "3ep", "6ep", "tuned"]


@pytest.fixture(scope="module")
def preds(spark):
    rows, rid = [], 0
    for model, m in CONFUSION.items():
        for i, t in enumerate(LABELS):
            for j, p in enumerate(LABELS):
                for _ in range(m[i][j]):
                    rid += 1
                    rows.append((rid, model, t, p))
    return spark.createDataFrame(rows, "row_id long, model string, label string, predicted_label string")


def test_confusion_g1(spark, preds):
    conf = evaluate.confusion_long(preds).collect()
    got = {}
    for r in conf:
        got.setdefault(r.model, [[0] * 3 for _ in range(3)])[LABELS.index(r.label)][
            LABELS.index(r.predicted_label)] = r.n
    assert got == CONFUSION
    wide = {(r.model, r.label): [r.negative, r.neutral, r.positive]
            for r in evaluate.confusion_wide(evaluate.confusion_long(preds)).collect()}
    assert wide[("baseline", "neutral")] == [1, 5, 0]


def test_report_g2(spark, preds):
    rep = {(r.model, r.row_name): r for r in evaluate.classification_report(preds).collect()}
    b = rep[("baseline", "neutral")]
    assert (b.precision, b.recall, b.f1_score, b.support) == (0.625, 5 / 6, 10 / 14, 6.0)
    assert rep[("baseline", "positive")].recall == 1 / 6
    acc = rep[("baseline", "accuracy")]
    assert acc.precision == acc.recall == acc.f1_score == acc.support == 8 / 18
    assert rep[("baseline", "macro avg")].support == 18.0
    # zero division gives 0
    z = rep[("3ep", "negative")]
    assert (z.precision, z.recall, z.f1_score) == (0.0, 0.0, 0.0)
    assert rep[("3ep", "positive")].f1_score == 0.5
    assert sorted(r.row_idx for k, r in rep.items() if k[0] == "tuned") == [0, 1, 2, 3, 4, 5]


def test_metrics_g3(spark, preds):
    got = {r.model: (r.accuracy, r.precision_weighted, r.recall_weighted, r.f1_weighted)
           for r in evaluate.metrics_record(preds).collect()}
    assert got == METRICS


def test_summary_and_best_g4_g5(spark, preds):
    met = evaluate.metrics_record(preds)
    summ = compare.results_summary(met, ORDER).collect()
    assert [r["Модель"] for r in summ] == ORDER
    assert [r["F1-score"] for r in summ] == [METRICS[m][3] for m in ORDER]
    best = compare.best_model(met, ORDER).first()
    assert best.model == "baseline"
    table = compare.best_model_class_table(evaluate.classification_report(preds), compare.best_model(met, ORDER))
    rows = table.collect()
    assert [r["Класс"] for r in rows] == list(LABELS)
    assert [round(r["F1-score"], 4) for r in rows] == [0.3333, 0.7143, 0.2]


def test_best_model_ties_and_nan(spark):
    met = spark.createDataFrame(
        [("a", 0.5), ("b", 0.7), ("c", 0.7), ("d", float("nan")), ("e", None)], "model string, f1_weighted double")
    assert compare.best_model(met, ["a", "b", "c", "d", "e"]).first().model == "b"
    assert compare.best_model(met, ["c", "b", "a", "d", "e"]).first().model == "c"


def test_properties(spark, preds):
    # weighted recall equals accuracy when every label is listed
    for r in evaluate.metrics_record(preds, digits=None).collect():
        assert math.isclose(r.recall_weighted, r.accuracy, rel_tol=1e-12)
    # the confusion total equals the number of rows with known labels
    assert evaluate.confusion_long(preds).agg(F.sum("n")).first()[0] == preds.count()


def test_labels_none_and_outside_pairs(spark):
    df = spark.createDataFrame(
        [(1, "m", "x", "x"), (2, "m", "x", "y"), (3, "m", "y", "z"), (4, "m", "y", None)],
        "row_id long, model string, label string, predicted_label string")
    conf = evaluate.confusion_long(df, labels=None)
    assert sorted({r.label for r in conf.collect()}) == ["x", "y", "z"]
    only_xy = evaluate.confusion_long(df, labels=["x", "y"]).agg(F.sum("n")).first()[0]
    assert only_xy == 2  # pairs outside the list ignored
    acc = evaluate.accuracy(df).first().accuracy
    assert acc == 0.25  # accuracy counts every row


def test_verification_sample_order(spark):
    flags = [False, True, False, True, False, False, False, True, True, True, True, True, True, False]
    df = spark.createDataFrame(
        [(i + 1, "a", "a" if ok else "b") for i, ok in enumerate(flags)],
        "row_id long, label string, predicted_label string")
    out = compare.verification_sample(df).collect()
    right = [r.row_id for r in out if r.example_type == "correct"]
    wrong = [r.row_id for r in out if r.example_type == "incorrect"]
    assert sorted(right) == [2, 4, 8, 9, 10] and sorted(wrong) == [1, 3, 5, 6, 7]


def test_join_truth_prediction_checks(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, label string")
    ok = spark.createDataFrame([(1, "m", "a"), (2, "m", "a")], "row_id long, model string, predicted_label string")
    assert evaluate.join_truth_prediction(truth, ok).count() == 2
    dup = ok.union(spark.createDataFrame([(1, "m", "b")], ok.schema))
    with pytest.raises(ValueError, match="duplicate"):
        evaluate.join_truth_prediction(truth, dup)
    orphan = ok.union(spark.createDataFrame([(9, "m", "b")], ok.schema))
    with pytest.raises(ValueError, match="without truth"):
        evaluate.join_truth_prediction(truth, orphan)


def test_unlisted_models_never_win(spark):
    met = spark.createDataFrame([("x", 0.9), ("a", 0.5), ("b", 0.5)], "model string, f1_weighted double")
    assert compare.best_model(met, ["a", "b"]).first().model == "a"
    assert [r.ordinal for r in compare.with_ordinal(met, ["a", "b"]).orderBy("model").collect()] == [1, 2, None]


def test_truth_outside_the_list_lowers_precision(spark):
    rows = [(1, "m", "positive", "positive"), (2, "m", "unknown", "positive")]
    df = spark.createDataFrame(rows, "row_id long, model string, label string, predicted_label string")
    got = {r.label: r for r in evaluate.class_metrics(df).collect()}
    assert got["positive"].precision == 0.5 and got["negative"].support == 0.0
    assert evaluate.metrics_record(df).first().recall_weighted == 0.5  # over the observed labels
    assert evaluate.metrics_record(df, LABELS).first().recall_weighted == 1.0


def test_join_raises_on_any_unmatched_or_repeated_row(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, label string")

    def joined(rows, t=truth):
        preds = spark.createDataFrame(rows, "row_id long, model string, predicted_label string")
        return evaluate.join_truth_prediction(t, preds).count()

    good = [(1, "m", "a"), (2, "m", "a"), (1, "n", "a"), (2, "n", "a")]
    assert joined(good) == 4
    for rows, message in ((good[:3], "without prediction"), (good[:1], "without prediction"), ([], "without prediction"),
                          (good + good[:1], "duplicate prediction"), (good + [(3, "m", "a")], "without truth")):
        with pytest.raises(ValueError, match=message):
            joined(rows)
    with pytest.raises(ValueError, match="duplicate truth"):
        joined(good, truth.unionByName(truth.limit(1)))
