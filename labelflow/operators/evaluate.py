"""Evaluation of predictions.

Everything is derived from ONE aggregate: counts per (keys, label,
predicted_label). That pass over the predictions uses partial aggregation
(map-side combine), so a hot class or model costs nothing extra; all later
metrics run on a table of (#models x K x K) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DIGITS, LABELS, REPORT_ACCURACY, REPORT_MACRO, REPORT_WEIGHTED
from ..functions.numeric import safe_div
from ..session import materialize

KEYS = ("model",)


def is_correct(df: DataFrame, label_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """String equality of truth and prediction (null counts as wrong)."""
    return df.withColumn("is_correct", F.coalesce(F.col(label_col) == F.col(pred_col), F.lit(False)))


def errors_only(df: DataFrame) -> DataFrame:
    """The wrong predictions."""
    return is_correct(df).where(~F.col("is_correct"))


def join_truth_prediction(truth: DataFrame, predictions: DataFrame, keys: Sequence[str] = KEYS,
                          id_col: str = "row_id", validate: bool = True) -> DataFrame:
    """Attach an external prediction table to the truth by ``row_id``.

    Every model must have predicted every truth row exactly once, and truth
    ids must be unique; anything else raises. One aggregate over the ids of
    both sides finds all such rows (text is not shuffled for it)."""
    keys = list(keys)
    if validate:
        models = predictions.select(*keys).distinct().count()
        key = F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])
        nothing = F.lit(None).cast(predictions.select(key.alias("k")).schema["k"].dataType)
        seen = truth.select(id_col, F.lit(1).alias("t"), nothing.alias("k")).unionByName(
            predictions.select(id_col, F.lit(0).alias("t"), key.alias("k")))
        rows = seen.groupBy(id_col).agg(
            F.sum("t").alias("truths"), F.count("k").alias("predictions"),
            F.size(F.collect_set("k")).alias("models"))
        bad = rows.where((F.col("truths") != 1) | (F.col("predictions") != F.col("models"))
                         | (F.col("models") != max(models, 1))).limit(1).collect()
        if bad:
            r = bad[0].asDict()
            what = ("duplicate truth ids" if r["truths"] > 1 else "prediction ids without truth rows" if not r["truths"]
                    else "duplicate prediction ids" if r["predictions"] > r["models"] else "truth rows without prediction")
            raise ValueError(f"{what}, e.g. {r}")
    return truth.join(predictions, id_col, "inner")


def pair_counts(pred: DataFrame, keys: Sequence[str] = KEYS, label_col: str = "label",
                pred_col: str = "predicted_label", materialized: bool = True) -> DataFrame:
    """Rows per (keys, label, predicted_label): the one pass over predictions.

    The result has at most (#keys x K x K) rows. It is checkpointed where
    several results read it (the confusion grid and its counts, a run's four
    results), so that the predictions are scored once.
    """
    counts = pred.groupBy(*keys, label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts) if materialized else counts


def label_pairs(counts: DataFrame, labels: Sequence[str] | None, keys: Sequence[str] = KEYS,
                label_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """The confusion grid: every pair of the listed labels for every key; without
    a list, of the labels that the key's rows show on either side."""
    keys = list(keys)
    if labels is None:
        both = F.array(F.col(label_col), F.col(pred_col))
        each = counts.select(*keys, F.explode(both).alias("c")).where("c is not null").groupBy(*keys).agg(
            F.collect_set("c").alias("_labels"))
    else:
        each = counts.select(*keys).distinct().withColumn("_labels", F.array(*[F.lit(x) for x in labels]))
    rows = each.select(*keys, "_labels", F.explode("_labels").alias(label_col))
    return rows.select(*keys, label_col, F.explode("_labels").alias(pred_col))


def confusion_from_counts(counts: DataFrame, labels: Sequence[str] | None, keys: Sequence[str] = KEYS,
                          label_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """Dense K x K cells per key; zero cells kept, pairs outside ``labels`` ignored."""
    keys = list(keys)
    grid = label_pairs(counts, labels, keys, label_col, pred_col)
    return grid.join(counts, keys + [label_col, pred_col], "left").select(
        *keys, label_col, pred_col, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )


def confusion_long(pred: DataFrame, labels: Sequence[str] | None = LABELS, keys: Sequence[str] = KEYS,
                   label_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """A4: long confusion matrix ``(keys, label, predicted_label, n)``."""
    counts = pair_counts(pred, keys, label_col, pred_col)
    return confusion_from_counts(counts, labels, keys, label_col, pred_col)


def confusion_wide(conf: DataFrame, labels: Sequence[str] = LABELS, keys: Sequence[str] = KEYS,
                   label_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """A5: rows true label, one column per predicted label (values listed: no extra job)."""
    keys = list(keys)
    return (
        conf.groupBy(*keys, label_col)
        .pivot(pred_col, list(labels))
        .agg(F.sum("n"))
        .select(*keys, label_col, *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in labels])
    )


def summed_classes(counts: DataFrame, labels: Sequence[str] | None = LABELS, keys: Sequence[str] = KEYS,
                   label_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """One row per key: ``classes`` (array of class metrics in label order) and ``accuracy``.

    Each counted pair adds to its true class (support) and to its predicted
    class, whatever stands on the other side, so a prediction whose truth is
    not listed still lowers precision. Without a list the classes are those
    the key's rows show, in sorted order. Zero denominators give 0.
    """
    keys = list(keys)
    n, zero = F.col("n").cast("long"), F.lit(0).cast("long")
    right = F.when(F.col(label_col) == F.col(pred_col), n).otherwise(zero)

    def side(is_class: bool, c, support, predicted, tp):
        return F.struct(F.lit(is_class).alias("is_class"), c.alias("c"), support.alias("support"),
                        predicted.alias("predicted"), tp.alias("tp"))

    sides = F.array(side(True, F.col(label_col), n, zero, right), side(True, F.col(pred_col), zero, n, zero),
                    side(False, F.lit(None).cast("string"), n, zero, right))
    sums = counts.select(*keys, F.inline(sides)).where("c is not null or not is_class")
    if labels is not None:
        sums = sums.where(~F.col("is_class") | F.col("c").isin(*labels))
    sums = sums.groupBy(*keys, "is_class", "c").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])
    entry = F.struct("c", F.struct("support", "predicted", "tp").alias("v"))
    each = sums.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("is_class"), entry))).alias("m"),
        F.max(F.when(~F.col("is_class"), F.struct("support", "tp"))).alias("total"))
    listed = F.array(*[F.lit(x) for x in labels]) if labels is not None else F.array_sort(F.map_keys("m"))

    def of_class(c, i):
        v = F.col("m")[c]
        support, predicted, tp = (F.coalesce(v[x], zero) for x in ("support", "predicted", "tp"))
        return F.struct(c.alias("label"), i.cast("int").alias("class_idx"),
                        safe_div(tp, predicted).alias("precision"), safe_div(tp, support).alias("recall"),
                        safe_div(2 * tp, predicted + support).alias("f1_score"),
                        support.cast("double").alias("support"))

    return each.select(*keys, F.transform(listed, of_class).alias("classes"),
                       safe_div(F.col("total.tp"), F.col("total.support")).alias("accuracy"))


def _total(field: str, weight: str | None = None):
    """Sum over the classes of a field, or of field times weight."""
    value = (lambda x: x[field] * x[weight]) if weight else (lambda x: x[field])
    return F.aggregate("classes", F.lit(0.0), lambda acc, x: acc + value(x))


def _weighted(field: str):
    return safe_div(_total(field, "support"), _total("support"))


def _macro(field: str):
    return safe_div(_total(field), F.size("classes"))


SCORES = ("precision", "recall", "f1_score")


def accuracy(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Right / all over every prediction (also labels outside the list)."""
    return summed_classes(pair_counts(pred, keys, materialized=False), None, keys).select(*keys, "accuracy")


def class_metrics(pred: DataFrame, labels: Sequence[str] | None = LABELS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-class precision, recall, F1, support."""
    rows = summed_classes(pair_counts(pred, keys, materialized=False), labels, keys)
    return rows.select(*keys, F.inline("classes"))


def weighted_metrics(pred: DataFrame, labels: Sequence[str] | None = LABELS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Support-weighted means of the class metrics (F1 is the mean of class F1s)."""
    rows = summed_classes(pair_counts(pred, keys, materialized=False), labels, keys)
    return rows.select(*keys, _weighted("precision").alias("precision_weighted"),
                       _weighted("recall").alias("recall_weighted"), _weighted("f1_score").alias("f1_weighted"))


def macro_metrics(pred: DataFrame, labels: Sequence[str] | None = LABELS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unweighted class means; support is the total."""
    rows = summed_classes(pair_counts(pred, keys, materialized=False), labels, keys)
    return rows.select(*keys, _macro("precision").alias("precision_macro"), _macro("recall").alias("recall_macro"),
                       _macro("f1_score").alias("f1_macro"), _total("support").alias("support"))


def report_of_counts(counts: DataFrame, labels: Sequence[str] | None = LABELS,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """A10 from pair counts: the report's rows are one array per key."""
    def row(name, idx, precision, recall, f1, support):
        return F.struct(name.alias("row_name"), idx.cast("int").alias("row_idx"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1_score"), support.alias("support"))

    k = F.size("classes")
    rows = F.concat(
        F.transform("classes", lambda x: row(x["label"], x["class_idx"], *[x[c] for c in SCORES], x["support"])),
        F.array(row(F.lit(REPORT_ACCURACY), k, *[F.col("accuracy")] * 4),
                row(F.lit(REPORT_MACRO), k + 1, *[_macro(c) for c in SCORES], _total("support")),
                row(F.lit(REPORT_WEIGHTED), k + 2, *[_weighted(c) for c in SCORES], _total("support"))))
    return summed_classes(counts, labels, keys).select(*keys, F.inline(rows))


def classification_report(pred: DataFrame, labels: Sequence[str] | None = LABELS,
                          keys: Sequence[str] = KEYS) -> DataFrame:
    """A10: class rows, ``accuracy`` (the scalar in all four columns),
    ``macro avg`` and ``weighted avg``; ``row_idx`` keeps the report order."""
    return report_of_counts(pair_counts(pred, keys, materialized=False), labels, keys)


def record_of_counts(counts: DataFrame, labels: Sequence[str] | None = None, keys: Sequence[str] = KEYS,
                     digits: int | None = DIGITS) -> DataFrame:
    """A11 from pair counts."""
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return summed_classes(counts, labels, keys).select(
        *keys, rounded(F.col("accuracy")).alias("accuracy"),
        *[rounded(_weighted(c)).alias(name) for c, name in
          zip(SCORES, ("precision_weighted", "recall_weighted", "f1_weighted"), strict=True)])


def metrics_record(pred: DataFrame, labels: Sequence[str] | None = None, keys: Sequence[str] = KEYS,
                   digits: int | None = DIGITS) -> DataFrame:
    """Accuracy + weighted precision, recall, F1 per key, rounded.
    Weights are over the observed labels unless a list is given."""
    return record_of_counts(pair_counts(pred, keys, materialized=False), labels, keys, digits)
