"""Model comparison.

Inputs are ``model``-keyed tables (metrics, reports, predictions); the
models' position in a given list (``ordinal``) is the tie-break, as file
order is in the reference.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASS_TABLE_HEADERS, DIGITS, LABELS, SUMMARY_HEADERS
from .evaluate import is_correct


def with_ordinal(df: DataFrame, order: Sequence[str], col: str = "model") -> DataFrame:
    """1-based position of ``col`` in ``order`` (null when absent)."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return df.withColumn("ordinal", F.when(place > 0, place).cast("int"))


def results_summary(metrics: DataFrame, order: Sequence[str],
                    headers: Mapping[str, str] = SUMMARY_HEADERS) -> DataFrame:
    """A12 + P11: metrics of the listed models, in list order, presentation headers."""
    df = with_ordinal(metrics, order).where(F.col("ordinal").isNotNull())
    return df.select("ordinal", *[F.col(k).alias(v) for k, v in headers.items()]).orderBy("ordinal")


def run_title(name: Column, **parameters: Column) -> Column:
    """a run's name for people, with the parameters that tell it from others: ``name (key value, key value)``."""
    shown = F.concat_ws(", ", *[F.concat_ws(" ", F.lit(k), v.cast("string")) for k, v in parameters.items()])
    return F.format_string("%s (%s)", name, shown)


def result_file(name: Column, result: str, kind: str = "csv") -> Column:
    """the file name of one of a run's results."""
    return F.format_string(f"%s_{result}.{kind}", name)


def best_model(metrics: DataFrame, order: Sequence[str] | None = None, digits: int | None = DIGITS,
               metric: str = "f1_weighted") -> DataFrame:
    """The model with the highest (rounded) metric; the first listed wins a
    tie; null and NaN metrics and models that are not listed (null ordinal) are
    skipped. One global aggregate (``max_by``), no sort."""
    if "ordinal" in metrics.columns:
        df = metrics
    elif order:
        df = with_ordinal(metrics, order)
    else:
        raise ValueError("best_model needs an 'ordinal' column or an 'order' list (the tie-break)")
    m = F.col(metric)
    score = F.round(m, digits) if digits is not None else m
    valid = df.where(m.isNotNull() & ~F.isnan(m) & F.col("ordinal").isNotNull())
    best = valid.agg(
        F.max_by(F.struct(F.col("model"), F.col("ordinal"), m.alias(metric)),
                 F.struct(score, -F.col("ordinal"))).alias("b")
    )
    return best.where(F.col("b").isNotNull()).select("b.*")


def best_model_rows(df: DataFrame, best: DataFrame, key: str = "model") -> DataFrame:
    """Rows of the best model (Spark picks the join by the measured sizes)."""
    return df.join(best.select(key), key, "left_semi")


def class_rows(report: DataFrame, labels: Sequence[str] = LABELS,
               cols: Sequence[str] = ("precision", "recall", "f1_score"), keys: Sequence[str] = ("model",)) -> DataFrame:
    """The class rows of a report, in label order, chosen columns."""
    order = F.array(*[F.lit(x) for x in labels])
    return (
        report.where(F.col("row_name").isin(*labels))
        .select(*keys, "row_name", (F.array_position(order, F.col("row_name")) - 1).cast("int").alias("row_idx"),
                *cols)
        .orderBy(*keys, "row_idx")
    )


def best_model_class_table(report: DataFrame, best: DataFrame, labels: Sequence[str] = LABELS,
                           headers: Mapping[str, str] = CLASS_TABLE_HEADERS) -> DataFrame:
    """Per-class precision / recall / F1 of the best model, presentation headers."""
    rows = class_rows(best_model_rows(report, best), labels)
    return rows.select("row_idx", *[F.col(k).alias(v) for k, v in headers.items()]).orderBy("row_idx")


def head_n(df: DataFrame, n: int = 5, order_col: str = "row_id") -> DataFrame:
    """O1: first ``n`` rows in input order (distributed top-k, TakeOrderedAndProject)."""
    return df.orderBy(order_col).limit(n)


def verification_sample(pred: DataFrame, n: int = 5, order_col: str = "row_id",
                        label_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """V1: first ``n`` right, then first ``n`` wrong predictions, tagged.

    One pass: the rank limit is applied in every partition before the
    shuffle, so a task gets at most ``n`` rows of each kind from each."""
    flagged = is_correct(pred, label_col, pred_col)
    place = F.row_number().over(Window.partitionBy("is_correct").orderBy(order_col))
    tag = F.when(F.col("is_correct"), F.lit("correct")).otherwise(F.lit("incorrect"))
    return flagged.withColumn("_place", place).where(F.col("_place") <= n).drop("_place").withColumn("example_type", tag)


def frame_model_metric(metrics: DataFrame, metrics_cols: Sequence[str] = ("accuracy", "f1_weighted")) -> DataFrame:
    """Chart frame model x metric -> value."""
    return metrics.unpivot(["model"], list(metrics_cols), "metric", "value")


def frame_config_f1(metrics: DataFrame, configs: Sequence[tuple[str, str]], metric: str = "f1_weighted") -> DataFrame:
    """Metric by configuration label, in the given order.
    ``configs`` is a list of (configuration label, model name)."""
    cfg = F.create_map(*[x for c, m in configs for x in (F.lit(m), F.lit(c))])
    order = F.array(*[F.lit(m) for _, m in configs])
    return metrics.where(F.col("model").isin(*[m for _, m in configs])).select(
        cfg[F.col("model")].alias("config"),
        F.array_position(order, F.col("model")).cast("int").alias("ordinal"),
        F.col(metric),
    )


def frame_confusion_cells(conf: DataFrame, best: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The best model's confusion cells with their row / column index."""
    order = F.array(*[F.lit(x) for x in labels])
    return best_model_rows(conf, best).select(
        (F.array_position(order, F.col("label")) - 1).cast("int").alias("row_idx"),
        (F.array_position(order, F.col("predicted_label")) - 1).cast("int").alias("col_idx"),
        "label", "predicted_label", "n",
    )


def best_step(history: DataFrame, run_col: str = "run", metric: str = "eval_f1_weighted") -> DataFrame:
    """Per run, the step with the highest eval metric; the earliest wins a tie."""
    return history.where(F.col(metric).isNotNull()).groupBy(run_col).agg(
        F.max_by(F.col("step"), F.struct(F.col(metric), -F.col("step"))).alias("best_step"),
        F.max(metric).alias("best_metric"),
    )
