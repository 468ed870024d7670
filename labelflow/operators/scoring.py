"""Scoring (F2-F4, O5, M7, X3): label + probabilities, batch or stream.

Scoring is a per-row projection over the fitted pipeline: every input
column travels with its prediction, nothing is zipped by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.arrays import argmax, prob_map, softmax
from ..functions.text import is_blank, strip


def score_logits(df: DataFrame, logits_col: str, labels: Sequence[str] = LABELS,
                 digits: int | None = None) -> DataFrame:
    """F3 + O5 + J2 + F4 on an ``array<double>`` of logits."""
    probs = softmax(F.col(logits_col))
    out = df.withColumn("probs", probs)
    idx = argmax(F.col("probs"))
    return out.withColumn("class_id", idx).withColumn(
        "predicted_label", F.get(F.array(*[F.lit(x) for x in labels]), idx)
    ).withColumn("probabilities", prob_map(labels, F.col("probs"), digits))


def model_labels(model: PipelineModel) -> list[str]:
    """The class names a fitted pipeline has probabilities for, in their order."""
    names = next(st.getLabels() for st in reversed(model.stages) if hasattr(st, "getLabels"))
    classes = next((st.numClasses for st in reversed(model.stages) if hasattr(st, "numClasses")), len(names))
    return list(names)[:classes]


def score_texts(model: PipelineModel, df: DataFrame, labels: Sequence[str] | None = None,
                text_col: str = "text", digits: int | None = None, blank_guard: bool = True) -> DataFrame:
    """M7: score a text table with a fitted/loaded pipeline.

    Adds ``predicted_label``, ``probabilities`` (label -> probability map,
    optionally rounded) and ``status``; every input column travels unchanged
    (the model reads a stripped copy of the text). With ``blank_guard`` a null
    / blank text gets a null label, an empty map and status ``empty_input``
    (F2). The class names are the fitted model's unless given."""
    from pyspark.ml.functions import vector_to_array

    keep = list(df.columns)
    held = df.select(F.struct(*[df[c] for c in keep]).alias("_row"),
                     F.coalesce(strip(df[text_col].cast("string")), F.lit("")).alias(text_col))
    scored = model.transform(held)
    pmap = prob_map(labels or model_labels(model), vector_to_array("probability"), digits)
    blank = is_blank(F.col(text_col)) if blank_guard else F.lit(False)
    empty = F.create_map().cast("map<string,double>")
    return scored.select(
        *[F.col("_row").getField(c).alias(c) for c in keep],
        F.when(blank, F.lit(None).cast("string")).otherwise(F.col("predicted_label")).alias("predicted_label"),
        F.when(blank, empty).otherwise(pmap).alias("probabilities"),
        F.when(blank, F.lit("empty_input")).otherwise(F.lit("ok")).alias("status"),
    )


def blank_guard(df: DataFrame, label_expr, text_col: str = "text") -> DataFrame:
    """F2 on any labelling expression: blank text -> null label, status."""
    blank = is_blank(F.col(text_col))
    return df.withColumn("predicted_label", F.when(blank, F.lit(None).cast("string")).otherwise(label_expr)) \
        .withColumn("status", F.when(blank, F.lit("empty_input")).otherwise(F.lit("ok")))


def linear_logits(vector_col: str, weights: Sequence[Sequence[float]]):
    """One logit per class: the dot product of its weights with the whole vector
    (a vector shorter or longer than the weights counts as far as both go)."""
    def dot(row):
        w = F.array(*[F.lit(float(x)) for x in row])
        products = F.zip_with(F.col(vector_col), w, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0)))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    return F.array(*[dot(row) for row in weights])


def linear_score(df: DataFrame, vector_col: str, weights: Sequence[Sequence[float]], labels: Sequence[str] = LABELS,
                 digits: int | None = None) -> DataFrame:
    """M7 on vectors: class, probabilities and ``margin`` (best logit less the second best)."""
    scored = score_logits(df.withColumn("logits", linear_logits(vector_col, weights)), "logits", labels, digits)
    ordered = F.sort_array("logits", asc=False)
    return scored.withColumn("margin", F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def map_batches(df: DataFrame, make_fn, schema) -> DataFrame:
    """Run a caller's own batch function (or model) over Arrow batches.

    ``make_fn()`` is called once per task -- load a model there -- and the
    function it returns maps a pandas DataFrame to a pandas DataFrame of
    ``schema``. Spark partitions the work; for built-in logic prefer column
    expressions (this is the slow path, kept for callers' own code).
    """

    def run(batches):
        fn = make_fn()
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
