"""Model fitting, persistence and experiments.

The classifier is a Spark ML ``PipelineModel``: the TF-IDF stages of
``features.tfidf_stages`` + multinomial ``LogisticRegression`` +
``IndexToString``. It saves and loads as one artefact with its label
names, and transforms batches or streams row by row.

Parameter mapping for an L2-penalised multinomial model with inverse
strength C and unpenalised intercept: Spark minimises
``mean(loss) + regParam/2 * ||W||^2``, so ``regParam = 1 / (C * n_train)``;
``standardization=False`` keeps the penalty on the raw features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FIT_ROWS_PER_PARTITION, INVERSE_REG, LABELS, MAX_FEATURES, MAX_ITER, TOL
from ..session import store
from . import evaluate, stacked
from .clean import clean_labelled, label_encode
from .features import TfidfFit, fit_tfidf, tfidf_stages


def training_features(train: DataFrame, fit: TfidfFit, text_col: str = "text", label_id_col: str = "label_id",
                      rows_per_partition: int = FIT_ROWS_PER_PARTITION) -> DataFrame:
    """``(features, _y)`` of the labelled training rows, stored and sized for the optimiser.

    A fit reads its rows several times, so the text is turned into features
    once. Every optimiser iteration is one job over the cached training blocks.
    A training set of few rows (known from the TF-IDF fit) is gathered into
    fewer partitions, so it does not pay per-task overhead hundreds of times;
    a large one keeps its own.
    """
    feats = PipelineModel(tfidf_stages(fit, text_col=text_col)).transform(
        labelled_rows(train, label_id_col).withColumn("_y", F.col(label_id_col).cast("double"))
    ).select("features", "_y")
    feats = store(feats, "training-features")
    target = max(1, math.ceil(fit.n_docs / rows_per_partition))
    cores = train.sparkSession.sparkContext.defaultParallelism
    return feats.coalesce(target) if target < cores else feats


def labelled_rows(train: DataFrame, label_id_col: str = "label_id") -> DataFrame:
    """The rows that a fit counts: those with a known label."""
    return train.where(F.col(label_id_col).isNotNull())


def fit_logistic(feats: DataFrame, n_docs: int, max_iter: int = MAX_ITER, inverse_reg: float = INVERSE_REG,
                 tol: float = TOL):
    """M5 on prepared ``(features, _y)`` rows."""
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="_y",
        family="multinomial",
        regParam=1.0 / (inverse_reg * max(n_docs, 1)),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        maxIter=max_iter,
        tol=tol,
    )
    return lr.fit(feats)


def assemble(fit: TfidfFit, lr_model, labels: Sequence[str] = LABELS, text_col: str = "text") -> PipelineModel:
    """One persistable pipeline: TF-IDF stages + classifier + label names."""
    decode = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=list(labels))
    return PipelineModel(tfidf_stages(fit, text_col=text_col) + [lr_model, decode])


def fit_classifier(
    train: DataFrame,
    labels: Sequence[str] = LABELS,
    text_col: str = "text",
    label_id_col: str = "label_id",
    max_features: int = MAX_FEATURES,
    max_iter: int = MAX_ITER,
    inverse_reg: float = INVERSE_REG,
    tol: float = TOL,
    tfidf: TfidfFit | None = None,
) -> PipelineModel:
    """M3 + M5: fit TF-IDF (unless a fitted ``tfidf`` is given) and the
    classifier on ``train``."""
    fit = tfidf or fit_tfidf(labelled_rows(train, label_id_col), text_col=text_col, max_features=max_features)
    feats = training_features(train, fit, text_col, label_id_col)
    return assemble(fit, fit_logistic(feats, fit.n_docs, max_iter, inverse_reg, tol), labels, text_col)


def largest_gradient(model: PipelineModel, train: DataFrame, label_id_col: str = "label_id",
                     inverse_reg: float = INVERSE_REG) -> DataFrame:
    """``gradient``: the largest entry of the penalised loss's gradient at the fitted
    weights, over the training rows; near zero where the fit has converged.

    One pass: each row's non-zero entries times its class errors, summed per
    (feature, class) map-side; the weights join that table of at most
    features x classes rows."""
    spark = train.sparkSession
    lr = next(st for st in model.stages if hasattr(st, "coefficientMatrix"))
    rows = labelled_rows(train, label_id_col)
    n = rows.count()
    scored = model.transform(rows).select(
        F.unwrap_udt("features").alias("f"), vector_to_array("probability").alias("p"), F.col(label_id_col).alias("y"))
    errors = F.transform("p", lambda p, i: p - F.when(i == F.col("y"), 1.0).otherwise(0.0))
    # feature -1 is the intercept's
    entries = F.concat(F.array(F.struct(F.lit(-1).alias("j"), F.lit(1.0).alias("x"))),
                       F.zip_with(F.col("f.indices"), F.col("f.values"), lambda j, x: F.struct(j.alias("j"), x.alias("x"))))
    sums = (scored.select(errors.alias("e"), F.inline(entries)).select("j", F.posexplode("e").alias("k", "e"), "x")
            .groupBy("j", "k").agg((F.sum(F.col("e") * F.col("x")) / n).alias("g")))
    weights = lr.coefficientMatrix.toArray()
    flat = [(int(j), int(k), float(w)) for k, row in enumerate(weights) for j, w in enumerate(row) if w]
    table = spark.createDataFrame(flat or [(-2, 0, 0.0)], "j int, k int, w double")
    both = sums.join(table, ["j", "k"], "full")
    penalty = F.coalesce("w", F.lit(0.0)) / (inverse_reg * max(n, 1))
    return both.agg(F.max(F.abs(F.coalesce("g", F.lit(0.0)) + penalty)).alias("gradient"))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """M6: the input rows with ``predicted_label`` and ``probabilities`` (array)."""
    keep = list(keep) if keep is not None else list(df.columns)
    out = model.transform(df)
    return out.select(*keep, "predicted_label", vector_to_array("probability").alias("probabilities"))


def save_model(model: PipelineModel, path: str) -> None:
    """K5: persist the whole pipeline (vocabulary, idf, coefficients, labels)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


RESULTS = ("metrics", "report", "confusion", "predictions")


def results_of(pred: DataFrame, labels: Sequence[str] = LABELS) -> dict[str, DataFrame]:
    """The four results of runs in one model-keyed prediction table: rounded
    metrics, report, confusion counts, and the predictions themselves. The
    first three share one pass over the predictions."""
    counts = evaluate.pair_counts(pred)
    return {"metrics": evaluate.record_of_counts(counts, list(labels)),
            "report": evaluate.report_of_counts(counts, labels),
            "confusion": evaluate.confusion_from_counts(counts, labels), "predictions": pred}


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """Each result as a table of its own below ``path``."""
    for name, frame in results.items():
        frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def run_experiment(name: str, train: DataFrame, evaluate_on: DataFrame, clean: bool = True,
                   labels: Sequence[str] = LABELS, **params) -> dict[str, DataFrame]:
    """Clean both parts, fit with ``params`` on ``train``, and return the
    four results on ``evaluate_on`` tagged with ``model = name``."""
    if clean:
        train, evaluate_on = (label_encode(clean_labelled(x, require=("text", "label"), allowed_labels=labels), labels)
                              for x in (train, evaluate_on))
    model = fit_classifier(train, labels, **params)
    keep = [c for c in evaluate_on.columns if c != "text"]
    pred = predict(model, evaluate_on, keep).withColumn("model", F.lit(name))
    return results_of(store(pred, "predictions"), labels)


def sweep(train: DataFrame, evaluate_on: DataFrame, grid: Sequence[tuple[str, dict]],
          labels: Sequence[str] = LABELS) -> DataFrame:
    """M8 over a grid of classifier parameters (``max_iter``, ``inverse_reg``,
    ``tol``). TF-IDF is fitted once and the training features are stored once;
    all settings are fitted in the same passes over them (``stacked``). The
    evaluation text is transformed once: all classifiers score the same feature
    column, and their predictions leave the row as one array. The result is one
    model-keyed table, evaluated by a single job."""
    fit, stacked_fit = fit_grid(train, grid, labels)
    return score_grid(fit, [name for name, _ in grid], stacked_fit.weights(), evaluate_on, labels)


def fit_grid(train: DataFrame, grid: Sequence[tuple[str, dict]], labels: Sequence[str] = LABELS,
             tfidf: TfidfFit | None = None) -> tuple[TfidfFit, stacked.StackedFit]:
    """The shared TF-IDF fit and the stacked fit of all settings."""
    fit = tfidf or fit_tfidf(labelled_rows(train))
    blocks = stacked.feature_blocks(training_features(train, fit, rows_per_partition=stacked.PASS_ROWS), len(fit.vocabulary), len(labels))
    found = stacked.fit_stacked(blocks, [stacked.Setting(name, **params) for name, params in grid])
    blocks.release()
    return fit, found


def score_grid(fit: TfidfFit, names: Sequence[str], weights, evaluate_on: DataFrame,
               labels: Sequence[str] = LABELS) -> DataFrame:
    """The rows once for each classifier: ``model``, ``predicted_label``, ``probabilities``; the text is read once."""
    scored = PipelineModel(tfidf_stages(fit)).transform(evaluate_on)
    decoded = F.array(*[F.lit(x) for x in labels])
    found = []
    for i, (name, w) in enumerate(zip(names, weights, strict=True)):
        lr, own = stacked.as_model(w), f"_{i}"
        lr.setPredictionCol(f"{own}p").setProbabilityCol(f"{own}q").setRawPredictionCol(f"{own}r")
        scored = lr.transform(scored)
        found.append(F.struct(F.lit(name).alias("model"), F.get(decoded, F.col(f"{own}p").cast("int")).alias("predicted_label"),
                              vector_to_array(f"{own}q").alias("probabilities")))
    return scored.select(*evaluate_on.columns, F.inline(F.array(*found)))
