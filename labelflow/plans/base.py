"""Base tables derived from the test data (FIXTURES.md §3).

``labelled``: documents joined to labels; label ``negative`` when toxic,
else ``positive`` when quality, else ``neutral``. ``raw_labelled``: the same
rows with dirty fields injected by a deterministic expression on the id
(padding, capitals, blanks, NA tokens, unknown labels) -- every row is kept.
``rule_predictions``: three rule classifiers, so every evaluation operator
is checkable without a trained model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABELS
from ..session import spread

RULE_MODELS = ("m_len", "m_mod", "m_const")
NBSP = "\u00a0"
IDEOGRAPHIC_SPACE = "\u3000"


TEXT_TABLES = ("documents",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; text tables are spread over all cores when they scan as
    fewer partitions (see ``session.spread``)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def truth_label(toxic, quality):
    return F.when(toxic == 1, F.lit("negative")).when(quality == 1, F.lit("positive")).otherwise(F.lit("neutral"))


def labelled(spark: SparkSession, sf_dir: str, with_n_chars: bool = False) -> DataFrame:
    """LABELLED: ``row_id, text, language, label`` [, ``n_chars``].

    Plain equi-join; AQE turns it into a broadcast join only when the
    measured labels side is under the broadcast threshold, otherwise it
    stays a sort-merge join.
    """
    docs = table(spark, sf_dir, "documents")
    labs = table(spark, sf_dir, "labels")
    cols = [
        F.col("doc_id").alias("row_id"),
        F.col("text"),
        F.col("lang").alias("language"),
        truth_label(F.col("toxic"), F.col("quality")).alias("label"),
    ]
    if with_n_chars:
        cols.append(F.col("n_chars"))
    return docs.join(labs, "doc_id").select(*cols)


def labelled_from_tables(spark: SparkSession, documents: str, labels: str) -> DataFrame:
    """LABELLED from two tables bucketed alike (``sources.bucketed``): a bucket-wise join."""
    d, lab = spark.table(documents), spark.table(labels)
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("text"), F.col("lang").alias("language"),
        truth_label(F.col("toxic"), F.col("quality")).alias("label"))


def dirty_text(row_id, text):
    k = row_id % 13
    return (
        F.when(k == 1, F.lit(None).cast("string"))
        .when(k == 2, F.lit("NA"))
        .when(k == 3, F.lit(""))
        .when(k == 4, F.lit(" \t "))
        .when(k == 5, F.concat(F.lit(NBSP), text, F.lit(" " + IDEOGRAPHIC_SPACE)))
        .when(k == 6, F.lit("null"))
        .when(k == 7, F.concat(F.lit("  "), text, F.lit("\n")))
        .otherwise(text)
    )


def dirty_label(row_id, label):
    k = row_id % 11
    return (
        F.when(k == 1, F.concat(F.lit("  "), F.upper(label), F.lit(" ")))
        .when(k == 2, F.lit("Unknown"))
        .when(k == 3, F.lit(None).cast("string"))
        .when(k == 4, F.lit("N/A"))
        .when(k == 5, F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 100), F.lit(NBSP)))
        .otherwise(label)
    )


def raw_labelled(spark: SparkSession, sf_dir: str, with_n_chars: bool = False) -> DataFrame:
    """Raw fields as a CSV reader would deliver them (before NA tokens)."""
    lab = labelled(spark, sf_dir, with_n_chars=with_n_chars)
    return lab.select(
        "row_id",
        "language",
        dirty_text(F.col("row_id"), F.col("text")).alias("text"),
        dirty_label(F.col("row_id"), F.col("label")).alias("label"),
        *(["n_chars"] if with_n_chars else []),
    )


#: Every so many rows' truth is a label outside the list, as the lenient loader keeps them.
UNKNOWN_EVERY = 17
CANDIDATES = ("m_mod", "m_len")


def with_unknown_truth(df: DataFrame) -> DataFrame:
    unknown = F.col("row_id") % UNKNOWN_EVERY == 0
    return df.withColumn("label", F.when(unknown, F.lit("unknown")).otherwise(F.col("label")))


#: One weight per class and vector component: small, of both signs, different for each class.
def linear_weights(dims: int = 64, classes: int = len(LABELS)) -> list[list[float]]:
    return [[((7 * i + 13 * k) % 17 - 8) / 8 for i in range(dims)] for k in range(classes)]


def rule_label(model: str):
    if model == "m_len":
        return (
            F.when(F.col("n_chars") < 800, F.lit("negative"))
            .when(F.col("n_chars") < 2000, F.lit("neutral"))
            .otherwise(F.lit("positive"))
        )
    if model == "m_mod":
        return F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("row_id") % 3).cast("int"))
    if model == "m_const":
        return F.lit("positive")
    raise KeyError(model)


def rule_predictions(df: DataFrame, models=RULE_MODELS) -> DataFrame:
    """Every rule model scored as a projection of ONE scan: each row is
    expanded (``inline``) into one row per model, all columns travel along."""
    keep = [c for c in df.columns if c != "n_chars"]
    scored = F.array(*[F.struct(F.lit(m).alias("model"), rule_label(m).alias("predicted_label")) for m in models])
    return df.select(*keep, F.inline(scored))
