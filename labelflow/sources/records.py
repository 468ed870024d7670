"""Record sources (S5-S8, S10): keyed CSV, metric JSON files, run history."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision_weighted", T.DoubleType()),
        T.StructField("recall_weighted", T.DoubleType()),
        T.StructField("f1_weighted", T.DoubleType()),
    ]
)


def read_table_csv(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Prediction / summary CSV; a leading byte-order mark is dropped by Spark.

    ``multi_line`` allows line breaks inside quotes, but then each file is one task."""
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(list(paths) if not isinstance(paths, str) else paths)
    )


def read_keyed_csv(spark: SparkSession, path: str, key: str = "row_name") -> DataFrame:
    """Matrix / report CSV whose first, unnamed column is the row key."""
    df = read_table_csv(spark, path)
    first = df.columns[0]
    return df.withColumnRenamed(first, key)


def read_metrics(spark: SparkSession, paths: Sequence[str], order: Sequence[str] | None = None,
                 pretty: bool = True) -> DataFrame:
    """Gather metric JSON files, or folders that ``write_metrics_json`` made, into one table.

    Adds ``source_file`` (provenance) and ``ordinal`` (position in the given
    list, the tie-break of best-model choice); a record belongs to the listed
    path that its file is or lies under, the longest such path. A missing file
    or a malformed record raises. ``pretty`` reads one record per file, else
    one per line.
    """
    paths = list(paths)
    df = (
        spark.read.schema(METRICS_SCHEMA)
        .option("multiLine", pretty)
        .option("mode", "FAILFAST")
        .json(paths)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    return df.withColumn("ordinal", listed_place(F.col("source_file"), order or paths)["i"].cast("int"))


def listed_place(file: Column, paths: Sequence[str]) -> Column:
    """``i``, the position (from 1) of the listed path that a file is or lies under: the longest such path."""
    plain = F.regexp_replace(file, "^[a-z0-9]+:/*(?=/)", "")
    places = [F.when(_under(plain, p), F.struct(F.lit(len(_plain(p))).alias("n"), F.lit(i + 1).alias("i")))
              for i, p in enumerate(paths)]
    # greatest over one path needs two arguments
    return F.greatest(*places, *places[:1]) if places else F.lit(None).cast("struct<n:int,i:int>")


def _plain(path: str) -> str:
    """A path without its scheme and without a slash at the end."""
    return re.sub("^[a-z0-9]+:/*(?=/)", "", path).rstrip("/")


def _under(path: Column, listed: str) -> Column:
    """Whether a file is the listed path or lies below it; a relative path matches the end of the folder."""
    name = _plain(listed)
    if not name.startswith("/"):
        name = "/" + name
        return path.endswith(name) | path.contains(name + "/")
    return (path == name) | path.startswith(name + "/")


#: What a run's log says of an evaluated step, beside the step itself.
EVALUATED = ("epoch", "loss", "eval_loss", "eval_accuracy", "eval_precision_weighted", "eval_recall_weighted", "eval_f1_weighted")
HISTORY_SCHEMA = ("run string, best_metric double, best_global_step bigint, log_history array<struct<step: bigint, "
                  + ", ".join(f"{c}: double" for c in EVALUATED) + ">>")


def read_run_history(spark: SparkSession, paths: Sequence[str], pretty: bool = True) -> DataFrame:
    """Nested run-history JSON -> one row per run and evaluated step.

    Columns: run, epoch, step, the evaluated metrics, best_metric,
    best_global_step. The run is the record's own ``run`` field or, without
    one, the folder above the checkpoint's folder. Checkpoints of one run
    repeat its earlier steps; each step is kept once, with the latest
    checkpoint's best. ``pretty`` reads one record per file, else one per line
    (such files are split among tasks). A malformed file raises.
    """
    raw = (
        spark.read.schema(HISTORY_SCHEMA)
        .option("multiLine", pretty)
        .option("mode", "FAILFAST")
        .json(list(paths))
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    run = F.coalesce("run", F.element_at(F.split(F.col("_file"), "/"), -3))
    steps = raw.select(run.alias("run"), "best_metric", "best_global_step", F.explode("log_history").alias("h"))
    latest = F.max_by(F.struct(*[f"h.{c}" for c in EVALUATED], "best_metric", "best_global_step"),
                      F.struct("best_global_step", "best_metric"))
    return (steps.where(F.col("h.eval_f1_weighted").isNotNull()).groupBy("run", F.col("h.step").alias("step"))
            .agg(latest.alias("l"))
            .select("run", "l.epoch", "step", *[f"l.{c}" for c in EVALUATED[1:]], "l.best_metric", "l.best_global_step"))
