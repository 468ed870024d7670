"""Running evaluation of a labelled stream.

Labelled files are scored as they arrive, and the rows by (label, predicted
label) are counted by a stateful aggregation: the state is one counter per
pair, whatever the stream's length. Each micro-batch writes the counters that
it changed into a folder named by its number, replacing what an earlier
attempt of the same batch left there, so a restarted batch counts nothing
twice. The latest value of each counter gives the confusion counts, from which
all metrics follow as in ``evaluate``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import DIGITS, LABELS
from ..operators.evaluate import record_of_counts, report_of_counts
from ..operators.scoring import score_texts

PAIR = ("label", "predicted_label")
COUNTS_SCHEMA = "label string, predicted_label string, n bigint, batch bigint"


def write_batch(counts: DataFrame, batch: int, sink: str) -> None:
    """The changed counters of one micro-batch; running it again replaces its folder."""
    counts.write.mode("overwrite").parquet(f"{sink}/batch={batch}")


def count_stream(spark: SparkSession, model: PipelineModel, source: str, schema: StructType, sink: str, checkpoint: str,
                 labels: Sequence[str] | None = None, text_col: str = "text", label_col: str = "label",
                 max_files_per_trigger: int | None = None, path_glob: str | None = None, spread_over: int | None = None) -> DataFrame:
    """Score what has arrived in ``source`` and bring the counters in ``sink`` up to date.

    Runs until nothing new is left (``availableNow``) and goes on from the
    checkpoint when called again. Returns the latest counters. Rows without a
    label, or whose text is blank, are not counted. With ``spread_over`` the rows
    of a micro-batch are dealt to so many tasks before they are scored: a batch of
    few files is read by few tasks, a file of one row group by one. The class names
    are the fitted model's unless given, as in ``score_texts``."""
    reader = spark.readStream.schema(schema)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source)
    if spread_over:
        rows = rows.repartition(spread_over)
    scored = score_texts(model, rows, labels, text_col=text_col)
    scored = scored.where(F.col(label_col).isNotNull() & F.col("predicted_label").isNotNull())
    counts = scored.groupBy(F.col(label_col).alias("label"), "predicted_label").agg(F.count("*").alias("n"))
    query = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda changed, batch: write_batch(changed, batch, sink))
        .start()
    )
    query.awaitTermination()
    return stream_counts(spark, sink)


def stream_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The latest value of each counter: ``label, predicted_label, n``."""
    changes = spark.read.schema(COUNTS_SCHEMA).parquet(sink)
    return changes.groupBy(*PAIR).agg(F.max_by("n", "batch").alias("n"))


def stream_metrics(counts: DataFrame, name: str, labels: Sequence[str] | None = None, digits: int | None = DIGITS) -> DataFrame:
    """A11 of the stream so far, as ``metrics_record`` of the same rows."""
    return record_of_counts(counts.withColumn("model", F.lit(name)), labels, digits=digits)


def stream_report(counts: DataFrame, name: str, labels: Sequence[str] | None = LABELS) -> DataFrame:
    """A10 of the stream so far."""
    return report_of_counts(counts.withColumn("model", F.lit(name)), labels)
