"""Stream scoring.

The interactive "read a text, print its label" loop becomes a stateless
streaming query: new parquet files in a folder -> strip -> fitted pipeline
-> parquet sink. No state store is needed (each text is scored alone), the
checkpoint gives exactly-once output, and ``availableNow`` processes what is
there and stops, so a stream run equals the batch run on the same files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.scoring import score_texts


def table_source(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """``(source, path_glob)`` of a stream that reads the table at ``path`` and nothing else.

    A folder of part files is a source as it stands, partitioned by columns or
    not. One file is the only name taken from its folder. Neither is made a
    pattern: Spark reads no partition columns below a pattern, and Hadoop
    matches none whose path holds a colon."""
    sc = spark.sparkContext
    file = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(sc._jsc.hadoopConfiguration()).isFile(file):
        return path, None
    return file.getParent().toString(), file.getName()


def score_stream(
    spark: SparkSession,
    model: PipelineModel,
    source: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    labels: Sequence[str] | None = None,
    text_col: str = "text",
    max_files_per_trigger: int | None = None,
    path_glob: str | None = None,
) -> DataFrame:
    """Score every file under the folder ``source`` (optionally only names
    matching ``path_glob``; for one table of a folder see ``table_source``) into
    ``sink``; return the sink table. The class names are the fitted model's unless
    given, as in ``score_texts``."""
    reader = spark.readStream.schema(schema)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    scored = score_texts(model, stream, labels, text_col=text_col)
    query = (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()
    return spark.read.parquet(sink)
