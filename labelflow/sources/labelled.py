"""Labelled-text sources.

CSV is read with every field as a string (no inference) and the header
checked by name before any cast: a positional ``.schema()`` on a headered
CSV would silently shift columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import REQUIRED_LENIENT
from ..functions.text import na_to_null
from ..operators.ids import running_total
from .records import listed_place


def check_required(df: DataFrame, required: Iterable[str], source: str = "input") -> DataFrame:
    """Raise ``ValueError`` naming the missing columns (a driver-side check, no job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{source} is missing columns: {missing}")
    return df


def read_labelled_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    required: Iterable[str] = REQUIRED_LENIENT,
    multi_line: bool = False,
    quarantine: bool = False,
) -> DataFrame:
    """Read labelled CSV: UTF-8, header, RFC-4180 quotes, NA tokens -> null.

    ``paths`` is an explicit list so a missing file raises (no glob that
    silently matches nothing). ``multi_line`` allows line breaks inside quoted
    fields; such files cannot be split, so each is one task. A line with more
    or fewer fields than the header raises when it is read; with
    ``quarantine`` it is kept as a row whose ``corrupt_record`` holds the line.
    """
    paths = list(paths) if not isinstance(paths, str) else paths
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("enforceSchema", False)
    )
    names = reader.option("inferSchema", False).csv(paths).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    if quarantine:
        schema = schema.add("corrupt_record", T.StringType())
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_record")
    else:
        reader = reader.option("mode", "FAILFAST")
    df = reader.schema(schema).csv(paths)
    check_required(df, required, source=str(paths))
    return df.select(*[na_to_null(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def freeze_row_ids(df: DataFrame, path: str, id_col: str = "row_id") -> DataFrame:
    """Give every row a stable ``row_id`` and freeze it by writing parquet.

    ``monotonically_increasing_id`` follows input order within a file split;
    writing it once means later recomputation cannot renumber rows.
    """
    df.withColumn(id_col, F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def file_order_ids(df: DataFrame, paths: Sequence[str], path: str, id_col: str = "row_id") -> DataFrame:
    """Number the rows of a file scan as they stand in the files: gapless from 0, files
    in the order of ``paths`` (a folder's by name), frozen by writing parquet.

    ``df`` must be a scan of those paths, with projections at most: a filter
    would leave gaps. A file's pieces may be read by any tasks; the numbers of a
    piece's first row come from the sizes of the pieces before it in the file,
    and of the files before it. No row is sorted or shuffled."""
    place = F.col("_metadata")
    df.select("*", place["file_path"].alias("_file"), place["file_block_start"].alias("_start"),
              F.monotonically_increasing_id().alias("_at")).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    pieces = rows.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_within", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = pieces.groupBy("_file").agg(F.sum("n").alias("n")).withColumn("_listed", listed_place(F.col("_file"), paths)["i"])
    starts = running_total(files, ["_listed", "_file"], out="_before").select("_file", "_before")
    number = F.col("_before") + F.col("_within") + F.col("_at") - F.col("_first")
    return (rows.join(pieces.join(starts, "_file").drop("n"), ["_file", "_start"])
            .select(*[c for c in df.columns if c != id_col], number.cast("long").alias(id_col)))


def read_labelled_parquet(spark: SparkSession, path: str,
                          required: Iterable[str] = REQUIRED_LENIENT) -> DataFrame:
    df = spark.read.parquet(path)
    check_required(df, required, source=path)
    return df


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Read one part of a split table written with ``partitionBy("split")``.

    The equality filter on the partition column becomes a PartitionFilter:
    files of the other parts are never listed or opened.
    """
    return spark.read.parquet(path).where(F.col("split") == F.lit(split))
