"""Writers (K1-K4, K6): tables, keyed matrices/reports, metric records."""

from __future__ import annotations

from pyspark.sql import DataFrame


BYTE_ORDER_MARK = "\ufeff"


def write_table_csv(df: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """K1 / K3: CSV with header, no row key; Spark creates the folder (K6).

    With ``byte_order_mark`` each file starts with one (before the first
    column's name, quoted nowhere), as spreadsheet programs expect; Spark's
    reader drops it."""
    if byte_order_mark:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_keyed_csv(df: DataFrame, path: str, order_col: str | None = "row_idx") -> None:
    """K2: a keyed matrix/report as an ordered CSV, in one file if it is small.

    The sort leaves the file layout to Spark: a report of K rows fits one
    partition; a larger table is written in ordered part files."""
    out = df.orderBy(order_col).drop(order_col) if order_col and order_col in df.columns else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_split_table(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Split table partitioned by part, so reading one part prunes the rest."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """K4: metric records as JSON lines (``read_metrics(..., pretty=False)``)."""
    df.write.mode("overwrite").json(path)


def write_run_state(df: DataFrame, path: str) -> None:
    """Run-history records as JSON lines, added to those there (``read_run_history(..., pretty=False)``)."""
    df.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
