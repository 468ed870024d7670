"""Small helpers shared by the pipeline operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..session import ship_package as ship  # noqa: F401 (operators import it from here)

#: The characters that separate words: space and \\x09-\\x0D.
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage with files every executor can read, so a lost executor costs
    a re-read and not a recomputation; column pruning works on the result."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 length of a text; a null text has none."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def blocks_for(total_bytes: int | None, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` hold ``total_bytes``."""
    return max(1, math.ceil((total_bytes or 0) / block_bytes))


def block_of(key: Column, n_blocks: int, seed: int = 17) -> Column:
    """A block number by a hash of the key: even, and the same on every rerun."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n_blocks)).cast("int")
