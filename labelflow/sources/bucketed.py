"""Bucketed copies of the id-keyed tables, for shuffle-free joins at scale.

``documents ⋈ labels`` is the base of every run. When the labels side is
too large to broadcast, a sort-merge join would shuffle all the text on
every run. Writing both tables once with the same ``bucketBy(n, id)`` and
``sortBy(id)`` lets Spark join them bucket by bucket: no exchange and no
sort in later plans (the catalog keeps the bucket spec; on a cluster the
warehouse folder is shared storage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Save ``df`` as a table bucketed and sorted by ``key``."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
