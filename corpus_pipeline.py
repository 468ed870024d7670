"""A training corpus from raw documents in five stages.

Quality rules reject documents, SimHash near-dedup keeps one of each group,
substring dedup cuts repeated passages, private values get pseudonyms, and what
is left is packed into sequences. Each stage takes ``(spark, docs, sf_dir)`` and
returns a DataFrame; it is written as Parquet below ``spark.checkpoint.dir`` and
read again as the next stage's ``docs``. All stages but the last return the
columns of ``docs`` and no others, whatever these are called; ``n_chars``, if it
is there, follows the text. Each handles what its operator's docstring says:
null and empty texts, repeated rows, empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import packing, pii, quality, simhash, substring
from labelflow.llm.common import read_table, stored

#: Key of the pseudonyms; a user sets their own.
PSEUDONYM_KEY = pii.DEMO_KEY


def _as_row(docs: DataFrame, *needed: str) -> DataFrame:
    """The whole row in one column, beside the columns that a stage works on."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[docs[c] for c in needed])


def _with_text(rows: DataFrame, names: list[str], text: Column) -> DataFrame:
    """The rows' columns with another text."""
    new = {"text": text}
    if "n_chars" in names:
        changed = ~text.eqNullSafe(F.col("_row.text"))
        new["n_chars"] = F.when(changed, F.length(text).cast(rows.schema["_row"].dataType["n_chars"].dataType)) \
            .otherwise(F.col("_row.n_chars"))
    return rows.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a limit or are outliers of their language and source go."""
    rated = quality.rate(_as_row(docs, "text", "lang", "source"), keep_columns=["_row"])
    return rated.where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of the smallest id stays (a
    null id is the largest; of rows that repeat an id and its text, one)."""
    first, second = F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id")
    rows = _as_row(docs, "doc_id", "text").withColumns({"_h1": first, "_h2": second})
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_h1", "_h2")
    groups = simhash.near_duplicates(rows.select(named.alias("_id"), "text"), shingle_words=3, max_bits=2, key="_id")
    keep = groups.select("component._h1", "component._h2").distinct()
    return rows.join(keep, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"]).select("_row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words that occur elsewhere are cut; a document may end up empty."""
    cut = substring.remove_repeats(_as_row(docs, "doc_id", "text"), width=35)
    return _with_text(cut, docs.columns, F.col("text"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values are replaced by pseudonyms of the same format."""
    return _with_text(pii.pseudonymise(_as_row(docs, "text"), PSEUDONYM_KEY), docs.columns, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096."""
    return packing.op5_query(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", private_data),
    ("packing", pack),
]

#: Concentration steps, shingle hashes and tokens are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
