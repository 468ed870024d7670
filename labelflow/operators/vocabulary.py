"""Vocabularies that are too large for the driver, or for one shuffle of all terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_FEATURES
from ..session import ship_package, store
from .features import idf_table, term_counts, term_totals
from .ids import dense_ids

#: Distinct terms that a task counts before it hands them on as a summary of their own.
SUMMARY_TERMS = 1 << 20
#: Keys over which the entries of one term are dealt in the look-up.
SALTS = 16


# ---------------------------------------------------------------- exact top terms by threshold
def local_summaries(counts: DataFrame, k: int, summary_terms: int = SUMMARY_TERMS) -> DataFrame:
    """``(part, term, tf, df, top)``: exact counts within parts of the input, without a
    shuffle; ``top`` marks a part's ``k`` most frequent terms (and those equal to the last).

    A task makes a part of at most about ``summary_terms`` terms and then begins the next."""
    ship_package(counts.sparkSession)

    def summary(part: str, table: pa.Table) -> pa.RecordBatch:
        tf = table.column("tf_sum").to_numpy()
        least = np.partition(tf, len(tf) - k)[len(tf) - k] if len(tf) > k else 0
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(tf)), *[table.column(c).combine_chunks() for c in ("term", "tf_sum", "df_sum")], pa.array(tf >= least)],
            names=["part", "term", "tf", "df", "top"])

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        waiting: list[pa.Table] = []
        rows = 0
        for batch in batches:
            table = pa.Table.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(np.ones(batch.num_rows, np.int64))],
                                         names=["term", "tf", "df"])
            waiting.append(table)
            rows += batch.num_rows
            if rows >= summary_terms:
                found = merged(waiting)
                if found.num_rows >= summary_terms // 2:
                    yield summary(f"{task}-{number}", found)
                    number, waiting, rows = number + 1, [], 0
                else:
                    waiting, rows = [found.rename_columns(["term", "tf", "df"])], found.num_rows
        if waiting:
            yield summary(f"{task}-{number}", merged(waiting))

    return counts.select("term", "tf").mapInArrow(run, "part string, term string, tf bigint, df bigint, top boolean")


def _kth(sums: DataFrame, k: int, column: str) -> int:
    """The ``k``-th largest value, 0 if there are fewer."""
    last = sums.select(column).orderBy(F.desc(column)).limit(k).agg(F.count("*").alias("n"), F.min(column).alias("v")).first()
    return int(last["v"]) if last["n"] == k else 0


def top_terms(counts: DataFrame, k: int = MAX_FEATURES, summary_terms: int = SUMMARY_TERMS) -> DataFrame:
    """O4 as ``features.vocabulary_topk``, with few terms shuffled: ``(term, tf_total, df, rank)``.

    Three rounds over stored local counts. (1) The parts' own top terms, summed:
    the ``k``-th largest sum is a bound that the answer's totals reach. (2) A
    total of at least that has somewhere at least its share, the bound by the
    number of parts: only counts from that share on are summed; a term's unseen
    counts are each below the share, which bounds its total from above. (3)
    Terms whose bound reaches the ``k``-th sum are counted exactly."""
    local = store(local_summaries(counts, k, summary_terms), "local-counts")
    parts = local.select("part").distinct().count()
    bound = _kth(local.where("top").groupBy("term").agg(F.sum("tf").alias("n")), k, "n")
    share = -(-bound // max(parts, 1))
    sums = store(local.where(F.col("tf") >= share).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("seen")), "candidates")
    reached = _kth(sums, k, "n")
    unseen = (F.lit(parts) - F.col("seen")) * max(share - 1, 0)
    survivors = sums.where(F.col("n") + unseen >= reached).select("term")
    exact = local.join(survivors, "term", "left_semi").groupBy("term").agg(
        F.sum("tf").alias("tf_total"), F.sum("df").alias("df"))
    top = exact.orderBy(F.desc("tf_total"), F.asc("term")).limit(k)
    # The window below sees at most k rows (after the top-k), never the corpus.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tf_total"), F.asc("term"))))


# ---------------------------------------------------------------- a vocabulary as a table
@dataclass
class VocabularyTable:
    """A fitted vocabulary as a stored table: ``term, id`` (dense, by term), ``df, idf``."""

    terms: DataFrame
    n_docs: int
    size: int


def fit_vocabulary(df: DataFrame, max_features: int = MAX_FEATURES, id_col: str = "row_id",
                   text_col: str = "text") -> VocabularyTable:
    """M3 for any ``max_features``: nothing but two numbers reaches the driver.

    The terms are ranked and numbered by range sorts; the ``max_features`` most
    frequent stay (ties: term order)."""
    n_docs = df.count()
    totals = store(term_totals(df, text_col), "term-totals")
    ranked = dense_ids(totals, [F.desc("tf_total"), F.asc("term")], out="rank").where(F.col("rank") < max_features)
    kept = store(idf_table(ranked.select("term", "df"), n_docs), "kept-terms")
    terms = store(dense_ids(kept, [F.asc("term")]), "vocabulary")
    return VocabularyTable(terms, n_docs, terms.count())


def _looked_up(df: DataFrame, vocabulary: VocabularyTable, id_col: str, text_col: str) -> DataFrame:
    """``(id, term, i, w)``: each text's known terms with number and raw weight.

    Terms are looked up by a join under ``SALTS`` keys, so a term of every text
    is no task's alone. The join is asked for by name: the size that Spark goes by
    is the stored table's, packed and without its copies, and a broadcast of them
    all would pass through the driver's memory."""
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt")
    counts = term_counts(df, id_col, text_col).select(id_col, "term", "tf", salt)
    terms = vocabulary.terms.select("term", F.col("id").cast("int").alias("i"), "idf",
                                    F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return counts.join(terms.hint("merge"), ["term", "salt"]).select(id_col, "term", "i", (F.col("tf") * F.col("idf")).alias("w"))


def _normalised(entries: str) -> Column:
    """The weights of an array of entries by their Euclidean norm."""
    norm = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
    # the norm is bound once, not computed for each entry
    return F.flatten(F.transform(F.array(norm), lambda n: F.transform(entries, lambda e: e["w"] / n)))


def tfidf_entries(df: DataFrame, vocabulary: VocabularyTable, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """M4 + F10 against a stored vocabulary: ``(id, features)``, the ``indices`` (rising) and
    L2-normalised ``values`` of each text; one without a known term has no row.

    A text's entries come together by its id: one bounded array a text."""
    found = _looked_up(df, vocabulary, id_col, text_col).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("i", "w"))).alias("e"))
    return found.select(id_col, F.struct(F.col("e.i").alias("indices"), _normalised("e").alias("values")).alias("features"))


def tfidf_weights(df: DataFrame, vocabulary: VocabularyTable, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """``(id, term, weight)`` against a stored vocabulary."""
    found = _looked_up(df, vocabulary, id_col, text_col).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("term", "w"))).alias("e"))
    return found.select(id_col, F.inline(F.arrays_zip(F.col("e.term").alias("term"), _normalised("e").alias("weight"))))
