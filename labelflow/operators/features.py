"""TF-IDF over word 1- and 2-grams and fixed-length encodings.

Term counting happens inside each row (sort the row's terms, run-length
count), so building the (row, term, tf) table needs no shuffle. The only
corpus-wide step is the vocabulary aggregate ``groupBy(term)`` -- partial
aggregation first, then a distributed top-k -- whose result, the model, is at
most ``max_features`` rows.

The transform is the persistable ML stages (``tfidf_stages``): a
``SQLTransformer`` (tokens + bigrams) -> ``CountVectorizerModel`` (the fitted
vocabulary) -> ``ElementwiseProduct`` (idf) -> ``Normalizer`` (L2). All stages
are per-row: scoring never shuffles. The long ``(row_id, term, weight)`` table
for reports is the same vectors, exploded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BATCH_ROWS, MAX_FEATURES, MAX_LENGTH, PAD_ID, UNK_ID, WORD_PATTERN
from ..functions.text import ngrams_1_2, run_starts, term_frequencies, word_tokens
from ..session import ship_package, store
from .ids import dense_ids

#: Words of the texts that a task counts at once; a longer text is counted alone.
COUNT_WORDS = 1 << 21
#: Rows that a task counts at once.
COUNT_ROWS = 1 << 16
#: Distinct terms that a task counts before it hands them on.
COUNT_TERMS = 1 << 20


def tokens(df: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """word tokens as an array column."""
    return df.withColumn(out, word_tokens(F.col(text_col)))


def with_terms(df: DataFrame, text_col: str = "text", out: str = "terms") -> DataFrame:
    """unigrams then bigrams.

    Tokens are projected first: the bigram lambda then indexes a column
    instead of re-running the regex per element (Catalyst does not collapse
    a costly expression that is used more than once)."""
    t = df.withColumn("_t", word_tokens(F.col(text_col)))
    return t.withColumn(out, ngrams_1_2(F.col("_t"))).drop("_t")


def term_counts(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """F8: ``(id, term, tf)`` -- counted inside each row, no shuffle."""
    t = df.select(id_col, word_tokens(F.col(text_col)).alias("_t"))
    s = t.select(id_col, F.sort_array(ngrams_1_2(F.col("_t"))).alias("_s"))
    s = s.select(id_col, "_s", run_starts(F.col("_s")).alias("_st"))
    return s.select(id_col, F.inline(term_frequencies(F.col("_s"), F.col("_st"))))


def _counts_of_texts(words: pa.Array, ends: np.ndarray) -> pa.Table:
    """``(term, tf, df)`` of the 1- and 2-grams of some texts, each term once; text ``i``'s
    words lie from ``ends[i]`` to ``ends[i + 1]``.

    Words are numbers here, a bigram is the number of its pair: all terms beside
    their text's number are sorted, and each run of a term is counted."""
    coded = words.dictionary_encode()
    code, names, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary, max(len(ends) - 1, 1)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    n, same = len(names), text[1:] == text[:-1]
    pairs = n + code[:-1][same] * n + code[1:][same]
    keyed = np.sort(np.concatenate([code * texts + text, pairs * texts + text[1:][same]]))
    term = keyed // texts
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[:len(term)])
    new_text = np.concatenate([[True], keyed[1:] != keyed[:-1]])[:len(keyed)]
    tf, df = np.diff(np.append(first, len(term))), np.add.reduceat(new_text.astype(np.int64), first) if len(first) else first
    term = term[first]
    one, two = term[term < n], term[term >= n] - n
    bigrams = pc.binary_join_element_wise(names.take(pa.array(two // max(n, 1))), names.take(pa.array(two % max(n, 1))), " ")
    return pa.table([pa.concat_arrays([names.take(pa.array(one)), bigrams]), pa.array(tf), pa.array(df)], names=["term", "tf", "df"])


def summed_counts(tables: list[pa.Table]) -> pa.Table:
    """``(term, tf, df)`` of several tables of counts, each term once."""
    found = pa.concat_tables(tables).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
    return found.select(["term", "tf_sum", "df_sum"]).rename_columns(["term", "tf", "df"])


def local_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, tf, df)`` within parts of the input, without a shuffle: how often the
    part's texts hold a term, and how many of them do.

    The sums over parts are those of ``term_counts``. A task counts some texts at
    a time and hands on what it has at about ``COUNT_TERMS`` distinct terms."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        rows = 0
        for batch in batches:
            lists = batch.column(0)
            offsets, words = np.asarray(lists.offsets), lists.values
            lo = 0
            while lo < len(lists):
                hi = int(np.searchsorted(offsets, offsets[lo] + COUNT_WORDS, "right")) - 1
                hi = min(max(hi, lo + 1), lo + COUNT_ROWS, len(lists))
                own = words.slice(offsets[lo], offsets[hi] - offsets[lo])
                waiting.append(_counts_of_texts(own, offsets[lo:hi + 1]))
                rows, lo = rows + waiting[-1].num_rows, hi
                if rows >= COUNT_TERMS:
                    found = summed_counts(waiting)
                    waiting, rows = [found], found.num_rows
                    if rows >= COUNT_TERMS // 2:
                        yield from found.to_batches()
                        waiting, rows = [], 0
        if waiting:
            yield from summed_counts(waiting).to_batches()

    words = df.select(F.coalesce(word_tokens(F.col(text_col)), F.array().cast("array<string>")).alias("words"))
    return words.mapInArrow(run, "term string, tf bigint, df bigint")


def term_totals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, tf_total, df)``: each term's occurrences, and the texts that hold it."""
    return local_counts(df, text_col).groupBy("term").agg(F.sum("tf").alias("tf_total"), F.sum("df").alias("df"))


def vocabulary_topk(counts: DataFrame, k: int = MAX_FEATURES) -> DataFrame:
    """The ``k`` terms with the highest corpus frequency (ties: term order).

    ``(term, tf_total, df, rank)``; at most ``k`` rows. ``df`` (documents
    containing the term) comes from the same aggregate, as each row's terms
    are already distinct.
    """
    return topk_of_totals(counts.groupBy("term").agg(
        F.sum("tf").cast("long").alias("tf_total"), F.count(F.lit(1)).alias("df")
    ), k)


def topk_of_totals(totals: DataFrame, k: int = MAX_FEATURES) -> DataFrame:
    """O4 of ``(term, tf_total, df)``, one row a term."""
    top = totals.orderBy(F.desc("tf_total"), F.asc("term")).limit(k)
    # The window below sees at most k rows (after the top-k), never the corpus.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tf_total"), F.asc("term"))))


def idf_table(vocab: DataFrame, n_docs) -> DataFrame:
    """smoothed idf ``ln((1 + n) / (1 + df)) + 1``."""
    n = F.lit(n_docs).cast("double") if not hasattr(n_docs, "alias") else n_docs.cast("double")
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def tfidf_of_texts(df: DataFrame, fit: TfidfFit, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """M4 + F10 from texts: ``(id, term, weight)``, L2-normalised per row, unknown
    terms dropped. The fitted stages run inside each row and the vector's
    entries are exploded beside their terms: no shuffle, no join."""
    vectors = PipelineModel(tfidf_stages(fit, text_col)).transform(df.select(id_col, text_col))
    sparse = F.unwrap_udt("features")
    entries = F.arrays_zip(sparse["indices"].alias("i"), sparse["values"].alias("w"))
    names = F.split(F.lit("|".join(fit.vocabulary)), "[|]")  # one literal, split once; no term holds the sign
    rows = vectors.select(id_col, F.inline(entries).alias("i", "weight"))
    return rows.select(id_col, F.get(names, F.col("i")).alias("term"), "weight")


@dataclass
class TfidfFit:
    """A fitted vocabulary: terms (alphabetical = vector index), idf, #docs."""

    vocabulary: list[str]
    idf: list[float]
    n_docs: int


def fit_tfidf(df: DataFrame, text_col: str = "text", id_col: str = "row_id",
              max_features: int = MAX_FEATURES) -> TfidfFit:
    """M3: fit on the given (train) rows. Brings at most ``max_features`` rows
    to the driver -- the model itself, like any fitted vocabulary."""
    n_docs = df.count()
    vocab = idf_table(topk_of_totals(term_totals(df, text_col), max_features), n_docs)
    rows = sorted(vocab.select("term", "idf").collect(), key=lambda r: r["term"].encode("utf-8"))
    return TfidfFit([r["term"] for r in rows], [float(r["idf"]) for r in rows], n_docs)


def terms_sql(text_col: str = "text") -> str:
    """The ``terms`` expression in SQL, for a persistable SQLTransformer; a null text has none."""
    pattern = WORD_PATTERN.replace("\\", "\\\\")
    tok = f"regexp_extract_all(lower(coalesce({text_col}, '')), '{pattern}', 0)"
    bind = "t -> concat(t, transform(slice(t, 2, greatest(size(t) - 1, 0)), (y, i) -> concat(t[i], ' ', y)))"
    return f"element_at(transform(array({tok}), {bind}), 1)"


def tfidf_stages(fit: TfidfFit, text_col: str = "text", features_col: str = "features") -> list:
    """ML stages text -> L2-normalised TF-IDF vector (per row, no shuffle)."""
    return [
        SQLTransformer(statement=f"SELECT *, {terms_sql(text_col)} AS terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(fit.vocabulary, inputCol="terms", outputCol="tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(fit.idf), inputCol="tf", outputCol="tfidf_raw"),
        Normalizer(p=2.0, inputCol="tfidf_raw", outputCol=features_col),
    ]


def word_vocabulary(df: DataFrame, k: int | None = None, id_col: str = "row_id",
                    text_col: str = "text") -> DataFrame:
    """Unigram vocabulary for encodings: ``(term, id)``, ids (long) from 2 by falling
    frequency, then term; all words unless a size ``k`` is asked for.

    The words are sorted by ranges of (frequency, word), so a prefix or a
    frequency that most words share is cut like any other range."""
    toks = df.select(id_col, F.explode(word_tokens(F.col(text_col))).alias("term"))
    counts = store(toks.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    ranked = dense_ids(counts, [F.desc("n"), F.asc("term")], start=UNK_ID + 1).select("term", "id")
    return ranked.where(F.col("id") <= k + UNK_ID) if k is not None else ranked


def encode_ids(df: DataFrame, vocab: DataFrame, max_length: int, id_col: str = "row_id", text_col: str = "text",
               validate: bool = True) -> DataFrame:
    """``(id, ids)``: the vocabulary ids of a text's first ``max_length`` words, not padded.

    Only those tokens are exploded (bounded per text), looked up in the
    vocabulary (a miss is UNK_ID; Spark broadcasts it only if its measured size
    allows), and regrouped by id; ids must be unique.
    """
    if validate and (twice := df.groupBy(id_col).count().where("count > 1").limit(1).collect()):
        raise ValueError(f"duplicate ids, e.g. {twice[0].asDict()}")
    cut = df.select(id_col, F.slice(word_tokens(F.col(text_col)), 1, max_length).alias("_t"))
    exploded = cut.select(id_col, F.posexplode_outer("_t").alias("pos", "term"))
    looked = exploded.join(vocab.select("term", "id"), "term", "left")
    tok = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    grouped = looked.groupBy(id_col).agg(F.array_sort(F.collect_list(tok)).alias("_p"))
    return grouped.select(id_col, F.transform(F.col("_p"), lambda s: s["id"]).alias("ids"))


def padded(ids: Column, width: Column) -> tuple[Column, Column]:
    """``input_ids`` right-padded with PAD_ID to ``width``, and the mask: 1 for a word, 0 for padding."""
    pad = F.greatest(width - F.size(ids), F.lit(0))
    return (F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("long"), pad)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))


def encode(df: DataFrame, vocab: DataFrame, max_length: int, id_col: str = "row_id",
           text_col: str = "text", validate: bool = True) -> DataFrame:
    """ids cut to ``max_length``, right-padded with PAD_ID; mask 1/0."""
    coded = encode_ids(df, vocab, max_length, id_col, text_col, validate)
    return coded.select(id_col, *padded(F.col("ids"), F.lit(max_length)))


def encode_batches(df: DataFrame, vocab: DataFrame, batch_rows: int = BATCH_ROWS, max_length: int = MAX_LENGTH,
                   by_length: bool = True, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """``(id, batch, width, input_ids, attention_mask)`` in batches of ``batch_rows``,
    each padded to its own longest text (at most ``max_length``).

    Batches follow the texts' length, then their id, so that texts of like
    length share one and little is padded; or the ids alone, as they came. Every
    batch is full but the last. The batches are made of a narrow table of ids
    and lengths, numbered by a range sort; ids must be unique."""
    coded = store(encode_ids(df, vocab, max_length, id_col, text_col), "encoded")
    sizes = coded.select(id_col, F.size("ids").alias("size"))
    order = [F.col("size"), F.col(id_col)] if by_length else [F.col(id_col)]
    numbered = dense_ids(sizes, order, out="batch").withColumn("batch", F.floor(F.col("batch") / batch_rows))
    widths = numbered.groupBy("batch").agg(F.max("size").alias("width"))
    placed = numbered.join(widths, "batch").select(id_col, "batch", "width")
    return coded.join(placed, id_col).select(id_col, "batch", "width", *padded(F.col("ids"), F.col("width")))


def longest_length(df: DataFrame, text_col: str = "text", max_length: int = MAX_LENGTH) -> int:
    """``min(max_length, longest token count)`` -- one global aggregate, a scalar back."""
    v = df.agg(F.max(F.size(word_tokens(F.col(text_col))))).first()[0]
    return int(min(max_length, v or 0))


def encode_longest(df: DataFrame, vocab: DataFrame, id_col: str = "row_id", text_col: str = "text",
                   max_length: int = MAX_LENGTH) -> DataFrame:
    """pad to the longest text of the batch (at most ``max_length``)."""
    return encode(df, vocab, longest_length(df, text_col, max_length), id_col, text_col)
