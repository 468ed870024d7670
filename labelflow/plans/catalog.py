"""The query catalogue: one ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's test tables (whole tables, whole texts) and
aliases every computed column so names equal the DuckDB oracle's
(``plans/oracle.py``). Floating results are rounded to 6 places (4 where
rounding is the operator) so partition order cannot change the hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABELS, MAX_FEATURES, MAX_LENGTH
from ..functions.text import na_to_null
from ..operators import clean, compare, evaluate, features, split, vocabulary
from ..operators.scoring import blank_guard as _blank_guard
from ..operators.scoring import linear_score
from ..session import scratch_path, store
from ..sinks import write_keyed_csv, write_metrics_json, write_run_state, write_split_table, write_table_csv
from ..sources.labelled import file_order_ids, read_labelled_csv
from ..sources.labelled import read_split as _read_split
from ..sources.records import read_keyed_csv, read_metrics, read_run_history, read_table_csv
from .base import (CANDIDATES, RULE_MODELS, labelled, linear_weights, raw_labelled, rule_label, rule_predictions, table,
                   with_unknown_truth)

Query = Callable[[SparkSession, str], DataFrame]
CONFIGS = (("length rule", "m_len"), ("modulo rule", "m_mod"), ("constant", "m_const"))


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- ingest
def _na(spark, d):
    raw = raw_labelled(spark, d)
    return raw.select("row_id", "language", na_to_null(F.col("text")).alias("text"),
                      na_to_null(F.col("label")).alias("label"))


def _cleaned(spark, d):
    """Lenient loader: drop null, strip, normalise, drop blank; unknown labels kept."""
    return clean.clean_labelled(_na(spark, d), strict=False)


def q_load_labelled(spark, d):
    return labelled(spark, d)


def q_na_tokens(spark, d):
    return _na(spark, d).select("row_id", "text", "label")


def q_drop_null(spark, d):
    return clean.drop_null(_na(spark, d)).select("row_id", "text", "label")


def q_clean_text(spark, d):
    return clean.clean_text(clean.drop_null(_na(spark, d))).select("row_id", "text")


def q_normalise_label(spark, d):
    return clean.clean_label(clean.drop_null(_na(spark, d))).select("row_id", "label")


def q_non_blank(spark, d):
    return _cleaned(spark, d).select("row_id", "text", "label")


def q_invalid_labels(spark, d):
    return clean.invalid_label_rows(_cleaned(spark, d)).select("row_id", "label")


def q_project_rename(spark, d):
    valid = _cleaned(spark, d).where(F.col("label").isin(*LABELS))
    return clean.project_rename(clean.label_encode(valid))


def q_label_encode(spark, d):
    return clean.label_encode(_cleaned(spark, d)).select("row_id", "label", "label_id")


def q_label_decode(spark, d):
    enc = clean.label_encode(_cleaned(spark, d)).select("row_id", "label_id")
    return clean.label_decode(enc, out="label_decoded")


def q_read_split(spark, d):
    path = scratch_path(spark, "splits")
    write_split_table(_split70(spark, d).select("row_id", "label", "split"), path)
    return _read_split(spark, path, "val").select("row_id", "label", "split")


def q_csv_round_trip(spark, d):
    """Dirty rows written as CSV (quotes, commas, line breaks, NA tokens) and read back."""
    path = scratch_path(spark, "labelled-csv")
    write_table_csv(raw_labelled(spark, d).select("row_id", "language", "text", "label"), path)
    back = read_labelled_csv(spark, [path], required=("text", "language", "label"), multi_line=True)
    return back.select(F.col("row_id").cast("long").alias("row_id"), "language", "text", "label")


def q_keyed_report_csv(spark, d):
    """One model's report as a keyed CSV, read back."""
    path = scratch_path(spark, "report-csv")
    report = evaluate.classification_report(_preds(spark, d)).where(F.col("model") == RULE_MODELS[0])
    write_keyed_csv(report.select("row_name", "row_idx", "precision", "recall", "f1_score", "support"), path)
    back = read_keyed_csv(spark, path)
    return back.select("row_name", *[r6(F.col(c).cast("double")).alias(c)
                                     for c in ("precision", "recall", "f1_score", "support")])


def q_prediction_csv(spark, d):
    """All models' predictions as a CSV with a byte-order mark, read back."""
    path = scratch_path(spark, "predictions-csv")
    write_table_csv(_preds(spark, d).select("row_id", "language", "label", "model", "predicted_label"), path, byte_order_mark=True)
    return read_table_csv(spark, path).withColumn("row_id", F.col("row_id").cast("long"))


def q_summary_csv(spark, d):
    """The summary under its presentation headers as a CSV with a byte-order mark, read back."""
    path = scratch_path(spark, "summary-csv")
    write_table_csv(compare.results_summary(_metrics(spark, d), CANDIDATES), path, byte_order_mark=True)
    back = read_table_csv(spark, path)
    return back.select(F.col("ordinal").cast("int").alias("ordinal"), "Модель",
                       *[F.col(c).cast("double").alias(c) for c in back.columns[2:]])


def q_run_titles(spark, d):
    """Names of the runs and of their files, from their metrics."""
    m = _metrics(spark, d)
    return m.select("model", compare.run_title(F.col("model"), accuracy=F.format_number("accuracy", 4)).alias("title"),
                    compare.result_file(F.col("model"), "metrics", "json").alias("metrics_file"),
                    compare.result_file(F.col("model"), "predictions").alias("predictions_file"))


def q_file_order_ids(spark, d):
    """Labelled rows written as several CSV files in id order, read back and numbered as they stand in the files."""
    path = scratch_path(spark, "ordered-csv")
    rows = labelled(spark, d).select("row_id", "language", F.regexp_replace("text", "[\r\n]+", " ").alias("text"), "label")
    write_table_csv(rows.repartitionByRange(5, "row_id").sortWithinPartitions("row_id"), path)
    back = read_labelled_csv(spark, [path], required=("text", "language", "label"))
    numbered = file_order_ids(back.withColumnRenamed("row_id", "doc_id"), [path], scratch_path(spark, "numbered"), id_col="place")
    return numbered.select("place", F.col("doc_id").cast("long").alias("row_id"), "label")


def q_rejects_by_reason(spark, d):
    """Dirty rows validated in the pass that writes them: rows by reason in the quarantine, and as counted meanwhile."""
    checked = clean.clean_to_table(_na(spark, d), scratch_path(spark, "checked"), strict=False)
    counted = F.create_map(*[F.lit(x) for r in clean.REJECT_REASONS for x in (r, checked.counts[r])])
    rejected = checked.rejected.groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n_rows"))
    good = checked.good.agg(F.lit("none").alias("reason"), F.count("*").alias("n_rows"))
    n_counted = F.coalesce(counted[F.col("reason")], F.lit(checked.counts["good"])).cast("long")
    return rejected.unionByName(good).withColumn("n_counted", n_counted)


def q_metrics_gather(spark, d):
    """Each model's metrics in a folder of its own, gathered in list order."""
    root = scratch_path(spark, "metrics")
    metrics = store(_metrics(spark, d), "metrics-table")
    paths = [f"{root}/{m}/metrics.json" for m in RULE_MODELS]
    for model, path in zip(RULE_MODELS, paths, strict=True):
        write_metrics_json(metrics.where(F.col("model") == model), path)
    return read_metrics(spark, paths, pretty=False).drop("source_file")


#: Steps that a checkpoint of the event history covers; it repeats as many from before.
CHECKPOINT_STEPS = 1000


def q_run_history_best_step(spark, d):
    """Events as the run history of their users: a checkpoint for every block of steps, which repeats the block before."""
    path = scratch_path(spark, "history")
    events = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), F.round("value", 3).alias("f1"))
    block = F.floor(F.col("step") / CHECKPOINT_STEPS)
    entry = F.struct("step", (F.col("step") / 10.0).alias("epoch"), F.lit(0.5).alias("eval_loss"),
                     F.col("f1").alias("eval_f1_weighted"))
    checkpoints = events.select("run", "f1", "step", entry.alias("entry"), F.explode(F.array(block, block + 1)).alias("checkpoint"))
    history = checkpoints.groupBy("run", "checkpoint").agg(
        F.max("f1").alias("best_metric"), F.max_by("step", F.struct("f1", -F.col("step"))).alias("best_global_step"),
        F.collect_list("entry").alias("log_history"))
    write_run_state(history, path)
    best = compare.best_step(read_run_history(spark, [path], pretty=False))
    return best.select(F.col("run").cast("long").alias("run"), "best_step", r6("best_metric").alias("best_metric"))


def q_json_field(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


# ---------------------------------------------------------------- distribution / split
def _split70(spark, d, with_n_chars: bool = False):
    return split.split_70_15_15(labelled(spark, d, with_n_chars=with_n_chars))


def q_class_distribution(spark, d):
    return split.class_distribution(labelled(spark, d))


def q_distinct_labels(spark, d):
    return split.distinct_labels(labelled(spark, d))


def q_label_except(spark, d):
    return clean.label_except(clean.clean_label(clean.drop_null(_na(spark, d))))


def q_stratified_split(spark, d):
    return split.stratified_split(labelled(spark, d)).select("row_id", "label", "split")


def q_split_70_15_15(spark, d):
    return _split70(spark, d).select("row_id", "label", "split")


def q_split_sizes(spark, d):
    return split.split_sizes(_split70(spark, d))


def q_train_val_union(spark, d):
    return split.train_val_union(_split70(spark, d)).select("row_id", "label", "split")


# ---------------------------------------------------------------- evaluate
def _preds(spark, d):
    return with_unknown_truth(rule_predictions(labelled(spark, d, with_n_chars=True)))


def _metrics(spark, d):
    return evaluate.metrics_record(_preds(spark, d))


def q_attach_prediction(spark, d):
    return _preds(spark, d).select("row_id", "label", "model", "predicted_label")


def q_join_truth_prediction(spark, d):
    truth = labelled(spark, d).select("row_id", "label")
    preds = _preds(spark, d).select("row_id", "model", "predicted_label")
    return evaluate.join_truth_prediction(truth, preds).select("row_id", "label", "model", "predicted_label")


def q_is_correct(spark, d):
    return evaluate.is_correct(_preds(spark, d)).select("row_id", "model", "is_correct")


def q_errors_only(spark, d):
    return evaluate.errors_only(_preds(spark, d)).select("row_id", "model", "label", "predicted_label")


def q_confusion_long(spark, d):
    return evaluate.confusion_long(_preds(spark, d))


def q_confusion_wide(spark, d):
    return evaluate.confusion_wide(evaluate.confusion_long(_preds(spark, d)))


def q_accuracy(spark, d):
    return evaluate.accuracy(_preds(spark, d)).select("model", r6("accuracy").alias("accuracy"))


def _class_metrics(spark, d):
    return evaluate.class_metrics(_preds(spark, d))


def q_class_metrics(spark, d):
    return _class_metrics(spark, d).select(
        "model", "label", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def q_weighted_metrics(spark, d):
    w = evaluate.weighted_metrics(_preds(spark, d))
    return w.select("model", *[r6(c).alias(c) for c in ("precision_weighted", "recall_weighted", "f1_weighted")])


def q_macro_metrics(spark, d):
    m = evaluate.macro_metrics(_preds(spark, d))
    return m.select("model", *[r6(c).alias(c) for c in ("precision_macro", "recall_macro", "f1_macro", "support")])


def _report(spark, d):
    return evaluate.classification_report(_preds(spark, d))


def q_classification_report(spark, d):
    return _report(spark, d).select(
        "model", "row_name", "row_idx", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def q_metrics_record(spark, d):
    return _metrics(spark, d)


def q_metrics_by_split(spark, d):
    # score the split table itself: each row carries its part, no join back
    preds = with_unknown_truth(rule_predictions(_split70(spark, d, with_n_chars=True)))
    return evaluate.metrics_record(preds, keys=("model", "split"))


def q_round4(spark, d):
    return _class_metrics(spark, d).select(
        "model", "label", *[F.round(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1_score")])


# ---------------------------------------------------------------- compare
def _best(spark, d):
    return compare.best_model(_metrics(spark, d), CANDIDATES)


def q_results_summary(spark, d):
    return compare.results_summary(_metrics(spark, d), CANDIDATES)


def q_best_model(spark, d):
    return _best(spark, d).select("model", "ordinal", "f1_weighted")


def q_best_model_rows(spark, d):
    return compare.best_model_rows(_preds(spark, d), _best(spark, d)).select(
        "row_id", "model", "label", "predicted_label")


def q_best_model_class_table(spark, d):
    t = compare.best_model_class_table(_report(spark, d), _best(spark, d))
    return t.select(*[r6(c).alias(c) if t.schema[c].dataType.typeName() == "double" else F.col(c)
                      for c in t.columns])


def q_class_rows(spark, d):
    t = compare.class_rows(_report(spark, d))
    return t.select("model", "row_name", "row_idx", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score")])


def q_verification_sample(spark, d):
    best_rows = compare.best_model_rows(_preds(spark, d), _best(spark, d))
    return compare.verification_sample(best_rows).select(
        "row_id", "label", "predicted_label", "is_correct", "example_type")


def q_head_n(spark, d):
    return compare.head_n(labelled(spark, d), 5).select("row_id", "language", "label")


def q_frame_model_metric(spark, d):
    return compare.frame_model_metric(_metrics(spark, d))


def q_frame_config_f1(spark, d):
    return compare.frame_config_f1(_metrics(spark, d), CONFIGS)


def q_frame_confusion_cells(spark, d):
    return compare.frame_confusion_cells(evaluate.confusion_long(_preds(spark, d)), _best(spark, d))


# ---------------------------------------------------------------- features
def q_tokenize_words(spark, d):
    docs = table(spark, d, "documents")
    t = features.tokens(docs.select(F.col("doc_id").alias("row_id"), "text"))
    return t.select("row_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def q_ngrams_1_2(spark, d):
    t = features.with_terms(labelled(spark, d))
    return t.select("row_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


def q_term_counts(spark, d):
    return features.term_counts(labelled(spark, d)).select("row_id", "term", F.col("tf").cast("long").alias("tf"))


def _train_test(spark, d):
    s = store(_split70(spark, d).select("row_id", "text", "label", "split"), "splits", partition_by="split")
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


def _vocab_idf(train: DataFrame):
    vocab = features.vocabulary_topk(features.term_counts(train), MAX_FEATURES)
    n_docs = train.count()
    return features.idf_table(vocab, n_docs)


def q_vocabulary_topk(spark, d):
    train, _ = _train_test(spark, d)
    return features.vocabulary_topk(features.term_counts(train), MAX_FEATURES).select(
        "term", "tf_total", "df", F.col("rank").cast("long").alias("rank"))


def q_vocabulary_threshold(spark, d):
    """The same terms by local summaries and a threshold."""
    train, _ = _train_test(spark, d)
    return vocabulary.top_terms(features.term_counts(train), MAX_FEATURES).select(
        "term", "tf_total", "df", F.col("rank").cast("long").alias("rank"))


#: A vocabulary that is a table: its terms are never on the driver.
LARGE_FEATURES = 1_000_000


def _large_weights(fit_on, texts):
    fitted = vocabulary.fit_vocabulary(fit_on, LARGE_FEATURES)
    return vocabulary.tfidf_weights(texts, fitted).select("row_id", "term", r6("weight").alias("weight"))


def q_tfidf_fit_large(spark, d):
    train, _ = _train_test(spark, d)
    return _large_weights(train, train)


def q_tfidf_transform_large(spark, d):
    return _large_weights(*_train_test(spark, d))


def q_idf(spark, d):
    train, _ = _train_test(spark, d)
    return _vocab_idf(train).select("term", "df", r6("idf").alias("idf"))


def _weights(fit_on, texts):
    return features.tfidf_of_texts(texts, features.fit_tfidf(fit_on)).select("row_id", "term", r6("weight").alias("weight"))


def q_tfidf(spark, d):
    lab = store(labelled(spark, d).select("row_id", "text"), "labelled")
    return _weights(lab, lab)


def q_tfidf_fit(spark, d):
    train, _ = _train_test(spark, d)
    return _weights(train, train)


def q_tfidf_transform(spark, d):
    return _weights(*_train_test(spark, d))


def _encoded(df, *others):
    return df.select(
        "row_id", *others,
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


def q_encode_fixed_length(spark, d):
    lab = labelled(spark, d)
    return _encoded(features.encode(lab, features.word_vocabulary(lab), MAX_LENGTH))


def q_encode_longest(spark, d):
    lab = labelled(spark, d)
    return _encoded(features.encode_longest(lab, features.word_vocabulary(lab)))


def q_encode_batches(spark, d):
    lab = labelled(spark, d)
    return _encoded(features.encode_batches(lab, features.word_vocabulary(lab)), "batch", "width")


# ---------------------------------------------------------------- score
def _scored(spark, d, digits=None):
    emb = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("true_class"), "embedding")
    return linear_score(emb, "embedding", linear_weights(), digits=digits)


def q_softmax(spark, d):
    s = _scored(spark, d)
    return s.select("vec_id", *[r6(F.col("probs")[i]).alias(f"p{i}") for i in range(len(LABELS))])


def q_argmax_class(spark, d):
    return _scored(spark, d).select("vec_id", "class_id", "predicted_label")


def q_prob_map(spark, d):
    return _scored(spark, d, digits=4).select("vec_id", F.explode("probabilities").alias("label", "prob"))


def q_linear_score(spark, d):
    return _scored(spark, d).select("vec_id", "true_class", "predicted_label", r6("margin").alias("margin"),
                                    r6(F.array_max("probs")).alias("p_max"))


def q_blank_guard(spark, d):
    raw = raw_labelled(spark, d, with_n_chars=True)
    return _blank_guard(raw, rule_label("m_len")).select("row_id", "predicted_label", "status")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
