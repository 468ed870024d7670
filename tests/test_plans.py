"""Physical-plan checks: the scale properties the design relies on."""

from pyspark.sql import functions as F

from labelflow.operators import compare, evaluate, features, split
from labelflow.plans.base import labelled, rule_predictions
from tests.conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_labelled_scan_prunes_columns(spark):
    p = plan(labelled(spark, SF01))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    assert "source" not in p.split("ReadSchema")[1].split("\n")[0]


def test_split_reads_the_text_in_one_narrow_pass(spark):
    p = plan(split.split_70_15_15(labelled(spark, SF01)))
    # borders join by broadcast (their stored size is known): no window, no sort, no exchange above the text's join
    assert p.count("text#") and p.count("ReadSchema: struct<doc_id:bigint,text:string,lang:string>") == 1
    assert "Window" not in p and "row_number" not in p and "Union" not in p
    top = p[:p.index("ReadSchema: struct<doc_id")]
    assert "SortMergeJoin" not in top and "Exchange hashpartitioning(label" not in top


def test_evaluation_pre_aggregates(spark):
    preds = rule_predictions(labelled(spark, SF01, with_n_chars=True))
    # the one pass over predictions combines map-side
    assert "partial_count" in plan(evaluate.pair_counts(preds, materialized=False))
    p = plan(evaluate.classification_report(preds))
    assert p.count("documents.parquet") == 1 and p.count("Exchange hashpartitioning") <= 6
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_head_and_sample_are_topk(spark):
    preds = rule_predictions(labelled(spark, SF01, with_n_chars=True)).where(F.col("model") == "m_len")
    p = plan(compare.verification_sample(preds))
    assert p.count("WindowGroupLimit") == 2 and p.count("documents.parquet") == 1
    assert "TakeOrderedAndProject" in plan(compare.head_n(preds))


def test_tfidf_needs_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    fit = features.TfidfFit(["the", "of the"], [1.0, 2.0], 3)
    p = plan(features.tfidf_of_texts(docs, fit))
    assert "Exchange" not in p and "Join" not in p and "Generate inline" in p


def test_sweep_scans_the_evaluation_text_once(spark):
    from labelflow.operators.model import sweep

    rows = [(i, f"word{i % 3} other{i % 5} text", i % 3, ["negative", "neutral", "positive"][i % 3]) for i in range(60)]
    train = spark.createDataFrame(rows, "row_id long, text string, label_id int, label string")
    runs = sweep(train, spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text"), [("a", {}), ("b", {})])
    assert plan(runs).count("documents.parquet") == 1 and "Union" not in plan(runs)


def test_term_counts_need_no_shuffle(spark):
    lab = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    p = plan(features.term_counts(lab))
    assert "Exchange" not in p and "Generate inline" in p


def test_encode_aggregates_map_side(spark):
    lab = labelled(spark, SF01)
    p = plan(features.encode(lab, features.word_vocabulary(lab), 16))
    assert "partial_collect_list" in p


def test_bucketed_join_needs_no_exchange(spark, tmp_dir):
    from labelflow.plans.base import labelled_from_tables
    from labelflow.sources.bucketed import write_bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the sort-merge path
    try:
        write_bucketed(spark.read.parquet(f"{SF01}/documents.parquet"), "t_docs", "doc_id", 4, f"{tmp_dir}/d")
        write_bucketed(spark.read.parquet(f"{SF01}/labels.parquet"), "t_labels", "doc_id", 4, f"{tmp_dir}/l")
        lab = labelled_from_tables(spark, "t_docs", "t_labels")
        p = plan(lab)
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert lab.count() == labelled(spark, SF01).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
