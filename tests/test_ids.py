"""Dense ids, batches, file-order ids, validation in one pass, large vocabularies, streams that are evaluated."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.constants import PAD_ID, UNK_ID
from labelflow.operators import clean, evaluate, features, stacked, vocabulary
from labelflow.operators.ids import dense_ids
from labelflow.sinks import write_table_csv
from labelflow.sources.labelled import file_order_ids, read_labelled_csv
from labelflow.streaming import count_stream, stream_counts, stream_metrics, stream_report
from labelflow.streaming.evaluate_stream import write_batch
from tests.test_features import brute_terms


def test_dense_ids_are_gapless_and_in_order(spark):
    rows = [(i % 7, f"k{i:04d}", "x") for i in range(2000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b string, c string").repartition(9)
    got = dense_ids(df, [F.desc("a"), F.asc("b")], start=5).orderBy("id").collect()
    assert [r.id for r in got] == list(range(5, 2005))
    assert [(r.a, r.b) for r in got] == sorted(((a, b) for a, b, _ in rows), key=lambda r: (-r[0], r[1]))
    equal = dense_ids(spark.range(500).select(F.lit(1).alias("a")), [F.col("a")])
    assert sorted(r.id for r in equal.collect()) == list(range(500))
    assert dense_ids(df.limit(0), [F.col("a")]).collect() == []


def test_word_ids_with_one_hot_prefix(spark):
    """Nearly all words occur once and begin alike."""
    words = [f"prefix{i:05d}" for i in range(3000)] + ["common"] * 9 + ["other"] * 9
    random.Random(2).shuffle(words)
    df = spark.createDataFrame([(i, " ".join(words[i::40])) for i in range(40)], "row_id long, text string")
    got = {r.term: r.id for r in features.word_vocabulary(df).collect()}
    counts = collections.Counter(words)
    want = sorted(counts, key=lambda w: (-counts[w], w))
    assert got == {w: i + UNK_ID + 1 for i, w in enumerate(want)}
    assert dict(features.word_vocabulary(df).dtypes)["id"] == "bigint"
    assert {r.term for r in features.word_vocabulary(df, 3).collect()} == set(want[:3])


@pytest.mark.parametrize("by_length", [True, False])
def test_batches_are_as_wide_as_their_longest_text(spark, by_length):
    pick = random.Random(4)
    texts = {i: " ".join(pick.choice(["aa", "bb", "cc"]) for _ in range(pick.randrange(0, 12))) for i in range(53)}
    texts[53], texts[54] = None, "aa " * 300
    df = spark.createDataFrame(list(texts.items()), "row_id long, text string")
    vocab = features.word_vocabulary(df.where("row_id < 50"))
    ids = {r.term: r.id for r in vocab.collect()}
    rows = features.encode_batches(df, vocab, batch_rows=8, max_length=20, by_length=by_length).collect()
    by_batch = collections.defaultdict(list)
    for r in rows:
        by_batch[r.batch].append(r)
    assert sorted(by_batch) == list(range(7)) and [len(by_batch[b]) for b in range(7)] == [8] * 6 + [7]
    sizes = {}
    for b, members in by_batch.items():
        lengths = [min(20, len((texts[r.row_id] or "").split())) for r in members]
        assert {r.width for r in members} == {max(lengths)}
        for r, n in zip(members, lengths, strict=True):
            want = [ids[w] for w in (texts[r.row_id] or "").split()[:20]]
            assert r.input_ids == want + [PAD_ID] * (r.width - n) and r.attention_mask == [1] * n + [0] * (r.width - n)
            sizes[r.row_id] = (n, r.row_id) if by_length else (r.row_id,)
    order = sorted(sizes, key=sizes.get)
    assert [r.row_id for b in range(7) for r in sorted(by_batch[b], key=lambda r: sizes[r.row_id])] == order
    with pytest.raises(ValueError, match="duplicate ids"):
        features.encode_batches(df.unionByName(df.limit(1)), vocab)


def test_rows_are_numbered_as_they_stand_in_the_files(spark, tmp_path):
    lines, paths = [], []
    for name, n in (("b.csv", 700), ("a.csv", 1), ("c.csv", 400), ("empty.csv", 0)):
        own = [f"{name}-{i}" for i in range(n)]
        (tmp_path / name).write_text("text,label\n" + "".join(f"{x} {'y' * (i % 50)},l\n" for i, x in enumerate(own)))
        lines += own
        paths.append(str(tmp_path / name))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several pieces a file, several pieces a task
    try:
        frame = read_labelled_csv(spark, paths)
        assert frame.rdd.getNumPartitions() > 5
        got = file_order_ids(frame, paths, str(tmp_path / "numbered"))
        rows = sorted((r.row_id, r.text.split()[0]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(enumerate(lines))


def test_folder_in_name_order(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("text"), F.lit("l").alias("label"))
    write_table_csv(df.repartitionByRange(4, F.col("text").cast("int")).sortWithinPartitions(F.col("text").cast("int")), f"{tmp_path}/csv")
    frame = read_labelled_csv(spark, [f"{tmp_path}/csv"])
    got = file_order_ids(frame, [f"{tmp_path}/csv"], f"{tmp_path}/numbered")
    assert all(r.row_id == int(r.text) for r in got.collect()) and got.count() == 200


RAW = [(1, " Good ", " Positive "), (2, None, "positive"), (3, "x", None), (4, "   ", "negative"), (5, "y", "weird"),
       (6, "z", "Zany"), (7, "fine", "NEUTRAL"), (8, None, None), (9, " ", "odd")]


def test_validation_in_the_pass_that_writes(spark, tmp_path):
    df = spark.createDataFrame(RAW, "row_id long, text string, label string").withColumn("language", F.lit("en")).repartition(3)
    checked = clean.clean_to_table(df, f"{tmp_path}/t", strict=False)
    assert checked.counts == {"rows": 9, "good": 2, "null_text": 2, "null_label": 1, "blank_text": 2, "unknown_label": 2}
    assert sorted((r.row_id, r.text, r.label) for r in checked.good.collect()) == [(1, "Good", "positive"), (7, "fine", "neutral")]
    kept = {r.row_id: (r.text, r.label, r.reject_reason) for r in checked.rejected.collect()}
    assert kept[5] == ("y", "weird", "unknown_label") and kept[4] == ("   ", "negative", "blank_text") and len(kept) == 7
    # the same rows as the two-pass loader
    want = clean.clean_labelled(df, strict=False).where(F.col("label").isin("negative", "neutral", "positive"))
    assert sorted(checked.good.select("row_id", "text", "label").collect()) == sorted(want.select("row_id", "text", "label").collect())
    with pytest.raises(ValueError, match="unsupported labels in 2 of 9 rows, such as 'Zany' and 'weird'"):
        clean.clean_to_table(df, f"{tmp_path}/strict")
    assert spark.read.parquet(f"{tmp_path}/strict").count() == 9  # there for inspection
    empty = clean.clean_to_table(df.limit(0), f"{tmp_path}/empty")
    assert empty.counts["rows"] == 0 and empty.good.collect() == []


def test_validation_reads_its_input_once(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.createDataFrame(RAW, "row_id long, text string, label string").coalesce(1).write.parquet(path)
    log = str(tmp_path / "log")
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        rows = list(rows)
        read.add(len(rows))
        return iter(rows)

    df = spark.createDataFrame(spark.read.parquet(path).rdd.mapPartitions(seen), "row_id long, text string, label string")
    checked = clean.clean_to_table(df, log, require=("text", "label"), strict=False)
    assert checked.good.count() == 2 and read.value == len(RAW)


def zipf_texts(n=400):
    pick = random.Random(6)
    return [(i, " ".join(f"w{min(int(pick.paretovariate(0.7)), 5000)}" for _ in range(30))) for i in range(n)]


def test_top_terms_by_threshold(spark):
    rows = zipf_texts()
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(12)
    counts = features.term_counts(df)
    total = collections.Counter(t for _, text in rows for t in brute_terms(text))
    df_of = collections.Counter(t for _, text in rows for t in set(brute_terms(text)))
    for k in (1, 25, 300, 10 ** 6):
        want = sorted(total, key=lambda t: (-total[t], t))[:k]
        for summary in (1 << 20, 200):
            got = vocabulary.top_terms(counts, k, summary).orderBy("rank").collect()
            assert [(r.term, r.tf_total, r.df) for r in got] == [(t, total[t], df_of[t]) for t in want]
    assert vocabulary.top_terms(counts.limit(0), 5).collect() == []


def test_threshold_shuffles_few_terms(spark, monkeypatch):
    """Rows that enter the three aggregates, against all (part, term) pairs."""
    df = spark.createDataFrame(zipf_texts(), "row_id long, text string").repartition(12)
    stored = {}
    real = vocabulary.store

    def spy(frame, name, **k):
        stored[name] = real(frame, name, **k)
        return stored[name]

    monkeypatch.setattr(vocabulary, "store", spy)
    k = 25
    top = vocabulary.top_terms(features.term_counts(df), k).collect()
    local = stored["local-counts"]
    reached = min(r.tf_total for r in top)
    survivors = [r.term for r in stored["candidates"].collect()]
    shuffled = local.where("top").count() + stored["candidates"].agg(F.sum("seen")).first()[0] + local.where(F.col("term").isin(survivors)).count()
    assert len(top) == k and reached > 12 and shuffled < local.count() / 3


def test_a_vocabulary_as_a_table(spark):
    rows = [(i, t) for i, t in enumerate(["The cat sat on the mat", "the dog sat", "a b c", None, "dog dog dog cat", "the the the"])]
    df = spark.createDataFrame(rows, "row_id long, text string")
    for k in (4, 1_000_000):
        table = vocabulary.fit_vocabulary(df, k)
        want = features.fit_tfidf(df, max_features=k)
        terms = {r.id: r for r in table.terms.collect()}
        assert [terms[i].term for i in range(len(terms))] == want.vocabulary and table.size == len(want.vocabulary)
        np.testing.assert_allclose([terms[i].idf for i in range(len(terms))], want.idf)
        ours = {(r.row_id, r.term): r.weight for r in vocabulary.tfidf_weights(df, table).collect()}
        theirs = {(r.row_id, r.term): r.weight for r in features.tfidf_of_texts(df, want).collect()}
        assert ours.keys() == theirs.keys()
        np.testing.assert_allclose([ours[x] for x in sorted(ours)], [theirs[x] for x in sorted(ours)])
        entries = {r.row_id: r.features for r in vocabulary.tfidf_entries(df, table).collect()}
        for row, f in entries.items():
            assert list(f.indices) == sorted(f.indices)
            assert {terms[i].term: round(v, 9) for i, v in zip(f.indices, f["values"], strict=True)} == {
                t: round(w, 9) for (r, t), w in ours.items() if r == row}


def test_a_classifier_on_a_vocabulary_table(spark):
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["good fine", "bad poor"] * 20)], "row_id long, text string, y int")
    table = vocabulary.fit_vocabulary(df, 1_000_000)
    rows = vocabulary.tfidf_entries(df, table).join(df.select("row_id", "y"), "row_id")
    blocks = stacked.feature_blocks(rows, table.size, 2, label_col="y")
    fit = stacked.fit_stacked(blocks, [stacked.Setting("a")])
    loss, pairs = stacked.evaluate_stacked(blocks, fit.weights())
    assert pairs[0].tolist() == [[20, 0], [0, 20]] and loss[0] < 0.5


def test_evaluated_stream_equals_the_batch(spark, tmp_path):
    texts = [("good fine", "positive"), ("bad poor", "negative"), ("so so", "neutral"), ("good poor", "negative"), ("fine", None),
             (" ", "neutral"), ("good", "odd")] * 6
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "row_id long, text string, label string")
    train = df.where("label in ('negative', 'neutral', 'positive')").withColumn("label_id", F.array_position(
        F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), F.col("label")).cast("int") - 1)
    from labelflow.operators.model import fit_classifier, predict

    model = fit_classifier(train)
    source, sink, ckpt = f"{tmp_path}/in", f"{tmp_path}/sink", f"{tmp_path}/ckpt"

    def batch_metrics(rows):
        counted = rows.where("label is not null and trim(text) <> ''")
        return evaluate.metrics_record(predict(model, counted, ["label"]).withColumn("model", F.lit("s"))).first()

    df.where("row_id < 20").repartition(3).write.parquet(source)
    counts = count_stream(spark, model, source, df.schema, sink, ckpt, max_files_per_trigger=1)
    assert stream_metrics(counts, "s").first() == batch_metrics(df.where("row_id < 20"))
    df.where("row_id >= 20").repartition(2).write.mode("append").parquet(source)
    counts = count_stream(spark, model, source, df.schema, sink, ckpt, max_files_per_trigger=1)  # goes on
    assert stream_metrics(counts, "s").first() == batch_metrics(df)
    before = sorted(counts.collect())
    assert "accuracy" in [r.row_name for r in stream_report(counts, "s").collect()]
    # a batch that is run again replaces its own folder
    latest = max(r.batch for r in spark.read.parquet(sink).collect())
    again = spark.createDataFrame(spark.read.parquet(f"{sink}/batch={latest}").collect())
    write_batch(again, latest, sink)
    assert sorted(stream_counts(spark, sink).collect()) == before
