import pytest
from pyspark.sql import functions as F

from labelflow.operators import clean
from labelflow.sources.labelled import read_labelled_csv


def _csv(tmp_dir, body, name="in.csv"):
    p = f"{tmp_dir}/{name}"
    with open(p, "w", encoding="utf-8") as f:
        f.write(body)
    return p


def test_csv_quotes_na_and_bom(spark, tmp_dir):
    body = ('﻿text,language,label\n"hello, world",de,Positive \nNA,ru,negative\nnull,ru,neutral\n'
            ',de,neutral\n"    ",de,neutral\n"Good one",ru, NEUTRAL\n"x",de,unknown\n')
    df = read_labelled_csv(spark, [_csv(tmp_dir, body)], required=("text", "language", "label"))
    assert df.columns == ["text", "language", "label"]
    lenient = clean.clean_labelled(df, strict=False)
    rows = sorted((r.text, r.label) for r in lenient.collect())
    assert rows == [("Good one", "neutral"), ("hello, world", "positive"), ("x", "unknown")]
    with pytest.raises(ValueError, match="unknown"):
        clean.clean_labelled(df)
    enc = clean.label_encode(lenient).where(F.col("label") == "unknown").first()
    assert enc.label_id is None


def test_missing_column(spark, tmp_dir):
    p = _csv(tmp_dir, "text,label\nhi,positive\n")
    with pytest.raises(ValueError, match="language"):
        read_labelled_csv(spark, [p], required=("text", "language", "label"))
    df = read_labelled_csv(spark, [p])
    assert clean.clean_labelled(df, require=("text", "label")).count() == 1


def test_missing_file_raises(spark, tmp_dir):
    with pytest.raises(Exception):
        read_labelled_csv(spark, [f"{tmp_dir}/absent.csv"]).count()


def test_encode_decode_roundtrip(spark):
    df = spark.createDataFrame([("negative",), ("neutral",), ("positive",), ("other",)], "label string")
    out = clean.label_decode(clean.label_encode(df), out="back").collect()
    assert [r.label_id for r in out] == [0, 1, 2, None]
    assert [r.back for r in out] == ["negative", "neutral", "positive", None]


def test_freeze_row_ids(spark, tmp_dir):
    from labelflow.sources.labelled import freeze_row_ids

    p = _csv(tmp_dir, "text,label\na,positive\nb,negative\nc,neutral\n")
    frozen = freeze_row_ids(read_labelled_csv(spark, [p]), f"{tmp_dir}/frozen")
    rows = frozen.orderBy("row_id").collect()
    assert [r.text for r in rows] == ["a", "b", "c"]
    again = spark.read.parquet(f"{tmp_dir}/frozen").orderBy("row_id").collect()
    assert [r.row_id for r in again] == [r.row_id for r in rows]


def test_lines_with_other_field_counts(spark, tmp_dir):
    body = "text,label\nfine,positive\nan unquoted, comma,negative\nshort\n"
    with pytest.raises(Exception, match="(?i)malformed"):
        read_labelled_csv(spark, [_csv(tmp_dir, body)]).collect()
    rows = read_labelled_csv(spark, [_csv(tmp_dir, body)], quarantine=True).collect()
    assert [r.text for r in rows if r.corrupt_record is None] == ["fine"]
    assert sorted(r.corrupt_record for r in rows if r.corrupt_record) == ["an unquoted, comma,negative", "short"]


def test_strict_error_says_how_many_labels_are_left_out(spark):
    df = spark.createDataFrame([(f"odd{i:02d}",) for i in range(30)], "label string")
    with pytest.raises(ValueError, match="odd00.*and 10 more"):
        clean.check_labels(df)
    with pytest.raises(ValueError, match=r"\['odd00', 'odd01'\]$"):
        clean.check_labels(df.where("label < 'odd02'"))
