"""The driver contract: entry() on sf0.001, queries() / oracle_sql() keys."""

import __spark_entry__ as E


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if not (k.startswith("op") or k == "pipeline")}
    assert len(own) == 83 and len(own & set(o)) == 81


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "row_name", "row_idx", "precision", "recall", "f1_score", "support"]
    assert [r.row_name for r in sorted(rows, key=lambda r: r.row_idx)] == [
        "negative", "neutral", "positive", "accuracy", "macro avg", "weighted avg"]
