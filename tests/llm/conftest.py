"""Documents of the test data with awkward rows added."""

import pandas as pd
import pytest

from tests.conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_words long, component string"


def awkward_rows():
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = [
        None, "", " \t\n\x0b ", "one", "two words", "three little words", passage, "before it " + passage,
        passage + " after", passage.upper(), words, words, "same text here", "same text here", "same text here",
        "x" * 5000, "İstanbul ΣΑΣ naïve é* 12,3 it's ‖ 　end", "a\n a\n\na\n", "tab\tand\x0cfeed",
        " ".join(["again and again"] * 40), "\U0001f600 \U0001f600\U0001f600 é",
    ]
    rows = [(1_000_000 + i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None, "clash", i, "c")
            for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id", "en", "s", 5, "clash", 1, "c"), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward():
    """Pandas frame: all documents of sf0.001 and the awkward rows."""
    docs = pd.read_parquet(f"{SF001}/documents.parquet")
    rows = [(int(d), t, lang, s, int(n), "clash", 0, "c") for d, t, lang, s, n in
            docs[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)]
    return rows + awkward_rows()


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    """The same rows as a stored table (columns clash with operators' outputs)."""
    from labelflow.llm.common import stored

    return stored(spark.createDataFrame(awkward, SCHEMA).repartition(5, "text"), "awkward")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
