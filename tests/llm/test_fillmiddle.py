import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelflow.llm import queries
from labelflow.llm.common import stored
from labelflow.llm.fillmiddle import CHUNK, arrange, op12_fill_middle, rebuild, restore, rotate, transform
from tests.conftest import SF001


def plain_python(doc_id, text):
    """The contract, on strings."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, "plain", n, None, None
    if h4 % 100 < 20:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", n, len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", n, len(prefix), len(middle)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 3 * CHUNK + 7])
def test_rotation_exchanges_neighbours(n):
    data = np.arange(n, dtype=np.int64)
    for cut in {0, 1, n // 3, n // 2, n} & set(range(n + 1)):
        got = data.copy()
        rotate(got, 0, cut, n)
        assert (got == np.concatenate([data[cut:], data[:cut]])).all()


@given(st.text(alphabet="ab Z<PSM>é\U0001f600\n1", max_size=40), st.integers(0, 500))
@settings(max_examples=600, deadline=None)
def test_arrange_and_rebuild(text, doc_id):
    output, form, n, prefix, middle = arrange(text.encode(), str(doc_id), 1, 10, 20)
    assert (output.decode(), form, n, prefix, middle) == plain_python(doc_id, text)
    assert rebuild(output, form).decode() == text


def test_every_row_equals_plain_python(spark, awkward, awkward_docs):
    sentinels = [(2_000_000 + i, t, "en", "s", 1, "clash", 0, "c") for i, t in enumerate(
        ["<P>", "a <S> b", "x<M", "<P<S", "M><P", "<" * 5000, "word " * 400_000])]
    docs = awkward_docs.unionByName(spark.createDataFrame(sentinels, awkward_docs.schema))
    # columns called like outputs, like inner names and unlike any identifier
    docs = docs.selectExpr("*", "1 as Form", "2 as output", "3 as _in0", "4 as `a.b`", "5 as restored", "6 as `key`")
    got = restore(transform(docs))
    assert got.columns == [*awkward_docs.columns, "_in0", "a.b", "key", "output", "form", "n_tokens", "prefix_chars",
                           "middle_chars", "restored"]
    rows = stored(got, "fim").collect()
    want = sorted((plain_python(r[0], r[1]) for r in [*awkward, *sentinels]), key=repr)
    assert sorted(((r.output, r.form, r.n_tokens, r.prefix_chars, r.middle_chars) for r in rows), key=repr) == want
    assert all(r.restored == (r.text or "") and r["a.b"] == 4 for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF001}/documents.parquet'")
    want = con.execute(queries.ORACLE["op12_fill_middle"]).fetchall()
    assert sorted(map(tuple, op12_fill_middle(spark, SF001).collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(no_docs):
    assert restore(transform(no_docs)).collect() == []
