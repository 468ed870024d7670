import math
import re
from collections import Counter

import duckdb
import pytest

from labelflow.llm import lexical, queries
from labelflow.llm.lexical import op11_ranking, rank, term_counts
from tests.conftest import SF001

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id long, score string, rank int, term string"


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, k=10):
    """The contract, document by document."""
    held = [(i, c, c.total()) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked, scored = terms(text), []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(r * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, place + 1, s[3], -s[0]) for place, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def awkward_items():
    bench = [(i, f"again passage{i} w{i}x{i % 31} THE of {' the' * i}") for i in range(12)]
    return bench + [(20, None), (21, ""), (22, "zzzqq, qqzz0"), (23, "passage1 passage1 passage2"), (None, "words two"),
                    (24, "same text here"), (24, "same text here"), (25, "naïve İstanbul ΣΑΣ é* 12,3"), (26, "text " * 3000)]


@pytest.fixture(scope="module")
def item_frame(spark):
    return spark.createDataFrame([(*r, 1, "clash", 2, "t") for r in awkward_items()], ITEMS)


@pytest.mark.parametrize("options", [{}, {"vocabulary_bytes": 0}, {"block_bytes": 2000, "group_bytes": 300}])
def test_equals_brute_force(awkward, awkward_docs, item_frame, options):
    got = rank(awkward_docs, item_frame, 10, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute([(r[0], r[1]) for r in awkward], awkward_items())
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[0] for r in want} >= {24, 25, 26, None} and not {r[0] for r in want} & {20, 21, 22}


def test_copies_are_one_class_and_come_by_id(spark):
    docs = [(1000 - i, "a b c" if i % 3 else "a b b") for i in range(400)] + [(5, "c"), (None, "a b c"), (7, "a b c"), (7, "a b c")]
    items = [(1, "a"), (2, "b b c"), (3, "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    got = rank(frame, spark.createDataFrame(items, "item_id long, text string"), 10)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == brute(docs, items)
    assert [r[2] for r in sorted(r for r in rows if r[0] == 3)][:3] == [5, 7, 7]


def test_slices_cut_between_terms(monkeypatch):
    text = ("Word, " * 50 + "x" * 300 + " ÄÖ é-é " * 20 + "end").encode()
    whole = term_counts(text)
    for size in (1, 7, 64):
        monkeypatch.setattr(lexical, "SLICE_BYTES", size)
        assert term_counts(text) == whole
    assert {t.decode(): n for t, n in whole.items()} == terms(text.decode())


def test_products_beyond_64_bits(spark):
    """75 * n * N is taken in decimals: m depends on the quotient alone."""
    rows = spark.sql("select 25 + (cast(9000000000000000 as decimal(19, 0)) * 75000000000BD) div 30000000000000000BD as m")
    assert rows.first()["m"] == 25 + 9 * 10 ** 15 * 75 * 10 ** 9 // (3 * 10 ** 16)


def test_oracle(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF001}/{name}.parquet'")
    want = con.execute(queries.ORACLE["op11_ranking"]).fetchall()
    assert sorted(map(tuple, op11_ranking(spark, SF001).collect())) == sorted(want)


def test_empty_tables(spark, awkward_docs, no_docs, item_frame):
    assert rank(no_docs, item_frame, 10).collect() == []
    assert rank(awkward_docs, item_frame.limit(0), 10).collect() == []
