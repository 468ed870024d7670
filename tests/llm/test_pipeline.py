import hashlib
import re

import corpus_pipeline as C
from labelflow.llm import packing, pii, quality, simhash
from labelflow.llm.common import stored
from tests.conftest import SF001
from tests.llm.test_simhash import brute_fingerprint, brute_roots
from tests.llm.test_substring import brute


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_stages_keep_the_columns(spark, awkward_docs, no_docs):
    for docs in (awkward_docs, no_docs):
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF001)
            if name != "packing":
                assert out.schema.names == docs.schema.names
                assert [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields]
            assert docs is awkward_docs or not out.collect()


def test_quality_stage_drops_what_is_rejected(spark, awkward_docs):
    verdicts = quality.rate(awkward_docs.select("doc_id", "text", "lang", "source")).where("kept")
    want = sorted(str((r.doc_id, r.text)) for r in verdicts.collect())
    got = C.quality_rules(spark, awkward_docs, SF001).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == want and 0 < len(want) < awkward_docs.count()


def test_near_dedup_stage_keeps_one_of_each_group(spark, awkward_docs, awkward):
    roots = brute_roots([brute_fingerprint(r[1]) for r in awkward], 2)
    best = {}
    for r, root in zip(awkward, roots):
        key = (r[0] is None, r[0] or 0)
        best[root] = min(best.get(root, (key, r[0])), (key, r[0]), key=lambda x: x[0])
    got = C.near_dedup(spark, awkward_docs, SF001).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for _, d in best.values())


def test_substring_stage_cuts_words(spark, awkward_docs, awkward):
    words, removed = brute([r[1] for r in awkward], 35)
    want = sorted(str((r[0], b" ".join(x for x, d in zip(w, g) if not d))) for r, w, g in zip(awkward, words, removed))
    got = C.substring_dedup(spark, awkward_docs, SF001).collect()
    assert sorted(str((r.doc_id, b" ".join((r.text or "").encode().split()))) for r in got) == want


def test_pii_stage_changes_texts_only(spark, awkward_docs):
    got = {(r.doc_id, r.text, r.lang) for r in C.private_data(spark, awkward_docs, SF001).collect()}
    want = {(r.doc_id, r.text, r.lang) for r in pii.pseudonymise(awkward_docs, C.PSEUDONYM_KEY).collect()}
    assert got == want


def test_run_equals_the_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = {r.doc_id for r in quality.op9_quality(spark, SF001).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    roots = brute_roots([brute_fingerprint(t) for _, t in rows], 2)
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    words, removed = brute([t for _, t in rows], 35)
    texts = {d: b" ".join(x for x, g in zip(w, gone) if not g).decode() for (d, _), w, gone in zip(rows, words, removed)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    private = {r.doc_id: r.text for r in pii.pseudonymise(frame, C.PSEUDONYM_KEY).collect()}
    end = [(d, re.sub(r"\s+", " ", t)) for d, t in private.items()]
    want = packing.pack_documents(spark.createDataFrame(end, "doc_id long, text string"),
                                  __import__("public_tokenizers").path("word_bpe_49k.json"), 2)
    run = stored(C.run(spark, SF001), "run")
    assert {(r.doc_id, r.doc_tokens) for r in run.collect()} == {(r.doc_id, r.doc_tokens) for r in want.collect()}
    assert run.agg({"length": "sum"}).first()[0] == want.agg({"length": "sum"}).first()[0]


def test_run_is_the_same_again(spark):
    def digest():
        parts = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in C.run(spark, SF001).collect())
        return hashlib.sha256(str(parts).encode()).hexdigest()

    assert digest() == digest()


def test_entry_has_the_queries():
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert simhash.op7_simhash is E.queries()["op7_simhash"]
