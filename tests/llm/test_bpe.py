import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from labelflow.llm.bpe import codec, encode, op3_bpe
from tests.conftest import SF001

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_equals_the_library(awkward_docs, awkward, library):
    rows = encode(awkward_docs, FILE, P.PATTERN, decode=True).collect()
    got = sorted((str(r.doc_id), r.text or "", bytes(r.ids), bytes(r.decoded)) for r in rows)
    want = sorted((str(r[0]), r[1] or "", as_bytes(library.encode_ordinary(r[1] or "")), (r[1] or "").encode())
                  for r in awkward)
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_tree_on_long_matches(library, seed):
    pick = random.Random(seed)
    alphabet = ["a", "ab", "the", "x", "ing", "é", "qz"][:seed + 3]
    own = codec(FILE, P.PATTERN)
    for length in (1, 7, 33, 64, 65, 500, 5000):
        text = "".join(pick.choice(alphabet) for _ in range(length))
        assert own.encode(text) == as_bytes(library.encode_ordinary(text))
        assert own.decode(own.encode(text)).decode() == text


def test_join_of_any_split(library):
    own = codec(FILE, P.PATTERN)
    piece = b"internationalisationalismwithoutspacesandmore"
    whole = own.merge(piece)
    for cut in range(len(piece) + 1):
        assert own.join(own.merge(piece[:cut]), own.merge(piece[cut:])) == whole


def test_query(spark, library):
    rows = op3_bpe(spark, SF001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(as_bytes(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(no_docs):
    frame = encode(no_docs, FILE, P.PATTERN)
    assert frame.collect() == [] and frame.columns == [c for c in no_docs.columns if c != "ids"] + ["ids"]
