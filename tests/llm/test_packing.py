import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from labelflow.llm.packing import TIERS, op5_query, pack, pack_documents, step_groups

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def check_cover(lengths, sequences):
    pieces = defaultdict(list)
    for size, window in sequences:
        assert sum(length for _, _, length in window) == size
        assert size <= TIERS[-1] and (size in TIERS or size & (size - 1) == 0)
        for doc, start, length in window:
            pieces[doc].append((start, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, part in sorted(pieces[doc]):
            assert start == at and part > 0
            at += part
        assert at == length


@pytest.mark.parametrize("seed", range(6))
def test_pack_covers_all_without_padding(seed):
    pick = random.Random(seed)
    lengths = [min(20_000, max(1, int(pick.lognormvariate(5 + seed / 2, 1.2)))) for _ in range(pick.randrange(1, 400))]
    check_cover(lengths, pack(lengths))


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097], [512] * 9, [3] * 2000, [2049] * 5])
def test_pack_special_lengths(lengths):
    check_cover(lengths, pack(lengths))


def test_most_documents_stay_whole():
    pick = random.Random(1)
    lengths = [max(1, int(pick.lognormvariate(6, 0.9))) for _ in range(3000)]
    cut = defaultdict(int)
    for _, window in pack(lengths):
        for doc, _, _ in window:
            cut[doc] += 1
    short = [d for d, n in enumerate(lengths) if n <= 4096]
    assert sum(cut[d] == 1 for d in short) > 0.7 * len(short)


def test_step_groups_are_balanced():
    pick = random.Random(2)
    sequences = pack([pick.randrange(1, 6000) for _ in range(2000)])
    groups = step_groups(sequences, 1 << 15)
    tokens, sizes = defaultdict(int), defaultdict(set)
    for (size, _), g in zip(sequences, groups):
        tokens[g] += size
        sizes[g].add(size)
    assert all(len(s) == 1 for s in sizes.values())
    for size in TIERS:
        own = [tokens[g] for g in tokens if sizes[g] == {size}]
        assert not own or max(own) - min(own) <= size


def test_query_equals_the_library(awkward_docs, awkward, library):
    rows = op5_query(awkward_docs).collect()
    ids = defaultdict(list)
    for r in awkward:
        ids[r[0]].append(library.encode(r[1] or "", add_special_tokens=False).ids + [2])
    places, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(struct.pack(
            f"<{r.length}I", *x[r.start:r.start + r.length])) == r.ids_crc32 for x in ids[r.doc_id])
        places[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
        covered[r.doc_id] += r.length
    assert covered == {d: sum(map(len, x)) for d, x in ids.items()}
    for spots in places.values():
        at = 0
        for offset, length, _ in sorted(spots):
            assert offset == at
            at += length
        assert at == spots[0][2]


def test_pools_are_bounded(awkward_docs, library):
    rows = pack_documents(awkward_docs.coalesce(1), FILE, 2, pool_tokens=2000).collect()
    sizes = defaultdict(int)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sizes[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def test_empty_table(no_docs):
    assert op5_query(no_docs).collect() == []
