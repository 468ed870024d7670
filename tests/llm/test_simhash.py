import random

import numpy as np
import pytest
import xxhash

from labelflow.llm import simhash
from labelflow.llm.components import components
from labelflow.llm.simhash import GrayIndex, block_links, gray_rank, links, near_duplicates, op7_query


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, max_bits):
    """Number of the first value that each is connected with."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= max_bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clustered(seed, n):
    pick = random.Random(seed)
    values = set()
    while len(values) < n:
        center = pick.getrandbits(64) if not values or pick.random() < 0.2 else pick.choice(sorted(values))
        for _ in range(pick.randrange(3)):
            center ^= 1 << pick.randrange(64)
        values.add(center)
    return sorted(values)


def test_gray_rank_inverts_the_gray_code():
    ranks = np.arange(5000, dtype=np.uint64)
    assert (gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 500])
def test_index_finds_all_pairs(n):
    members = np.array(clustered(n, n), np.uint64)
    queries = np.concatenate([members, np.array(clustered(n + 1, 20), np.uint64)])
    index = GrayIndex(members)
    q, m = index.search(queries, 3)
    got = set(zip(queries[q].tolist(), index.members[m].tolist()))
    want = {(a, b) for a in queries.tolist() for b in members.tolist() if bin(a ^ b).count("1") <= 3}
    assert got == want and len(q) == len(want)


def test_block_links_connect_like_all_pairs():
    values = np.array(clustered(3, 300), np.uint64)
    a, b = block_links(values, values[:0], 2)
    assert len(a) == 0
    a, b = block_links(values, values, 2)
    joined = {v: v for v in values.tolist()}
    joined.update(zip(a.tolist(), b.tolist()))
    roots = brute_roots(values.tolist(), 2)
    for i, v in enumerate(values.tolist()):
        assert joined[v] == values[roots[i]]


@pytest.mark.parametrize(("block", "slice_members"), [(1024, 8192), (4, 8192), (64, 3)])
def test_links_of_all_blocks(spark, block, slice_members):
    values = clustered(11, 400)
    rows = [(int(np.uint64(v).view(np.int64)),) for v in values]
    found = links(spark.createDataFrame(rows, "fp long"), 2, block, slice_members)
    root = {r.node: r.root for r in components(found).collect()}
    signed = [r[0] for r in rows]
    want = brute_roots(values, 2)
    groups, mine = {}, {}
    for i, v in enumerate(signed):
        groups.setdefault(want[i], set()).add(v)
        mine.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("slice_members", [16, 8192])
def test_a_hot_block_is_cut_into_cells(spark, slice_members, monkeypatch):
    """All fingerprints share their leading bits, and no call gets more than a slice of members and visitors."""
    values = sorted({v >> 24 for v in clustered(4, 600)})
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    whole = simhash.block_links

    def bounded(members, queries, max_bits):
        if len(members) > 3 * slice_members or len(queries) > 3 * simhash.VISITORS_PER_MEMBER * slice_members:
            raise AssertionError(f"{len(members)} members, {len(queries)} visitors in one call")
        return whole(members, queries, max_bits)

    monkeypatch.setattr(simhash, "block_links", bounded)
    found = links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, 64, slice_members).collect()
    root = {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = brute_roots(values, 2)
    theirs, mine = {}, {}
    for i, v in enumerate(signed):
        theirs.setdefault(want[i], set()).add(v)
        mine.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, theirs.values())) == sorted(map(sorted, mine.values()))


def test_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_equals_brute_force(awkward_docs, awkward):
    rows = op7_query(awkward_docs).collect()
    prints = [brute_fingerprint(r[1]) for r in awkward]
    roots = brute_roots(prints, 2)
    smallest = {}
    for r, root in zip(awkward, roots):
        if r[0] is not None:
            smallest[root] = min(r[0], smallest.get(root, r[0]))
    want = sorted(str((r[0], f"{p:016x}", smallest.get(root))) for r, p, root in zip(awkward, prints, roots))
    assert sorted(str(tuple(r)) for r in rows) == want


def test_empty_table(no_docs):
    assert near_duplicates(no_docs, 3, 2).collect() == []
