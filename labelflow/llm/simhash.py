"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are dealt to blocks by the leading bits of their Gray
rank, so a block is a run of the Gray order. A fingerprint also visits the
blocks whose leading bits differ from its own in at most ``max_bits`` places;
no other block can hold a partner. A block with many members or visitors is cut
into cells, each a slice of both, so no task holds a block whole. Within a cell the members are sorted by
Gray rank, and every run of eight nodes is factored: bits on which all members
agree move into the node above as a masked pattern. A search walks the levels,
adds up the differences on each node's own masked bits, and drops a whole
group as soon as its sum exceeds ``max_bits``; at the members the sum is the
exact distance. A block returns a spanning forest of its links, never its
pairs, and the links' connected components are the near-duplicate groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship, stored
from .components import components

BITS = 64
FAN_OUT = 8
#: Members of a block on average; the number of leading bits follows from it.
BLOCK_MEMBERS = 1024
#: A block with more members, or with more visitors, is searched in cells: each holds a slice of both.
SLICE_MEMBERS = 8192
#: Visitors of a cell for each of its members; they are walked through the tree in chunks.
VISITORS_PER_MEMBER = 4
#: Queries walked through the tree at once.
QUERY_CHUNK = 1024


def fingerprint(text: str | None, shingle_words: int, seed: int) -> int:
    """Majority bits of the hashes of all word shingles, repeats included.

    ASCII letters are lowered; fewer words than a shingle make one shingle;
    no word, an empty or a null text give zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle_words:
        hashes = [xxh64_intdigest(line, seed)]
    else:
        starts = [0, *ends]
        hashes = [xxh64_intdigest(line[a:b - 1], seed)
                  for a, b in zip(starts, ends[shingle_words - 1:], strict=False)]
    packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(packed), 1 << 14):
        counts += np.unpackbits(packed[lo:lo + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle_words: int, seed: int) -> DataFrame:
    """``key``, ``fp`` (the fingerprint's 64 bits as a long) for every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_type = to_arrow_type(source.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(v.as_py(), shingle_words, seed) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(key_type), pa.array(np.array(values, np.uint64).view(np.int64))],
                names=["key", "fp"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Levels of masked patterns over members in Gray order, root level first."""

    def __init__(self, members: np.ndarray):
        self.members = members[np.argsort(gray_rank(members), kind="stable")]
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        shared, pattern = [np.full(len(members), ones)], [self.members]
        while len(pattern[-1]) > FAN_OUT:
            runs = np.arange(0, len(pattern[-1]), FAN_OUT)
            both = np.bitwise_and.reduceat(pattern[-1], runs)
            any_of = np.bitwise_or.reduceat(pattern[-1], runs)
            same = np.bitwise_and.reduceat(shared[-1], runs) & ~(both ^ any_of)
            shared.append(same)
            pattern.append(both & same)
        self.levels = []
        for depth in range(len(pattern) - 1, -1, -1):
            own = shared[depth]
            if depth + 1 < len(shared):  # bits that the node above has factored out
                own = own & ~np.repeat(shared[depth + 1], FAN_OUT)[:len(own)]
            self.levels.append((pattern[depth], own))

    def search(self, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query number and member number at most ``max_bits`` apart."""
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        differences = np.zeros(len(q), np.int64)
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                q, differences = np.repeat(q, FAN_OUT), np.repeat(differences, FAN_OUT)
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                inside = node < len(pattern)
                q, node, differences = q[inside], node[inside], differences[inside]
            differences = differences + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            near = differences <= max_bits
            q, node, differences = q[near], node[near], differences[near]
        return q, node


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node linked with each of ``n`` nodes, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def block_links(members: np.ndarray, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a block's queries and members."""
    index = GrayIndex(members)
    values = np.unique(np.concatenate([members, queries]))
    place = np.searchsorted(values, index.members)
    label = np.arange(len(values))
    for lo in range(0, len(queries), QUERY_CHUNK):
        chunk = queries[lo:lo + QUERY_CHUNK]
        q, m = index.search(chunk, max_bits)
        a, b = np.searchsorted(values, chunk[q]), place[m]
        linked = a != b
        # what earlier chunks have joined stays joined
        label = forest(np.concatenate([a[linked], np.arange(len(values))]),
                       np.concatenate([b[linked], label]), len(values))
    joined = np.flatnonzero(label != np.arange(len(values)))
    return values[joined], values[label[joined]]


def links(classes: DataFrame, max_bits: int, block_members: int = BLOCK_MEMBERS,
          slice_members: int = SLICE_MEMBERS) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``fp`` within ``max_bits`` of each other."""
    ship(classes.sparkSession)
    total = classes.count()
    prefix_bits = min(24, max(5, math.ceil(math.log2(max(1, total) / block_members)) if total else 0))
    masks = [sum(1 << i for i in flips) for k in range(max_bits + 1) for flips in combinations(range(prefix_bits), k)]
    prefix = F.shiftrightunsigned("fp", BITS - prefix_bits)
    placed = classes.select("fp", prefix.alias("block"))
    sizes = stored(placed.groupBy("block").agg(F.count("*").alias("members")), "block-sizes")
    # each pair of blocks meets once: the fingerprint of the lower block visits the higher one
    visits = F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                                  lambda m: F.col("block").bitwiseXOR(m)), lambda b: b >= F.col("block"))
    visitors = (sizes.select(F.explode(visits).alias("block"), "members")
                .groupBy("block").agg(F.sum("members").alias("visitors")))
    cells = sizes.join(visitors, "block").select(
        "block", F.ceil(F.col("members") / slice_members).cast("int").alias("member_slices"),
        F.ceil(F.col("visitors") / (slice_members * VISITORS_PER_MEMBER)).cast("int").alias("query_slices"))

    def one_of(slices: str) -> Column:
        return F.pmod(F.xxhash64("fp"), slices).cast("int")

    def all_of(slices: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(slices) - 1))

    queries = (placed.select("fp", F.explode(visits).alias("block")).join(cells, "block")
               .select("block", one_of("query_slices").alias("query_slice"),
                       all_of("member_slices").alias("member_slice"), "fp", F.lit(False).alias("member")))
    members = placed.join(cells, "block").select(
        "block", all_of("query_slices").alias("query_slice"), one_of("member_slices").alias("member_slice"), "fp",
        F.lit(True).alias("member"))

    def run(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        is_member = table.column("member").to_numpy()
        a, b = block_links(values[is_member], values[~is_member], max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return queries.unionByName(members).groupBy("block", "query_slice", "member_slice").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle_words: int, max_bits: int, key: str = "doc_id", text: str = "text",
                    seed: int = 42) -> DataFrame:
    """``key``, ``fp`` (long), ``component`` (smallest key reachable) for every row.

    Exact copies share a fingerprint and enter the index once. Repeated rows
    each get a row; a null key is ignored when a component's smallest key is
    taken (null if it has no other); a null, empty or blank text has the zero
    fingerprint, linked like any other; an empty table gives an empty table."""
    rows = stored(fingerprints(docs, key, text, shingle_words, seed), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("key").alias("smallest")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), max_bits))
    rooted = (classes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "smallest", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component"))
    labels = rooted.join(named, "root").select("fp", "component")
    return rows.join(labels, "fp").select(F.col("key").alias(key), "fp", "component")


def op7_query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, shingle_words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return op7_query(read_table(spark, sf_dir, "documents"))
