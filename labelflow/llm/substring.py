"""Removal of repeated passages through difference-cover anchors.

A perfect difference cover D modulo p has, for any two positions i and j, a
shift d < p with i + d and j + d both in D (mod p). Anchors are windows of
``width - p + 1`` words that start at cover positions, so two equal windows of
``width`` words always share an aligned anchor, though only |D| of p positions
are hashed. A passage is then extended around the anchors that occur twice:
every full window that contains one is hashed, and is repeated exactly if its
hash occurs anywhere else.

Documents are dealt to blocks of bounded size by a hash. A block sends each of
its distinct hashes once, in sorted arrays by hash range, and gets back one bit
per hash. So a passage that a third of all documents share costs a range as
many entries as there are blocks, never one per copy, and no pairs are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, blocks_for, read_table, ship, text_bytes
from .textscan import WINDOW_BASES, Words, string_buffers, window_hashes

#: Perfect difference covers: for a period, the cover positions (fixed values).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Text bytes of a block, the unit one Python call holds (its arrays take some 20 times that).
#: Larger blocks send fewer and longer arrays; raise it where executors have more memory.
BLOCK_BYTES = 2 << 20
#: Blocks for each hash range.
BLOCKS_PER_RANGE = 2


class BlockText:
    """The words of one block, with anchors and windows of every document."""

    def __init__(self, texts: pa.ChunkedArray, width: int, period: int):
        self.data, offsets = string_buffers(texts)
        self.words = Words(self.data, offsets)
        self.hashes = self.words.hashes()
        self.first = self.words.first
        self.counts = np.diff(self.first)
        self.width, self.period = width, period
        self.doc_of = np.repeat(np.arange(len(self.counts)), self.counts)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of the anchors and their hashes."""
        anchor_width = self.width - self.period + 1
        at = np.arange(len(self.hashes)) - self.first[:-1][self.doc_of]
        covered = np.zeros(self.period, bool)
        covered[list(COVERS[self.period])] = True
        length = self.counts[self.doc_of]
        position = np.flatnonzero(covered[at % self.period] & (at + anchor_width <= length) & (length >= self.width))
        return position, window_hashes(self.hashes, anchor_width, position, WINDOW_BASES[0])

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Positions of the windows that contain one of the anchors at ``shared``."""
        doc = self.doc_of[shared]
        lowest = np.maximum(shared - self.period + 1, self.first[doc])
        highest = np.minimum(shared, self.first[doc] + self.counts[doc] - self.width)
        return np.flatnonzero(self.cover(lowest, highest + 1))

    def cover(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words lie in any of the ranges."""
        edges = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, ends, -1)
        return np.cumsum(edges)[:-1] > 0

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each full window."""
        return (window_hashes(self.hashes, self.width, at, WINDOW_BASES[0]),
                window_hashes(self.hashes, self.width, at, WINDOW_BASES[1]).astype(np.uint32))


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hash pairs in order, whether each occurs twice, and every entry's place among them."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return a[heads], b[heads], np.diff(np.append(heads, len(a))) > 1, place


def ranges_of(hashes: np.ndarray, n_ranges: int) -> np.ndarray:
    """Borders of the hash ranges in a sorted array."""
    of = ((hashes >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(n_ranges + 1, dtype=np.uint64))


def sent(block: int, stage: int, hashes: tuple[np.ndarray, np.ndarray], n_ranges: int) -> pa.Table:
    """One row per hash range with the block's distinct hashes of that range."""
    first, second, repeated, _ = distinct(*hashes)
    borders = ranges_of(first, n_ranges)
    rows = [(r, block, stage, first[lo:hi].tobytes(), second[lo:hi].tobytes(), np.packbits(repeated[lo:hi]).tobytes())
            for r, (lo, hi) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if hi > lo]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(SENT)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, SENT, strict=True)], names=[n for n, _ in SENT])


SENT = (("range", pa.int32()), ("block", pa.int32()), ("stage", pa.int32()), ("first", pa.binary()),
        ("second", pa.binary()), ("repeated", pa.binary()))
SENT_SCHEMA = "range int, block int, stage int, first binary, second binary, repeated binary"
SHARED_SCHEMA = "range int, block int, stage int, shared binary"


def shared_hashes(table: pa.Table) -> pa.Table:
    """Of one hash range: for each block a bit per hash, set if the hash occurs anywhere else."""
    first = [np.frombuffer(x, np.uint64) for x in table.column("first").to_pylist()]
    second = [np.frombuffer(x, np.uint32) for x in table.column("second").to_pylist()]
    repeated = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(f)).astype(bool)
                for x, f in zip(table.column("repeated").to_pylist(), first, strict=True)]
    _, _, many, place = distinct(np.concatenate(first), np.concatenate(second))
    shared = many[place] | np.concatenate(repeated)
    bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum([len(f) for f in first])[:-1])]
    return table.select(["range", "block", "stage"]).append_column("shared", pa.array(bits, pa.binary()))


def answer(replies: pa.Table, stage: int, hashes: tuple[np.ndarray, np.ndarray], n_ranges: int) -> np.ndarray:
    """For each entry of ``hashes`` whether it occurs anywhere else."""
    first, _, _, place = distinct(*hashes)
    borders = ranges_of(first, n_ranges)
    shared = np.zeros(len(first), bool)
    for row in replies.to_pylist():
        if row["stage"] == stage:
            lo, hi = borders[row["range"]], borders[row["range"] + 1]
            shared[lo:hi] = np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=hi - lo)
    return shared[place]


def kept_text(words: Words, doc: int, removed: np.ndarray, one_space: bool) -> str:
    """A document without its removed words: the kept ones joined by a space,
    or the text as it stood with each removed run cut out up to the next word."""
    lo, hi = words.first[doc], words.first[doc + 1]
    gone = removed[lo:hi]
    begin, end = int(words.doc_start[doc]), int(words.doc_start[doc + 1])
    raw = words.data[begin:end].tobytes()
    if one_space:
        kept = raw.split()
        if gone.any():
            kept = [w for w, drop in zip(kept, gone, strict=True) if not drop]
        return b" ".join(kept).decode()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    parts, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        parts.append(raw[at:int(words.starts[lo + a]) - begin])
        at = int(words.starts[lo + b]) - begin if lo + b < hi else end - begin
    parts.append(raw[at:])
    return b"".join(parts).decode()


def remove_repeats(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id", period: int = 21,
                   one_space: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs``, ``text`` without its repeated passages, plus
    ``n_words`` and ``n_removed``.

    A word goes if a window of ``width`` consecutive words that covers it also
    starts at any other place, in the same or another document; every
    occurrence goes, and windows are judged on the input. Repeated rows are
    occurrences of each other. A null text has no words and stays null (empty
    with ``one_space``); a text shorter than the window stays as it is; an
    empty table gives an empty table. Input columns called ``n_words`` or
    ``n_removed`` are replaced."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    place, owner = kept.index(text), kept.index(key)
    # plain names on the way, whatever the columns are called
    docs = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(kept)])
    total = docs.agg(F.sum(text_bytes(f"c{place}")).alias("b")).first()["b"]
    n_blocks = blocks_for(total, block_bytes)
    n_ranges = max(1, n_blocks // BLOCKS_PER_RANGE)
    names = docs.columns
    blocks = docs.withColumn("block", block_of(F.xxhash64(F.col(f"c{owner}").cast("string"), F.col(f"c{place}")), n_blocks))

    def anchor_hashes(block: BlockText) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        position, hashes = block.anchors()
        return position, (hashes, np.zeros(len(hashes), np.uint32))

    def find_windows(block: BlockText, replies: pa.Table) -> np.ndarray:
        position, hashes = anchor_hashes(block)
        return block.candidates(position[answer(replies, 1, hashes, n_ranges)])

    def send_anchors(table: pa.Table) -> pa.Table:
        block = BlockText(table.column(place), width, period)
        return sent(table.column("block")[0].as_py(), 1, anchor_hashes(block)[1], n_ranges)

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent(0, 2, (np.empty(0, np.uint64), np.empty(0, np.uint32)), n_ranges)
        block = BlockText(table.column(place), width, period)
        return sent(table.column("block")[0].as_py(), 2, block.windows(find_windows(block, replies)), n_ranges)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = BlockText(table.column(place), width, period)
        at = find_windows(block, replies)
        at = at[answer(replies, 2, block.windows(at), n_ranges)]
        removed = block.cover(at, at + width)
        sums = np.concatenate([[0], np.cumsum(removed)])
        n_removed = sums[block.first[1:]] - sums[block.first[:-1]]
        old = table.column(place)
        texts = [(old[i].as_py() if not one_space and (not n_removed[i] or not old[i].is_valid)
                  else kept_text(block.words, i, removed, one_space)) for i in range(table.num_rows)]
        columns = [table.column(i) for i in range(len(names))]
        columns[place] = pa.array(texts, pa.string())
        return pa.table([*columns, pa.array(block.counts, pa.int64()), pa.array(n_removed, pa.int64())],
                        names=[*names, "n_words", "n_removed"])

    anchors = blocks.groupBy("block").applyInArrow(send_anchors, SENT_SCHEMA)
    anchor_replies = anchors.groupBy("range").applyInArrow(shared_hashes, SHARED_SCHEMA)
    windows = blocks.groupBy("block").cogroup(anchor_replies.groupBy("block")).applyInArrow(send_windows, SENT_SCHEMA)
    window_replies = windows.groupBy("range").applyInArrow(shared_hashes, SHARED_SCHEMA)
    replies = anchor_replies.unionByName(window_replies)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + ["n_words bigint", "n_removed bigint"])
    done = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cut, schema)
    return done.toDF(*kept, "n_words", "n_removed")


def op2_query(docs: DataFrame) -> DataFrame:
    cut = remove_repeats(docs.select("doc_id", "text"), width=35, one_space=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_substring(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words that occur elsewhere."""
    return op2_query(read_table(spark, sf_dir, "documents"))


SUBSTRING_SQL = """
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws
  from documents
), windows as (
  select r, i, array_to_string(ws[i:i + 34], ' ') as w
  from (select r, ws, unnest(range(1, len(ws) - 33)) as i from docs where len(ws) >= 35)
), repeated as (
  select w from windows group by w having count(*) > 1
), gone as (
  select r, list(distinct k) as ks
  from (select r, unnest(range(i, i + 35)) as k from windows semi join repeated using (w)) group by r
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(ks), 0) as bigint) as n_removed,
       sha256(array_to_string(case when ks is null then ws else list_filter(ws, lambda x, i: not list_contains(ks, i)) end,
                              ' ')) as kept_sha256
from docs left join gone using (r)
"""
