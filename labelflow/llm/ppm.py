"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to ``order`` bytes, pretrained on
the training documents. A byte is coded in the longest context that training
has seen; a context that has not seen the byte pays an escape (method D: each
distinct byte seen there gives half a count to it) and hands over to the next
shorter one, where the bytes already ruled out are excluded. Below the empty
context all remaining bytes are equally likely. A document's score is the log10
probability of its bytes, ASCII letters lowered, and of its end.

A byte's code length depends on the (context, byte) string alone, so every
distinct string is scored once. Documents are dealt to blocks of bounded size;
a block sends its distinct strings and words with their training counts, in
sorted arrays by range, and gets back one number for each. Counts are summed
by range; the trie is then cut by the last two context bytes, below which all
contexts of order two and more are complete in one part, and the orders one and
zero come from one table of at most 65,536 byte pairs. A pair of bytes that
ends very many contexts is cut by the byte before it as well; the order-two
counts of such pairs are added up beforehand and given to all their parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, blocks_for, read_table, ship, text_bytes
from .textscan import Words, lowered, mix, slices, string_buffers

ORDER = 5
#: Text bytes of a block, the unit one Python call holds; larger blocks send fewer strings in all.
BLOCK_BYTES = 10 << 20
#: Bytes whose contexts are looked at together.
SLICE_BYTES = 1 << 19
#: Occurrences from which a pair of last context bytes is cut by the byte before it.
HOT_PAIR = 8 << 20
#: Key of the token that ends every document.
END = np.zeros(1, np.uint64)
WORDS, STRINGS = 1, 2

SENT_SCHEMA = "kind int, range int, block int, keys binary, counts binary"
REPLY_SCHEMA = "kind int, range int, block int, numbers binary, total bigint, distinct bigint"


def contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte and end of the documents the string of ``order`` bytes
    before it and itself, as a number; zero bytes stand before a document and
    as its end."""
    lengths = np.diff(offsets)
    pad = order + 1
    buffer = np.zeros(len(data) + pad * len(lengths), np.uint64)
    text = np.arange(len(data)) + np.repeat(pad * np.arange(len(lengths)) + order, lengths)
    buffer[text] = data
    keep = np.ones(len(buffer), bool)
    heads = offsets[:-1] - offsets[0] + pad * np.arange(len(lengths))
    for i in range(order):
        keep[heads + i] = False
    strings = buffer.copy()
    for back in range(1, order + 1):
        strings[back:] |= buffer[:-back] << np.uint64(8 * back)
    return strings[keep]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


class BlockText:
    """A block's documents, read in slices: distinct words and strings with training counts."""

    def __init__(self, table: pa.Table, order: int):
        self.data, self.offsets = string_buffers(table.column("text"))
        self.order = order
        self.train = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)

    def slices(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of documents of about ``SLICE_BYTES``: their lowered bytes and offsets."""
        for lo, hi in slices(self.offsets, SLICE_BYTES):
            yield (lo, hi, lowered(self.data[self.offsets[lo]:self.offsets[hi]]),
                   self.offsets[lo:hi + 1] - self.offsets[lo])

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Words with training counts; the end is a word of every document."""
        keys, counts = [END], [np.array([self.train.sum()], np.int64)]
        for lo, hi, data, offsets in self.slices():
            in_slice = Words(data, offsets)
            doc = np.repeat(np.arange(hi - lo), np.diff(in_slice.first))
            found = summed(in_slice.hashes(), self.train[lo:hi][doc].astype(np.int64))
            keys.append(found[0])
            counts.append(found[1])
        return summed(np.concatenate(keys), np.concatenate(counts))

    def distinct_strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Strings with training counts."""
        keys, counts = [], []
        for lo, hi, data, offsets in self.slices():
            at = contexts(data, offsets, self.order)
            of_train = np.repeat(self.train[lo:hi], np.diff(offsets) + 1)
            for part, weight in ((np.sort(at[of_train]), 1), (np.sort(at[~of_train]), 0)):
                heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else \
                    np.empty(0, np.int64)
                keys.append(part[heads])
                counts.append(weight * np.diff(np.append(heads, len(part))))
        return summed(np.concatenate(keys), np.concatenate(counts))


def borders(keys: np.ndarray, kind: int, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys dealt to ranges by a hash: an order of the keys, and the ranges' borders in it."""
    of = ((mix(keys) >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(n_ranges + 1, dtype=np.uint64))


def by_range(parts: list, names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*parts, strict=True)) if parts else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def sent(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, n_ranges: int) -> list[tuple]:
    order, cut = borders(keys, kind, n_ranges)
    keys, counts = keys[order], counts[order]
    return [(kind, r, block, keys[lo:hi].tobytes(), counts[lo:hi].astype(np.uint32).tobytes())
            for r, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if kind == WORDS or hi > lo]


def received(replies: pa.Table, kind: int, keys: np.ndarray, n_ranges: int, dtype: type) -> np.ndarray:
    """The number that came back for each key."""
    order, cut = borders(keys, kind, n_ranges)
    numbers = np.zeros(len(keys), dtype)
    for row in replies.to_pylist():
        if row["kind"] == kind:
            numbers[order[cut[row["range"]]:cut[row["range"] + 1]]] = np.frombuffer(row["numbers"], dtype)
    return numbers


def range_totals(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of one range: every block's keys, and the distinct keys with their total counts."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
    return keys, *summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))


def word_replies(table: pa.Table) -> pa.Table:
    """For each block the training counts of its words; the range's tokens and distinct words go along."""
    keys, known, totals = range_totals(table)
    rows = [(WORDS, r, b, totals[np.searchsorted(known, k)].tobytes(), int(totals.sum()), int((totals > 0).sum()))
            for r, b, k in zip(table.column("range").to_pylist(), table.column("block").to_pylist(), keys, strict=True)]
    return by_range(rows, ["kind", "range", "block", "numbers", "total", "distinct"],
                    [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])


def parts_of(keys: np.ndarray, n_parts: int, hot: np.ndarray) -> np.ndarray:
    """The trie's part of each string, by its last two context bytes, by the last three of a hot pair."""
    context = keys >> np.uint64(8)
    pair = context & np.uint64(0xFFFF)
    cell = np.where(hot[pair.astype(np.int64)], context & np.uint64(0xFFFFFF) | np.uint64(1 << 24), pair)
    return (mix(cell) % np.uint64(n_parts)).astype(np.int64)


def by_part(keys: np.ndarray, n_parts: int, hot: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each part that has strings, with their places: sorted once, whatever the number of parts."""
    part = parts_of(keys, n_parts, hot)
    order = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(keys) else np.empty(0, np.int64)
    return [(int(part[places[0]]), places) for places in np.split(order, heads[1:])] if len(keys) else []


class Level:
    """Seen strings of one order: counts by (context, byte), totals by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> np.uint64(8)
        self.heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else \
            np.empty(0, np.int64)
        self.context = context[self.heads]
        self.seen = np.add.reduceat(counts, self.heads) if len(keys) else counts
        self.kinds = np.diff(np.append(self.heads, len(keys)))

    def find(self, values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(among):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        place = np.minimum(np.searchsorted(among, values), len(among) - 1)
        return place, among[place] == values

    def per_context(self, numbers: np.ndarray) -> np.ndarray:
        return np.add.reduceat(numbers, self.heads) if len(numbers) else numbers


class Shared:
    """What every part knows: training counts of the byte pairs, which pairs of
    last context bytes are hot, and the order-two strings behind those."""

    def __init__(self, pairs: np.ndarray, hot: np.ndarray | None = None, triples: np.ndarray | None = None,
                 counts: np.ndarray | None = None):
        self.pairs = pairs
        self.hot = np.zeros(1 << 16, bool) if hot is None else hot
        self.triples = np.empty(0, np.uint64) if triples is None else triples
        self.counts = np.empty(0, np.int64) if counts is None else counts

    def order_two(self, keys: np.ndarray, seen: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A part's seen order-two strings, whole for its hot pairs too; ``keys`` are all its strings."""
        own = ~self.hot[(seen >> np.uint64(8)).astype(np.int64)]
        here = np.zeros(1 << 16, bool)
        here[((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)] = True
        whole = here[(self.triples >> np.uint64(8)).astype(np.int64)]
        return summed(np.concatenate([seen[own], self.triples[whole]]),
                      np.concatenate([counts[own], self.counts[whole]]))


def code_lengths(keys: np.ndarray, counts: np.ndarray, shared: Shared, order: int) -> np.ndarray:
    """log10 probability of each string's last byte after the bytes before it.

    ``keys`` hold all strings of some sets of last two context bytes, or three
    where the two are hot, ``counts`` their training counts (zero: unseen). A
    byte seen in a context is seen in every shorter one, so the bytes excluded
    at an order are those seen one order up."""
    pairs = shared.pairs
    levels: dict[int, Level] = {}
    seen_keys, seen_counts = keys[counts > 0], counts[counts > 0]
    for k in range(order, 1, -1):
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        seen_keys, seen_counts = summed(seen_keys & mask, seen_counts)
        if k == 2:
            seen_keys, seen_counts = shared.order_two(keys, seen_keys, seen_counts)
        levels[k] = Level(seen_keys, seen_counts)
    single = pairs.sum(axis=0)
    pair_seen, pair_kinds = pairs.sum(axis=1), (pairs > 0).sum(axis=1)

    logs = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    out_seen = np.zeros(len(keys), np.int64)  # training count here of the bytes excluded
    out_kinds = np.zeros(len(keys), np.int64)

    def code(rows: np.ndarray, count: np.ndarray, seen: np.ndarray, kinds: np.ndarray) -> None:
        left, new = seen - out_seen[rows], kinds - out_kinds[rows]
        live = new > 0
        rows, count, left, new = rows[live], count[live], left[live], new[live]
        hit = count > 0
        logs[rows] += np.log10(np.where(hit, count - 0.5, new / 2) / left)
        open_[rows[hit]] = False

    for k in range(order, 1, -1):
        level = levels[k]
        rows = np.flatnonzero(open_)
        string = keys[rows] & np.uint64((1 << (8 * (k + 1))) - 1)
        node, known = level.find(string >> np.uint64(8), level.context)
        rows, node, string = rows[known], node[known], string[known]
        place, hit = level.find(string, level.keys)
        code(rows, np.where(hit, level.counts[place] if len(level.counts) else 0, 0),
             level.seen[node], level.kinds[node])
        if k > 2:
            below = levels[k - 1]
            shorter = below.counts[np.searchsorted(below.keys, level.keys & np.uint64((1 << (8 * k)) - 1))] \
                if len(level.keys) else level.counts
        else:
            shorter = pairs.ravel()[(level.keys & np.uint64(0xFFFF)).astype(np.int64)]
        excluded = level.per_context(shorter)
        out_seen[rows], out_kinds[rows] = excluded[node], level.kinds[node]
    rows = np.flatnonzero(open_)
    before, byte = (keys[rows] >> np.uint64(8)).astype(np.int64) & 255, keys[rows].astype(np.int64) & 255
    code(rows, pairs[before, byte], pair_seen[before], pair_kinds[before])
    seen_before = pair_seen[before] > 0
    out_seen[rows[seen_before]] = ((pairs > 0) @ single)[before[seen_before]]
    out_kinds[rows[seen_before]] = pair_kinds[before[seen_before]]
    rows = np.flatnonzero(open_)
    byte = keys[rows].astype(np.int64) & 255
    kinds = int((single > 0).sum())
    code(rows, single[byte], np.full(len(rows), single.sum()), np.full(len(rows), kinds))
    logs[open_] -= np.log10(max(1, 256 - kinds))
    return logs


def byte_counts(docs: DataFrame, hot_pair: int) -> Shared:
    """Training counts of (previous byte, byte), and of the strings of order two
    behind pairs of context bytes that occur ``hot_pair`` times or more in all
    documents. At most 131,072 rows of pairs reach the driver, and of the
    strings at most 256 for each hot pair, of which there are no more than
    65,536 nor than the text has ``hot_pair`` bytes."""

    def counted(table: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], train: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(size, np.int64)
            for batch in batches:
                data, offsets = string_buffers(batch.column(0))
                held_out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for lo, hi in slices(offsets, SLICE_BYTES):
                    ends = offsets[lo:hi + 1]
                    strings = contexts(lowered(data[ends[0]:ends[-1]]), ends, 2)
                    counts += np.bincount(of(strings, np.repeat(held_out[lo:hi], np.diff(ends) + 1)), minlength=size)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["at", "n"])

        table = table.where("not held_out") if train else table
        rows = (table.select("text", "held_out").mapInArrow(run, "at bigint, n bigint")
                .groupBy("at").agg(F.sum("n").alias("n")).toArrow())
        counts = np.zeros(size, np.int64)
        counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
        return counts

    def all_pairs(strings: np.ndarray, held_out: np.ndarray) -> np.ndarray:
        return np.concatenate([(strings[~held_out] & np.uint64(0xFFFF)).astype(np.int64),
                               (strings >> np.uint64(8)).astype(np.int64) + (1 << 16)])

    both = counted(docs, 1 << 17, all_pairs, train=False)
    pairs, hot = both[:1 << 16].reshape(256, 256), both[1 << 16:] >= hot_pair
    contexts_of = np.flatnonzero(hot)
    if not len(contexts_of):
        return Shared(pairs)
    number = np.cumsum(hot) - 1

    def hot_triples(strings: np.ndarray, held_out: np.ndarray) -> np.ndarray:
        pair = (strings >> np.uint64(8)).astype(np.int64)
        return (number[pair] * 256 + (strings & np.uint64(255)).astype(np.int64))[hot[pair]]

    triples = counted(docs, 256 * len(contexts_of), hot_triples, train=True)
    at = np.flatnonzero(triples)
    return Shared(pairs, hot, (contexts_of[at >> 8] * 256 + (at & 255)).astype(np.uint64), triples[at])


def score(docs: DataFrame, held_out: str = "held_out", key: str = "doc_id", text: str = "text",
          order: int = ORDER, block_bytes: int = BLOCK_BYTES, hot_pair: int = HOT_PAIR) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` for every row.

    Documents with a false ``held_out`` train the model, a null one too. A null
    text is empty: one token, its end. Repeated rows train and are scored like
    any others. Without a training document every byte costs log10 256. An
    empty table gives an empty table; other columns are not carried. Words and
    their counts are kept by 64-bit hash. ``hot_pair`` changes how the trie is
    dealt to tasks, never a score."""
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                       F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    total = docs.agg(F.sum(text_bytes()).alias("b")).first()["b"]
    n_blocks = blocks_for(total, block_bytes)
    n_ranges = n_blocks
    shared = byte_counts(docs, hot_pair)
    blocks = docs.withColumn("block", block_of(F.xxhash64(F.col("key").cast("string"), "text"), n_blocks))

    def send(kind: int):
        def run(table: pa.Table) -> pa.Table:
            block = BlockText(table, order)
            found = block.distinct_words() if kind == WORDS else block.distinct_strings()
            return by_range(sent(table.column("block")[0].as_py(), kind, *found, n_ranges),
                            ["kind", "range", "block", "keys", "counts"],
                            [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

        return blocks.groupBy("block").applyInArrow(run, SENT_SCHEMA)

    def string_totals(table: pa.Table) -> pa.Table:
        _, keys, counts = range_totals(table)
        number = table.column("range")[0].as_py()
        rows = [(p, number, keys[at].tobytes(), counts[at].tobytes()) for p, at in by_part(keys, n_ranges, shared.hot)]
        return by_range(rows, ["part", "range", "keys", "counts"],
                        [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def trie(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        logs = code_lengths(np.concatenate(keys), counts, shared, order)
        each = np.split(logs, np.cumsum([len(k) for k in keys])[:-1])
        rows = [(p, r, x.tobytes()) for p, r, x in zip(table.column("part").to_pylist(),
                                                     table.column("range").to_pylist(), each, strict=True)]
        return by_range(rows, ["part", "range", "logs"], [pa.int32(), pa.int32(), pa.binary()])

    def string_replies(table: pa.Table, logs: pa.Table) -> pa.Table:
        keys, known, _ = range_totals(table)
        value, places = np.zeros(len(known)), dict(by_part(known, n_ranges, shared.hot))
        for row in logs.to_pylist():
            value[places[row["part"]]] = np.frombuffer(row["logs"], np.float64)
        rows = [(STRINGS, r, b, value[np.searchsorted(known, k)].tobytes(), 0, 0) for r, b, k in
                zip(table.column("range").to_pylist(), table.column("block").to_pylist(), keys, strict=True)]
        return by_range(rows, ["kind", "range", "block", "numbers", "total", "distinct"],
                        [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = BlockText(table, order)
        n = table.num_rows
        words, strings = block.distinct_words()[0], block.distinct_strings()[0]
        counts = received(replies, WORDS, words, n_ranges, np.int64)
        logs = received(replies, STRINGS, strings, n_ranges, np.float64)
        train_tokens = sum(replies.column("total").to_pylist())
        vocabulary = sum(replies.column("distinct").to_pylist())
        end_count = int(counts[np.searchsorted(words, END)[0]])
        n_tokens, n_known = np.ones(n, np.int64), np.full(n, int(end_count > 0))
        base, scores = np.full(n, np.log10(end_count + 1.0)), np.zeros(n)
        for lo, hi, data, offsets in block.slices():
            in_slice = Words(data, offsets)
            doc = np.repeat(np.arange(hi - lo), np.diff(in_slice.first))
            of_word = counts[np.searchsorted(words, in_slice.hashes())]
            n_tokens[lo:hi] += np.diff(in_slice.first)
            n_known[lo:hi] += np.bincount(doc, of_word > 0, hi - lo).astype(np.int64)
            base[lo:hi] += np.bincount(doc, np.log10(of_word + 1.0), hi - lo)
            own, inverse = np.unique(contexts(data, offsets, order), return_inverse=True)
            each = logs[np.searchsorted(strings, own)][inverse]
            scores[lo:hi] = np.add.reduceat(each, offsets[:-1] + np.arange(hi - lo))
        base -= n_tokens * np.log10(train_tokens + vocabulary + 1.0)
        return pa.table([table.column("key"), table.column("held_out"), pa.array(n_tokens, pa.int64()),
                         pa.array(n_known, pa.int64()), pa.array(np.full(n, train_tokens), pa.int64()),
                         pa.array(base), pa.array(scores)],
                        names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    words = send(WORDS).groupBy("range").applyInArrow(word_replies, REPLY_SCHEMA)
    strings = send(STRINGS)
    logs = (strings.groupBy("range").applyInArrow(string_totals, "part int, range int, keys binary, counts binary")
            .groupBy("part").applyInArrow(trie, "part int, range int, logs binary"))
    answers = strings.groupBy("range").cogroup(logs.groupBy("range")).applyInArrow(string_replies, REPLY_SCHEMA)
    key_type = docs.schema["key"].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(words.unionByName(answers).groupBy("block")).applyInArrow(
        finish, f"key {key_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double")
    return scored.withColumnRenamed("key", key)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those whose id hashes to another fold than 2 of 7."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score(docs.select("doc_id", "text", held_out.alias("held_out")))
