"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers by length: whole windows of the
longest tier are cut off first, and what remains goes to the smallest tier that
holds it. Each tier is packed; a window's gap is filled with the longest pieces
of shorter tiers that fit, and the last bit of a gap with the head of a shorter
piece, so a full window has no padding. What is left at the end is laid end to
end and cut at the tiers and then at powers of two. Windows of one tier are
dealt to step groups of equal token counts, heaviest attention cost first.

Packing needs documents of every length at hand but not all documents: a task
packs pools of about ``pool_tokens`` tokens, so nothing is shuffled, memory is
bounded, and a lost task packs the same pool again.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship
from .textscan import Words, lowered, slices, string_buffers

TIERS = (512, 1024, 2048, 4096)
#: Tokens packed together by one task.
POOL_TOKENS = 4 << 20
#: Tokens of one step group: so many windows of a tier make a step.
STEP_TOKENS = 1 << 16
#: Distinct units whose ids one Python worker remembers before it starts afresh.
MEMO_SIZE = 400_000
#: Bytes of text scanned at once.
SLICE_BYTES = 4 << 20

Piece = tuple[int, int, int]  # document number in the pool, start, length


class WordEncoder:
    """Ids of texts for a tokenizer that never joins text across white space,
    nor across a border between ASCII letters or digits and punctuation.

    A text is scanned in slices: equal units are found by hash, and each
    distinct unit goes to the tokenizer once per worker. The apostrophe (it can
    start a token of letters) and the bar (special tokens hold it) make no
    border. Only ASCII letters are lowered before, so ``The`` and ``the`` share
    an entry; the tokenizer lowers everything itself."""

    kinds = np.zeros(256, np.uint8)
    kinds[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123))] = 1
    kinds[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = 2

    def __init__(self, path: str, memo_size: int = MEMO_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo: dict[bytes, bytes] = {}
        self.memo_size = memo_size
        # a run of lower ASCII letters that normalising and splitting leave alone can go to the model at once
        self.letters_are_plain = all(
            [t.id for t in self.model.tokenize(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids
            for w in ("a", "the", "zqxj", "internationalisation", "ll", "re", "abcdefghijklmnopqrstuvwxyz" * 3))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null is empty."""
        data, offsets = string_buffers(texts)
        for lo, hi in slices(offsets, SLICE_BYTES):
            yield from self.encode_slice(lowered(data[offsets[lo]:offsets[hi]]), offsets[lo:hi + 1] - offsets[lo])

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        kind = self.kinds[data]
        edges = np.zeros(len(data), bool)
        edges[1:] = kind[1:] * kind[:-1] == 2
        units = Words(data, offsets, edges)
        hashes = units.hashes()
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        head = order[new]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        raw = data.tobytes()
        spans = zip(units.starts[head].tolist(), units.ends[head].tolist(), strict=True)
        ids = self.look_up([raw[a:b] for a, b in spans])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(lengths) - lengths
        taken = lengths[inverse]
        ends = np.cumsum(taken)
        at = np.repeat(first[inverse] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)
        coded = flat[at].tobytes()
        borders = 4 * np.concatenate([[0], ends])[units.first]
        yield from (coded[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))

    def look_up(self, units: list[bytes]) -> list[bytes]:
        memo = self.memo
        found = [memo.get(u) for u in units]
        new = [i for i, x in enumerate(found) if x is None]
        if len(memo) + len(new) > self.memo_size:
            memo.clear()
        plain = [i for i in new if self.letters_are_plain and units[i].isalpha()]
        for i in plain:
            found[i] = memo[units[i]] = array("I", [t.id for t in self.model.tokenize(units[i].decode())]).tobytes()
        other = [i for i in new if found[i] is None]
        coded = self.tokenizer.encode_batch([units[i].decode() for i in other], add_special_tokens=False)
        for i, e in zip(other, coded, strict=True):
            found[i] = memo[units[i]] = array("I", e.ids).tobytes()
        return found


class Pool:
    """Pieces by length; finds the longest piece of at most some length."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths = 0  # a bit for each length that has pieces

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(piece[2], []).append(piece)
        self.lengths |= 1 << piece[2]

    def longest(self, at_most: int) -> int:
        return (self.lengths & ((1 << (at_most + 1)) - 1)).bit_length() - 1

    def take(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            self.lengths ^= 1 << length
        return piece


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Sequences as (size, pieces); every token of every document is in one piece."""
    top = tiers[-1]
    sequences: list[tuple[int, list[Piece]]] = []
    pool = Pool()
    for doc, length in enumerate(lengths):
        whole = length // top * top
        sequences.extend((top, [(doc, start, top)]) for start in range(0, whole, top))
        if length > whole:
            pool.add((doc, whole, length - whole))
    rest: list[list[Piece]] = []
    for tier, shorter in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while (length := pool.longest(tier)) > shorter:
            window, gap = [pool.take(length)], tier - length
            while gap and (fits := pool.longest(gap)) > 0:
                window.append(pool.take(fits))
                gap -= fits
            if gap and pool.lengths:  # every piece left is longer than the gap: cut one
                doc, start, length = pool.take(pool.longest(max(shorter, tier)))
                window.append((doc, start, gap))
                pool.add((doc, start + gap, length - gap))
                gap = 0
            if gap:
                rest.append(window)
            else:
                sequences.append((tier, window))
    sequences.extend(lay_out([piece for window in rest for piece in window], tiers))
    return sequences


def lay_out(pieces: list[Piece], tiers: tuple[int, ...]) -> Iterator[tuple[int, list[Piece]]]:
    """Pieces end to end, cut at the longest tier and at powers of two."""
    left = sum(length for _, _, length in pieces)
    queue = list(reversed(pieces))
    while left:
        size = min(tiers[-1], 1 << (left.bit_length() - 1))
        window, room = [], size
        while room:
            doc, start, length = queue.pop()
            part = min(length, room)
            window.append((doc, start, part))
            room -= part
            if part < length:
                queue.append((doc, start + part, length - part))
        left -= size
        yield size, window


def step_groups(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A step group for each sequence: within a size, sequences are dealt by
    falling attention cost, back and forth, so groups have equal token counts
    and near-equal cost."""
    groups = [0] * len(sequences)
    first = 0
    for size in sorted({size for size, _ in sequences}, reverse=True):
        own = [i for i, (s, _) in enumerate(sequences) if s == size]
        own.sort(key=lambda i: (-sum(length * length for _, _, length in sequences[i][1]), i))
        n = max(1, -(-len(own) * size // step_tokens))
        for place, i in enumerate(own):
            turn, spot = divmod(place, n)
            groups[i] = first + (spot if turn % 2 == 0 else n - 1 - spot)
        first += n
    return groups


_encoders: dict[str, WordEncoder] = {}


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text",
                   tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS,
                   step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of packed sequences: ``key``, ``start``, ``length``, ``ids``
    (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset``, ``sequence_tokens`` (its size), ``step_group``.

    A null text is empty: its document is the end id alone. Repeated rows are
    documents of their own; an empty table gives no piece; other columns are
    not carried. A sequence id holds the task and a running number, so it is
    unique without a shuffle and the same when a task is run again."""
    ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _encoders:
            _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
        encoder = _encoders[tokenizer_file]
        end = np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        next_group = next_id
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, next_group, held
            sequences = pack([len(x) // 4 for x in ids], tiers)
            groups = step_groups(sequences, step_tokens)
            rows: list[tuple] = []
            size_held = 0
            for (size, pieces), group in zip(sequences, groups, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    rows.append((keys[doc], start, length, ids[doc][4 * start:4 * (start + length)],
                                 len(ids[doc]) // 4, next_id, offset, size, next_group + group))
                    offset += length
                    size_held += length
                next_id += 1
                if size_held >= 1 << 20:
                    yield to_batch(rows)
                    rows, size_held = [], 0
            if rows:
                yield to_batch(rows)
            next_group += max(groups, default=-1) + 1
            keys.clear()
            ids.clear()
            held = 0

        for batch in batches:
            batch_keys = batch.column(0).to_pylist()
            for i, coded in enumerate(encoder.encode_all(batch.column(1))):
                keys.append(batch_keys[i])
                ids.append(coded + end)
                held += len(ids[-1]) // 4
                if held >= pool_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    key_type = source.schema["key"].dataType.simpleString()
    arrow = pa.schema([("key", _arrow_type(source)), ("start", pa.int64()), ("length", pa.int64()),
                       ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                       ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("step_group", pa.int64())])

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                                          schema=arrow)

    return source.mapInArrow(
        run, f"key {key_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
             "offset bigint, sequence_tokens bigint, step_group bigint").withColumnRenamed("key", key)


def _arrow_type(source: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["key"].dataType)


def op5_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_tokens", "step_group")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    return op5_query(read_table(spark, sf_dir, "documents"))
