"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by the vocabulary's pattern; each match is encoded by itself.
Encodings of adjacent byte strings form a monoid: a string is encoded by
encoding its halves and joining them, and a join only re-encodes a window
around the seam. The window grows until both of its ends are *stable*.

Why a stable seam is proof. Call tokens ``a, b`` compatible if encoding the
bytes ``a + b`` gives ``[a, b]`` again. Merges are applied by (rank, position).
(1) In any encoding all neighbours are compatible: the merges inside a pair are
the ones the pair alone would make, so a crossing merge that the pair alone
would make was available, and lower, in the whole string too. (2) If all
neighbours of a sequence are compatible, it is the encoding of its bytes:
up to the first merge that crosses a token border, the tokens beside it have
merged just as in the pair alone, which would then make that merge as well.
Left part, window and right part are encodings, so only the two new
neighbours at the window's ends are left to test.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship

#: Byte strings up to this length are merged directly; longer ones are halved.
LEAF_BYTES = 32
#: Distinct matches remembered by one Python worker before it starts afresh.
MEMO_SIZE = 400_000
#: Text bytes encoded before a result batch is handed to Spark.
BATCH_BYTES = 8 << 20


class BytePairCodec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int = MEMO_SIZE):
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.memo_size = memo_size
        self.memo: dict[str, bytes] = {}
        self.compatible_memo: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Apply merges one by one, lowest rank first, leftmost on ties."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        rank_of = self.ranks.get
        pair_ranks = [rank_of(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best = min((r for r in pair_ranks if r is not None), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            i = pair_ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            pair_ranks.pop(i)
            if i < len(pair_ranks):
                pair_ranks[i] = rank_of(parts[i] + parts[i + 1])
            if i:
                pair_ranks[i - 1] = rank_of(parts[i - 1] + parts[i])

    def compatible(self, a: int, b: int) -> bool:
        known = self.compatible_memo.get((a, b))
        if known is None:
            if len(self.compatible_memo) >= self.memo_size:
                self.compatible_memo.clear()
            known = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.compatible_memo[a, b] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes."""
        if not left or not right:
            return left or right
        width = 1
        while True:
            lo, hi = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[lo:] + right[:hi])))
            left_stable = lo == 0 or self.compatible(left[lo - 1], window[0])
            right_stable = hi == len(right) or self.compatible(window[-1], right[hi])
            if left_stable and right_stable:
                return left[:lo] + window + right[hi:]
            width *= 2

    def tree(self, piece: bytes) -> list[int]:
        """Encode halves recursively and join them."""
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def encode_match(self, match: str) -> bytes:
        piece = match.encode()
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else self.tree(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for match in self.find(text):
            ids = memo.get(match)
            if ids is None:
                if len(memo) >= self.memo_size:
                    memo.clear()
                ids = self.encode_match(match)
                if len(match) <= 64:
                    memo[match] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a token sequence: halves are decoded and concatenated."""
        if len(ids) <= 4 << 12:
            return b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))
        middle = len(ids) // 8 * 4
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """The worker's codec for a rank file, loaded once per Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec.from_file(path, pattern)
    return _codecs[path, pattern]


def _resolve(path: str) -> str:
    """A file of ``SparkContext.addFile`` is named ``files:<name>``."""
    return SparkFiles.get(path.removeprefix("files:")) if path.startswith("files:") else path


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", decode: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` (binary, little-endian unsigned
    32-bit) and, if asked for, ``decoded`` (the bytes that the ids decode to).

    One narrow pass: no shuffle, any number of rows per task, at most
    ``BATCH_BYTES`` of text plus one document in a result batch. A null text
    is an empty one. Repeated rows each get their own result; an empty table
    gives an empty table. Input columns called ``ids`` or ``decoded`` are
    replaced. ``rank_file`` must be readable on every executor, or be
    ``files:<name>`` after ``SparkContext.addFile``."""
    ship(docs.sparkSession)
    names = ["ids", "decoded"] if decode else ["ids"]
    docs = docs.drop(*names)
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(_resolve(rank_file), pattern)
        for batch in batches:
            lo = size = 0
            done: list[bytes] = []
            for i, value in enumerate(batch.column(position)):
                done.append(bpe.encode(value.as_py() or ""))
                size += len(done[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    columns = [pa.array(done, pa.binary())]
                    if decode:
                        columns.append(pa.array(map(bpe.decode, done), pa.binary()))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(lo, len(done)).columns, *columns], names=[*batch.schema.names, *names])
                    lo, size, done = i + 1, 0, []

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"{n} binary" for n in names])
    return docs.mapInArrow(run, schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document text encoded and decoded again, as digests."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
