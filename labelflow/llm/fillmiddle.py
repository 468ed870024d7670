"""Fill-in-middle transformation by in-place block rotation.

A text is scanned into tokens once and cut at two of their borders. The three
sentinels are put into one byte array at the cuts, which gives
``<P>prefix<M>middle<S>suffix``; the wanted order is then reached by exchanging
two neighbouring segments in place, by three reversals: the middle and the
suffix segment for the order prefix, suffix, middle (*psm*), everything before
the suffix segment and that segment for suffix, prefix, middle (*spm*). The
original text comes back by finding the sentinels, undoing the rotation and
taking the sentinels out. A text that holds a sentinel stays *plain*, so that
each sentinel of an output occurs once (none can arise at a seam: it would have
to begin or end inside another one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship
from .textscan import string_buffers

# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = len(PREFIX)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes exchanged at once by a reversal; it needs no more memory than twice that.
CHUNK = 1 << 16
#: Output bytes gathered before a result batch is handed to Spark.
BATCH_BYTES = 8 << 20

FIELDS = "output string, form string, n_tokens bigint, prefix_chars bigint, middle_chars bigint"


def reverse(data: np.ndarray, lo: int, hi: int) -> None:
    """Reverse ``data[lo:hi]`` in place."""
    while hi - lo > 1:
        step = min(CHUNK, (hi - lo) // 2)
        head = data[lo:lo + step][::-1].copy()
        data[lo:lo + step] = data[hi - step:hi][::-1]
        data[hi - step:hi] = head
        lo, hi = lo + step, hi - step


def rotate(data: np.ndarray, lo: int, middle: int, hi: int) -> None:
    """Exchange the neighbours ``data[lo:middle]`` and ``data[middle:hi]`` in place, by three reversals."""
    reverse(data, lo, middle)
    reverse(data, middle, hi)
    reverse(data, lo, hi)


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document, the same on every run."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def token_starts(text: np.ndarray) -> np.ndarray:
    """Whether a token (``[A-Za-z]+`` or one other character) begins at each byte of a UTF-8 text."""
    lower = text | np.uint8(32)
    letter = (lower >= 97) & (lower <= 122)
    begins = (text & 0xC0) != 0x80  # not a later byte of a character
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return begins


def position(begins: np.ndarray, number: int) -> int:
    """Byte position of a token by its number (their count: the text's end), chunk by chunk."""
    for lo in range(0, len(begins), CHUNK):
        here = int(np.count_nonzero(begins[lo:lo + CHUNK]))
        if number < here:
            return lo + int(np.flatnonzero(begins[lo:lo + CHUNK])[number])
        number -= here
    return len(begins)


def characters(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def arrange(text: bytes, key: str, seed: int, plain_percent: int, spm_percent: int) -> tuple:
    """Output bytes, form, number of tokens, characters of prefix and middle (null if plain)."""
    view = np.frombuffer(text, np.uint8)
    begins = token_starts(view)
    n = int(np.count_nonzero(begins))
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= 100 - plain_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return text, PLAIN, n, None, None
    first, second = (position(begins, b) for b in sorted((h1 % (n + 1), h2 % (n + 1))))
    sizes = characters(view[:first]), characters(view[first:second])
    buffer = bytearray(PREFIX + text)
    buffer[SENTINEL + second:SENTINEL + second] = SUFFIX  # the later cut first: the earlier one stays where it is
    buffer[SENTINEL + first:SENTINEL + first] = MIDDLE
    middle_at, suffix_at = SENTINEL + first, 2 * SENTINEL + second
    data = np.frombuffer(buffer, np.uint8)
    form = SPM if h4 % 100 < spm_percent else PSM
    rotate(data, middle_at if form == PSM else 0, suffix_at, len(data))
    return bytes(buffer), form, n, *sizes


def rebuild(output: bytes, form: str) -> bytes:
    """The text that ``arrange`` made an output from."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    data = np.frombuffer(buffer, np.uint8)
    middle_at = buffer.index(MIDDLE)
    if form == PSM:  # prefix, suffix, middle
        suffix_at = buffer.index(SUFFIX)
        rotate(data, suffix_at, middle_at, len(data))
        middle_at, suffix_at = suffix_at, suffix_at + len(data) - middle_at
    else:  # suffix, prefix, middle
        prefix_at = buffer.index(PREFIX)
        rotate(data, 0, prefix_at, len(data))
        middle_at, suffix_at = middle_at - prefix_at, len(data) - prefix_at
    del data  # a byte array with a view cannot shrink
    for at in (suffix_at, middle_at, 0):
        del buffer[at:at + SENTINEL]
    return bytes(buffer)


def _map(docs: DataFrame, inputs: list[Column], fields: str, row) -> DataFrame:
    """All columns of ``docs`` but those called like an output, plus the outputs of ``row``, text by text."""
    ship(docs.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in names]
    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    # plain names on the way in, whatever the columns are called
    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate([*map(F.col, quoted), *inputs])])
    kinds = [pa.string() if f.split()[1] == "string" else pa.int64() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = string_buffers(batch.column(len(kept)))
            beside = batch.column(len(kept) + 1).to_pylist()
            lo, size, done = 0, 0, []
            for i in range(batch.num_rows):
                done.append(row(data[ends[i]:ends[i + 1]].tobytes(), beside[i]))
                size += len(done[-1][0])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    made = [pa.array([d[j].decode() if isinstance(d[j], bytes) else d[j] for d in done], t)
                            for j, t in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(lo, len(done)).columns[:len(kept)], *made], names=[*kept, *names])
                    lo, size, done = i + 1, 0, []

    kept_kinds = [f.dataType.simpleString() for f in source.schema.fields]
    schema = ", ".join([f"{c} {kind}" for c, kind in zip(quoted, kept_kinds)] + [fields])
    return source.mapInArrow(run, schema)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10,
              spm_percent: int = 20) -> DataFrame:
    """All columns of ``docs`` plus ``output``, ``form`` (``plain``, ``psm``,
    ``spm``), ``n_tokens``, ``prefix_chars`` and ``middle_chars``.

    The cuts and the form follow from ``seed``, key and number of tokens alone,
    so a lost task makes the same outputs again, and rows that repeat a key and
    a text have the same output. One narrow pass, no shuffle. A null text is an
    empty one, and empty texts stay plain; a null key counts as an empty one.
    ``prefix_chars`` and ``middle_chars`` are null if plain. Input columns
    called like an output are replaced; an empty table gives an empty table."""

    def row(value: bytes, name: str | None) -> tuple:
        return arrange(value, name or "", seed, plain_percent, spm_percent)

    return _map(docs, [F.col(text), F.col(key).cast("string")], FIELDS, row)


def restore(outputs: DataFrame) -> DataFrame:
    """All columns plus ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    return _map(outputs, [F.col("output"), F.col("form")], "restored string", lambda value, form: (rebuild(value, form),))


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Every document rearranged and restored, as digests."""
    made = restore(transform(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


FILL_MIDDLE_SQL = """
with docs as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), drawn as (
  select doc_id, text, tokens, len(tokens) as n,
         cast('0x' || h[1:8] as ubigint) % (len(tokens) + 1) as cut1, cast('0x' || h[9:16] as ubigint) % (len(tokens) + 1) as cut2,
         cast('0x' || h[17:24] as ubigint) as h3, cast('0x' || h[25:32] as ubigint) as h4
  from docs
), formed as (
  select doc_id, text, n,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90
              then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
         coalesce(array_to_string(tokens[1:least(cut1, cut2)], ''), '') as prefix,
         coalesce(array_to_string(tokens[least(cut1, cut2) + 1:greatest(cut1, cut2)], ''), '') as middle,
         coalesce(array_to_string(tokens[greatest(cut1, cut2) + 1:], ''), '') as suffix
  from drawn
)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from formed
"""
