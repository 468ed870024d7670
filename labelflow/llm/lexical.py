"""Ranked lexical search by bag deduplication.

For a set of items only the items' own words matter: a document is reduced to
its *bag*, the sorted words of that vocabulary with their counts, and a length
norm ``m``. Documents of equal bag and ``m`` have equal scores for every item,
so they form one class: classes are found by a hash of the bag and told apart
by the bag itself, scored once, and the best are expanded to their members by
ascending id. A class of any number of copies keeps its ``k`` smallest ids,
which are all that ``k`` results can show; the others are let go before the
shuffle. Classes are dealt to blocks and items to groups; a (block, group) cell
adds up whole-number impacts word by word and returns its ``k`` best for each
item, and the best of all blocks are merged.

An item's words go to every task only while their measured size is below
``VOCABULARY_BYTES``; a larger vocabulary is joined to the documents' words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, blocks_for, read_table, ship, stored
from .textscan import string_buffers

#: A term in UTF-8 bytes whose letters A-Z are lowered: every byte but ASCII controls, blanks and signs.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_TERM = re.compile(rb"[^0-9a-z\x80-\xff]")
#: A text is scanned in slices of this many bytes, cut between terms.
SLICE_BYTES = 1 << 20
#: Largest item vocabulary (bytes of distinct terms) that is sent to every task.
VOCABULARY_BYTES = 4 << 20
#: Bytes of bags in a block of classes, and of bags in a group of items.
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 4 << 20
#: Rows handed to Spark in one result batch.
BATCH_ROWS = 2048


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text (UTF-8)."""
    found: Counter = Counter()
    text, lo = text.lower(), 0  # bytes.lower knows A-Z only
    while lo < len(text):
        cut = NO_TERM.search(text, lo + SLICE_BYTES) if lo + SLICE_BYTES < len(text) else None
        hi = cut.start() if cut else len(text)
        found.update(TERM.findall(text, lo, hi))
        lo = hi
    return found


def bags(rows: DataFrame, key: str, text: str, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """``id``, ``n`` (terms with repeats) and ``bag`` (``term:count`` by term,
    blank between) of every row, one narrow pass over whole texts; with a
    vocabulary the bag holds its terms only. A null text has no terms."""
    ship(rows.sparkSession)
    known = rows.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = known.value if known is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                data, ends = string_buffers(part.column(1))
                sizes, found = [], []
                for i in range(part.num_rows):
                    counts = term_counts(data[ends[i]:ends[i + 1]].tobytes())
                    sizes.append(counts.total())
                    terms = sorted(counts.keys() if only is None else counts.keys() & only)
                    found.append(b" ".join([b"%b:%d" % (t, counts[t]) for t in terms]))
                bag = pa.array(found, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), bag], names=["id", "n", "bag"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n bigint, bag string")


def _entries(bag: str = "bag") -> Column:
    """A row for each entry of a bag."""
    return F.explode(F.split(bag, " ")).alias("entry")


def _term(entry: str = "entry") -> Column:
    return F.substring_index(entry, ":", 1).alias("term")


def _restricted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Bags cut to a vocabulary that is too large to send: their entries are joined to it."""
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "all-terms")
    entries = docs.where("bag <> ''").select("row", _entries()).withColumn("term", _term())
    held = (entries.join(vocabulary, "term", "left_semi").groupBy("row")
            .agg(F.array_sort(F.collect_list(F.struct("term", "entry"))).alias("held"))
            .select("row", F.concat_ws(" ", F.transform("held", lambda e: e["entry"])).alias("bag")))
    return docs.drop("bag").join(held, "row", "left").select("id", "n", F.coalesce("bag", F.lit("")).alias("bag"))


class Block:
    """Posting lists of some classes: for each term the classes that hold it and their impacts."""

    def __init__(self, number_of: dict[bytes, int], bag: list[bytes], m: np.ndarray):
        self.size = len(bag)
        term, tf, lengths = [], [], []
        for entries in bag:
            pairs = [entry.split(b":") for entry in entries.split()]
            term += [number_of.get(t, -1) for t, _ in pairs]
            tf += [int(n) for _, n in pairs]
            lengths.append(len(pairs))
        term, tf = np.array(term, np.int64), np.array(tf, np.int64)
        of = np.repeat(np.arange(self.size), lengths)
        order = np.argsort(term, kind="stable")
        self.of = of[order]
        self.impact = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of]))[order]
        self.borders = np.searchsorted(term[order], np.arange(len(number_of) + 1))

    def scores(self, terms: list[int], factors: list[int]) -> np.ndarray:
        total = np.zeros(self.size, np.int64)
        for t, factor in zip(terms, factors, strict=True):
            at = slice(self.borders[t], self.borders[t + 1])
            total[self.of[at]] += factor * self.impact[at]  # a class has one posting of a term
        return total


def best_members(score: np.ndarray, members: list, first: np.ndarray, k: int) -> list[tuple]:
    """The ``k`` best (score, id) of all members of classes that score above 0, ties by ascending id.

    A class outside the ``k`` best by (score, smallest id) has no member among
    them, as each class before it has one."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    at = at[np.lexsort((first[at], -score[at]))][:k]
    return [(int(score[c]), i) for c in at for i in members[c]] if len(at) else []


def _score_cell(k: int):
    def run(classes: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if classes.num_rows and items.num_rows:
            terms = [dict(zip((t.encode() for t in row["terms"]), row["factors"], strict=True)) for row in items.to_pylist()]
            number_of = {t: i for i, t in enumerate(sorted({t for row in terms for t in row}))}
            members = [[e["id"] for e in row] for row in classes.column("members").to_pylist()]
            order = sorted(range(len(members)), key=lambda c: (members[c][0] is None, members[c][0]))
            first = np.empty(len(members), np.int64)
            first[order] = np.arange(len(members))
            block = Block(number_of, [b.encode() for b in classes.column("bag").to_pylist()], classes.column("m").to_numpy())
            for item, row in zip(items.column("item").to_pylist(), terms, strict=True):
                score = block.scores([number_of[t] for t in row], list(row.values()))
                found = best_members(score, members, first, k)
                found.sort(key=lambda f: (-f[0], f[1] is None, f[1] if f[1] is not None else 0))
                out += [(item, i, s) for s, i in found[:k]]
        kinds = [pa.int64(), classes.schema.field("members").type.value_type.field("id").type, pa.int64()]
        return pa.table([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names=["item", "id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", vocabulary_bytes: int = VOCABULARY_BYTES, block_bytes: int = BLOCK_BYTES,
         group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: each item's ``k`` best documents of score above 0.

    Terms, weights and scores are those of the README. A null or empty text
    has no terms: such a document is never found and not counted, such an item
    finds none. Rows that repeat an id are documents or items of their own,
    whatever their text; a null id stays null and comes last among equal
    scores. Other columns are not carried, whatever their names. An empty
    table of either kind gives an empty table."""
    ship(docs.sparkSession)
    asked = stored(bags(items, item_key, item_text).withColumn("item", F.monotonically_increasing_id()), "items")
    item_terms = asked.where("bag <> ''").select("item", _entries()).select(
        "item", _term(), F.substring_index("entry", ":", -1).cast("long").alias("repeats"))
    vocabulary = stored(item_terms.select("term").distinct(), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= vocabulary_bytes:
        terms = frozenset(r["term"].encode() for r in vocabulary.collect())
        held = bags(docs, key, text, terms)
    else:
        held = _restricted(bags(docs, key, text), vocabulary)
    held = stored(held.where("n > 0"), "bags")
    total = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    found = held.where("bag <> ''")

    # whole numbers of any size: the product may pass 64 bits long before its quotient does
    norm = F.expr(f"25 + (cast(n as decimal(19, 0)) * {75 * total['n']}BD) div {max(total['l'], 1)}BD")
    same = ["hash", "m", "bag"]
    first = Window.partitionBy(*same).orderBy(F.col("id").asc_nulls_last())
    classes = stored(
        found.select("id", F.xxhash64("bag").alias("hash"), norm.cast("long").alias("m"), "bag")
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
        .groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("members")), "classes")

    frequency = found.select(_entries()).groupBy(_term()).agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * total["n"] + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = stored(item_terms.join(frequency, "term").groupBy("item").agg(
        F.collect_list(F.struct("term", (F.col("repeats") * weight).alias("factor"))).alias("entries"),
        F.sum(F.octet_length("term") + 16).alias("bytes"))
        .select("item", "bytes", F.col("entries.term").alias("terms"), F.col("entries.factor").alias("factors")), "weighted")

    n_blocks = blocks_for(classes.agg(F.sum(F.octet_length("bag"))).first()[0], block_bytes)
    n_groups = blocks_for(weighted.agg(F.sum("bytes")).first()[0], group_bytes)

    def everywhere(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = classes.select(block_of(F.struct("hash", "m"), n_blocks).alias("block"), everywhere(n_groups).alias("group"),
                          "m", "bag", "members")
    right = weighted.select(everywhere(n_blocks).alias("block"), block_of(F.col("item"), n_groups).alias("group"),
                            "item", "terms", "factors")
    id_type = docs.schema[key].dataType.simpleString()
    best = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(
        _score_cell(k), f"item bigint, id {id_type}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item", F.col("id").alias("item_id")), "item").select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score")


def op11_ranking(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

RANKING_SQL = f"""
with docs as (
  select row_number() over () as doc, doc_id, {_TERMS} as terms from documents where text is not null
), items as (
  select row_number() over () as item, item_id, {_TERMS} as terms from benchmark where text is not null
), held as (
  select doc, doc_id, terms, len(terms) as n from docs where len(terms) > 0
), total as (
  select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from held
), asked as (
  select item, item_id, term, count(*) as repeats
  from (select item, item_id, unnest(terms) as term from items) group by item, item_id, term
), counted as (
  select doc, term, count(*) as tf from (select doc, unnest(terms) as term from held)
  where term in (select term from asked) group by doc, term
), weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from counted, total group by term, n_docs
), normed as (
  select doc, doc_id, 100 - 75 + (75 * n * n_docs) // n_terms as m from held, total
), scored as (
  select item, item_id, doc, doc_id,
         cast(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join weights using (term) join counted using (term) join normed using (doc)
  group by item, item_id, doc, doc_id
), ranked as (
  select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank,
         doc_id, score
  from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
