import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from labelflow.llm.sharding import TIE_BITS, kd_shards, metadata


def size_of(text):
    return len((text or "").encode()) + 16


def test_every_row_once_with_gapless_slots(awkward_docs, awkward):
    rows = kd_shards(awkward_docs, shards=7).collect()
    want = sorted(((r[0], size_of(r[1]), zlib.crc32((r[1] or "").encode())) for r in awkward), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert {r.shard for r in rows} <= set(range(7))


@pytest.mark.parametrize("shards", [1, 3, 10])
def test_near_equal_bytes(awkward_docs, shards):
    rows = kd_shards(awkward_docs, shards=shards).collect()
    sums = [sum(r["size"] for r in rows if r.shard == s) for s in range(shards)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in rows)


def test_hot_group_of_copies_is_cut(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id < 2000, 'copy of one text', concat('text ', id)) as text",
                                        "'en' as lang", "if(id < 2500, 'hot', 'cold') as source")
    rows = kd_shards(docs, shards=40).collect()
    sums = [sum(r["size"] for r in rows if r.shard == s) for s in range(40)]
    assert max(sums) <= 1.05 * sum(sums) / 40


def plain_tree(rows, shards, dimensions):
    """Rows (size, keys by dimension) in shards, by recursion over sorted keys: the bytes of each shard."""
    whole = [max(r[1][d] for r in rows) - min(r[1][d] for r in rows) for d in range(dimensions)]

    def cut(part, first, n):
        if n == 1 or not part:
            return {first: part}
        spans = [((max(r[1][d] for r in part) >> TIE_BITS) - (min(r[1][d] for r in part) >> TIE_BITS)) / max(1, whole[d] >> TIE_BITS)
                 for d in range(dimensions)]
        d = spans.index(max(spans))
        part = sorted(part, key=lambda r: r[1][d])
        wanted, upto, at = sum(r[0] for r in part) * (n // 2) / n, 0, 0
        for _, same in itertools.groupby(part, key=lambda r: r[1][d]):  # rows of one key are not parted
            same = list(same)
            size = sum(r[0] for r in same)
            if upto + size >= wanted:  # the cut goes to the nearer side of the quantile
                at += len(same) * (wanted - upto > upto + size - wanted)
                break
            upto, at = upto + size, at + len(same)
        return {**cut(part[:at], first, n // 2), **cut(part[at:], first + n // 2, n - n // 2)}

    return {s: sum(r[0] for r in part) for s, part in cut(rows, 0, shards).items()}


def test_shards_follow_a_plain_tree(spark, awkward_docs):
    rows = metadata(awkward_docs, "doc_id", "text", ["lang", "source"]).collect()
    want = plain_tree([(r["size"], (r.d0, r.d1, r.d2)) for r in rows], 6, 3)
    got = {r.shard: r.bytes for r in kd_shards(awkward_docs, shards=6).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    assert got == {s: b for s, b in want.items() if b}


def test_many_shards(spark):
    """A thousand shards: the plan and the driver see nothing that grows with them."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 50 + id % 60) as text", "concat('l', id % 3) as lang",
                                          "if(id % 3 = 0, 'hot', concat('s', id % 40)) as source")
    rows = kd_shards(docs, shards=1000).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    sums = [r.bytes for r in rows]
    assert len(rows) == 1000 and max(sums) - min(sums) <= 6 * 126 and sum(r.n for r in rows) == 20_000


def test_target_bytes_and_repeat(awkward_docs):
    first = kd_shards(awkward_docs, target_bytes=100_000)
    again = kd_shards(awkward_docs.repartition(3), target_bytes=100_000)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_empty_table(no_docs):
    frame = kd_shards(no_docs, shards=4)
    assert frame.collect() == [] and frame.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
