"""K-d tree sharding: shards of near-equal bytes over metadata dimensions.

The documents' metadata (language, source, size) is cut recursively: a node that
stands for k shards is split at the weighted quantile that leaves floor(k/2)
shards' bytes on the left, along the dimension in which it is widest, until
each leaf holds the target bytes. Rows with the same value are ordered by text
and then by id, so a node can also be cut inside one source or one group of
copies.

The tree is grown a level at a time, and its nodes are rows of a table: what a
node's rows span, where it is cut, and to which child a row goes are all
aggregates and joins by the node, so neither the driver nor a plan grows with
the number of shards. A quantile is found by distributed histograms: one
aggregate sums the bytes of all nodes' bins, and the next looks into the bin that
holds the quantile, between the smallest and largest key seen there, until that
bin is small. All of it reads a narrow stored table, not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, stored

#: Bytes a document takes besides its text.
OVERHEAD = 16
#: Bins of a node: as many as keep a level's bins at ``LEVEL_BINS``, within these limits.
BINS, LEVEL_BINS = (64, 4096), 1 << 20
#: A quantile is fixed once its bin holds at most this share of a shard's bytes.
TOLERANCE = 0.002
#: Rows numbered by one sort when slots are given out.
SLOT_ROWS = 4096
#: Bits of a dimension's position and of the order among equal positions.
POSITION_BITS, TIE_BITS = 31, 31


def position(value: Column) -> Column:
    """A place on the axis of a categorical value; null has its own."""
    return F.coalesce(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << POSITION_BITS)), F.lit(0).cast("long"))


def metadata(docs: DataFrame, key: str, text: str, categories: list[str]) -> DataFrame:
    """Id, size, checksum and one ordering key per dimension, without the text."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select(F.col(key).alias("key"), size.alias("size"),
                       F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
                       *[position(F.col(c)).alias(f"p{i}") for i, c in enumerate(categories)])
    by_size = F.floor(F.log2("size") * (1 << (POSITION_BITS - 6))).cast("long")
    tie = (F.pmod(F.xxhash64("text_crc32", "size"), F.lit(1 << 11)) * (1 << (TIE_BITS - 11))
           + F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << (TIE_BITS - 11))))
    places = [*[F.col(f"p{i}") for i in range(len(categories))], by_size]
    return stored(rows.select("key", "size", "text_crc32",
                              *[(p * (1 << TIE_BITS) + tie).alias(f"d{i}") for i, p in enumerate(places)]), "metadata")


def widest(rows: DataFrame, dimensions: list[str], whole: dict[str, int]) -> DataFrame:
    """The nodes to be cut: the dimension in which each is widest, its span there, and the bytes wanted on the left."""
    spans = rows.where("shards > 1").groupBy("first", "shards").agg(
        F.sum("size").alias("bytes"), *[f(d).alias(f"{name}_{d}") for d in dimensions
                                       for name, f in (("low", F.min), ("high", F.max))])
    scales = F.array(*[(F.shiftright(f"high_{d}", TIE_BITS) - F.shiftright(f"low_{d}", TIE_BITS)) / max(1, whole[d] >> TIE_BITS)
                       for d in dimensions])
    dimension = (F.array_position(scales, F.array_max(scales)) - 1).cast("int")  # the first of equals

    def there(name: str) -> Column:
        return F.get(F.array(*[F.col(f"{name}_{d}") for d in dimensions]), F.col("dimension"))

    spans = spans.withColumn("dimension", dimension)
    return spans.select("first", "shards", "dimension", there("low").alias("low"), (there("high") + 1).alias("high"),
                        F.lit(0).cast("long").alias("below"),
                        (F.col("bytes") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("wanted"))


def narrowed(rows: DataFrame, nodes: DataFrame, dimensions: list[str], bins: int, enough: float) -> DataFrame:
    """The nodes with the bin that holds their quantile as the new span, or with their cut if it is small."""
    key = F.get(F.array(*dimensions), F.col("dimension"))
    width = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("high") - F.col("low")) / bins))
    found = (rows.select("first", "size", *dimensions).join(nodes.select("first", "dimension", "low", "high"), "first")
             .withColumn("at", key).where("at >= low and at < high")
             .groupBy("first", F.floor((F.col("at") - F.col("low")) / width).alias("bin"))
             .agg(F.sum("size").alias("bytes"), F.min("at").alias("from"), F.max("at").alias("to")))
    upto = F.sum("bytes").over(Window.partitionBy("first").orderBy("bin"))
    held = (found.withColumn("upto", upto).join(nodes.select("first", "below", "wanted"), "first")
            .where("below + upto >= wanted").groupBy("first")
            .agg(F.min(F.struct("bin", "bytes", "from", "to", "upto")).alias("b")))
    before = F.col("below") + F.col("b.upto") - F.col("b.bytes")
    small = (F.col("b.bytes") <= enough) | (F.col("b.from") == F.col("b.to"))
    nearer = F.when(F.col("wanted") - before <= before + F.col("b.bytes") - F.col("wanted"), F.col("b.from")).otherwise(F.col("b.to") + 1)
    # no bin reaches it by rounding only: the quantile is the node's end
    cut = F.when(F.col("b").isNull(), F.col("high")).when(small, nearer)
    return nodes.join(held, "first", "left").select(
        "first", "shards", "dimension", F.coalesce("b.from", "low").alias("low"), F.coalesce(F.col("b.to") + 1, "high").alias("high"),
        F.coalesce(before, "below").alias("below"), "wanted", cut.alias("cut"))


def cut_level(rows: DataFrame, dimensions: list[str], whole: dict[str, int], target: float) -> DataFrame:
    """Every node that stands for several shards cut once; each row names its new node."""
    live, cuts = stored(widest(rows, dimensions, whole), "nodes"), None
    while n := live.count():
        bins = min(max(LEVEL_BINS // n, BINS[0]), BINS[1])
        found = stored(narrowed(rows, live, dimensions, bins, TOLERANCE * target), "nodes")
        done = found.where("cut is not null").select("first", "dimension", "cut")
        cuts = done if cuts is None else cuts.unionByName(done)
        live = found.where("cut is null").drop("cut")
    if cuts is None:
        return rows
    half = F.floor(F.col("shards") / 2).cast("int")
    left = F.get(F.array(*dimensions), F.col("dimension")) < F.col("cut")
    placed = rows.join(cuts, "first", "left").withColumn("half", half)
    whole_node = F.col("cut").isNull()
    return stored(placed.select(
        *[c for c in rows.columns if c not in ("first", "shards")],
        F.when(whole_node | left, F.col("first")).otherwise(F.col("first") + F.col("half")).alias("first"),
        F.when(whole_node, F.col("shards")).when(left, F.col("half")).otherwise(F.col("shards") - F.col("half")).alias("shards")),
        "placed")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id",
              text: str = "text", categories: list[str] | None = None) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard``, ``slot`` for every row.

    Give the number of shards, or the bytes a shard should hold. A null text
    has no bytes and the checksum of the empty text; a null category or key is
    a value of its own; rows that repeat an id and a text may part only where a
    cut falls between shards of equal keys, never in number. Slots run without
    a gap from 0 in each shard. An empty table gives an empty table; other
    columns are not carried."""
    categories = ["lang", "source"] if categories is None else categories
    rows = metadata(docs, key, text, categories)
    dimensions = [c for c in rows.columns if c.startswith("d")]
    ends = [f(d).alias(f"{name}_{d}") for d in dimensions for name, f in (("low", F.min), ("high", F.max))]
    sums = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).first()
    total = sums["bytes"] or 0
    shards = shards or max(1, -(-total // target_bytes))
    whole = {d: (sums[f"high_{d}"] or 0) - (sums[f"low_{d}"] or 0) for d in dimensions}
    rows = rows.withColumns({"first": F.lit(0), "shards": F.lit(shards)})
    for _ in range((shards - 1).bit_length()):
        rows = cut_level(rows, dimensions, whole, max(1.0, total / shards))
    n_groups = max(1, -(-sums["n"] // (shards * SLOT_ROWS)))
    placed = rows.select("key", "size", "text_crc32", F.col("first").alias("shard"),
                         F.pmod(F.xxhash64("key", "text_crc32"), F.lit(n_groups)).cast("int").alias("group"))
    counts = placed.groupBy("shard", "group").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("shard").orderBy("group")) - F.col("k")
    starts = counts.select("shard", "group", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "group").orderBy("key", "text_crc32", "size"))
    return (placed.withColumn("place", place).join(starts, ["shard", "group"])
            .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                    (F.col("start") + F.col("place") - 1).alias("slot")))


def op1_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    placed = kd_shards(read_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
