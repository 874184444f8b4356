"""Sharding by sampled splitters, in DataFrame functions only (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurolake.llm import _frames

SHARDS = 24
#: ranges to a shard, and sampled keys to a range (expected numbers; their product with the shards bounds the sample)
RANGES, SAMPLES = 16, 24
#: a group of equal texts of at most this part of a shard stays whole
WHOLE = 0.02
SEED = 20_240_817


def _keyed(docs: DataFrame) -> DataFrame:
    """What sharding needs of each row: size, text checksum, and the key (hash of the text, then the id)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), "doc_id").alias("d"))


def _splitters(keyed: DataFrame, ranges: int, samples: int) -> list[tuple[int, int]]:
    """Quantile boundaries (h, d) of a sample drawn in proportion to size. Inside a text hash only where that one hash fills a range."""
    total = keyed.agg(F.sum("size")).head()[0] or 0
    wanted = ranges * samples
    # the hash of the key stands for a uniform draw, so that a lost task draws the same again
    draw = F.pmod(F.xxhash64(F.lit(SEED), "h", "d"), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor(F.col("size") * wanted / F.lit(float(max(total, 1))) + draw).cast("int")
    drawn = keyed.withColumn("copies", F.least(copies, F.lit(wanted))).where("copies > 0").select("h", "d", "copies").orderBy("h", "d")
    keys = [(r["h"], r["d"]) for r in drawn.collect() for _ in range(r["copies"])]
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    hot = {h for h, _ in cuts if sum(1 for x, _ in cuts if x == h) > 1}
    low = -(1 << 63)
    return sorted({(h, low if h not in hot else d) for h, d in cuts} | {(h, low) for h in hot})


def _range_of(cuts: list[tuple[int, int]], h: Column, d: Column) -> Column:
    """How many splitters lie at or below the key: a coarse step over every 32nd, then a fine one."""
    if not cuts:
        return F.lit(0)
    pack = lambda some: F.array(*[F.struct(F.lit(x).cast("long").alias("h"), F.lit(y).cast("long").alias("d")) for x, y in some])
    below = lambda c: (c["h"] < h) | ((c["h"] == h) & (c["d"] <= d))
    step = 32
    coarse = F.size(F.filter(pack(cuts[::step]), below))
    blocks = F.array(*[pack(cuts[i : i + step]) for i in range(0, len(cuts), step)])
    fine = F.size(F.filter(F.element_at(blocks, F.greatest(coarse, F.lit(1))), below))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, samples: int = SAMPLES, whole: float = WHOLE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in a shard of near equal bytes; slots are gapless from 0 in each.

    Size is the UTF-8 bytes of the text (null: none) plus 8. A size-weighted sample of keys gives quantile boundaries of several
    ranges to a shard; rows are dealt to the ranges, the ranges are measured whole, and the running bytes over them say where
    shards begin. Equal texts are neighbours: a group of up to `whole` of a shard goes to one shard; a larger one is subdivided
    by id. Rows that repeat a key share a range. Null ids are a key like any other; an empty table has no rows.
    """
    keyed = _frames.cut(_keyed(docs))
    cuts = _splitters(keyed, shards * ranges, samples)
    placed = _frames.cut(keyed.withColumn("range", _range_of(cuts, F.col("h"), F.col("d"))))
    per = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # a row for each range: at most shards * ranges of them
    upto = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = per.select("range", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("rows0"), F.sum("bytes").over(W.partitionBy(F.lit(0))).alias("total"))
    inside = W.partitionBy("range").orderBy("h", "d", "doc_id", "text_crc32", "size")
    ahead = inside.rowsBetween(W.unboundedPreceding, -1)
    ran = placed.select("*", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("bytes1"), (F.row_number().over(inside) - 1).alias("rows1"))
    group = W.partitionBy("range", "h")
    ran = ran.withColumn("group_at", F.min("bytes1").over(group)).withColumn("group_bytes", F.sum("size").over(group))
    full = ran.join(F.broadcast(starts), "range")
    small = F.col("group_bytes") <= F.col("total") * F.lit(whole / shards)
    # the middle of the group or row decides, so an end is off by half a row at most
    at = F.col("bytes0") + F.when(small, F.col("group_at") + F.col("group_bytes") / 2).otherwise(F.col("bytes1") + F.col("size") / 2)
    sharded = full.select("doc_id", "size", "text_crc32", F.least(F.floor(at * shards / F.col("total")), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("rows0") + F.col("rows1")).alias("nth"))
    sharded = _frames.cut(sharded)
    first = sharded.groupBy("shard").agg(F.min("nth").alias("first"))
    return sharded.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the rows of docs to path, a folder shard=k for each shard. Rows of one doc_id and text share the shard of the first of them."""
    where = shard(docs, shards).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("shard"))
    left = docs.withColumn("_crc", F.crc32(F.coalesce("text", F.lit(""))))
    joined = left.join(where, left["doc_id"].eqNullSafe(where["doc_id"]) & (left["_crc"] == where["text_crc32"])).drop(where["doc_id"]).drop("_crc", "text_crc32")
    joined.write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    got = shard(_frames.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
SQL: dict[str, str] = {}
