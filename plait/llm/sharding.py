"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm import common


def _draw(key: Column, shard: int, weight: float) -> Column:
    """Smaller wins: an exponential variate of rate `weight`, fixed by key and shard."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of each key. A shard that is added, or gets more weight, only takes keys; none move between others.

    Shards of weight 0 get nothing. Null keys are one key.
    """
    draws = [F.struct(_draw(key, j, w).alias("draw"), F.lit(j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard(docs: DataFrame, weights: list[float], grown: list[float], key: str = "doc_id") -> DataFrame:
    """docs(doc_id, text, ...) dealt over shards by `key` alone.

    Returns doc_id, size (UTF-8 bytes of the text, null none, plus 16), text_crc32, law, shard, slot (gapless from 0 in
    each shard) and grown_shard (with the weights `grown`). Rows with equal keys share a shard: that is the law, so
    equal texts under different keys are not kept together. Slots follow (bucket of the key, doc_id, size, checksum);
    rows equal in all of these are interchangeable. Null texts count as empty. Texts never move: a shuffle carries
    numbers only, and a shard is cut into buckets, whose counts come from a scan of the key column.
    """
    n = 4 * common.spread(docs.sparkSession)
    k, bucket = F.col(key), F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(n)).cast("int")
    where = rendezvous(k, weights)
    counts = docs.select(where.alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        where.alias("shard"), rendezvous(k, grown).alias("grown_shard"), bucket.alias("bucket"),
    )
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return rows.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.row_number().over(own) - 1).cast("long").alias("slot"), "grown_shard")
