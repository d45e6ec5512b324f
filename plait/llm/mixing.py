"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

A document is taken floor(target / source size) times, and once more if its hash lies below its source's threshold.
Thresholds come from histograms of words by source and 12 bits of the hash: the cumulative sum finds the bucket in
which the budget ends, and the next 12 bits are counted for that bucket alone. Nothing is sorted; rows are filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm import common

LEVELS, DIGITS = 4, 3  # 4 times 3 hex digits of the hash: 48 bits


def targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """sizes(source, source_size) with target: shares of the whole by weight, at most `most` times a source's size.

    Resharing what is above until none is, is pouring to one level: sources in order of most * size / weight fill up
    first, and the level is the first that leaves the next one unfilled. Works on one row per source.
    """
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sizes.withColumn("weight", cycle).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    base = base.withColumn("fills_at", F.col("cap") / F.col("weight"))
    order, every = Window.orderBy("fills_at", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    base = base.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(every)["level"]
    return base.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce(first, F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each of docs(doc_id, text, source, ...) is taken, and the words that makes.

    Returns doc_id, size, source_size, target, taken, copies, then the columns `keep`. Size: words of the text, null
    none. Sources by code point, null last, have the weights in turn. A source's taken words differ from its target by
    at most half the document on which the budget ends (rows with equal doc_id and text share their hash, so they are
    taken or left together). Empty documents are taken by the same rule and add nothing. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    hashed = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, LEVELS * DIGITS)
    size = F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")
    numbers = docs.select("doc_id", "source", size.alias("size"), hashed.alias("h"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    # the numbers are written once for all levels; columns to keep may hold texts, and are read again from docs instead
    rows = common.written(numbers.select("doc_id", "source", "size", "h"), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, list(weights), most).select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("base"))
    sources = common.written(sources.select("*", (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below")), "mix-sources")
    tables, at = [sources], sources
    for level in range(LEVELS):
        inside = common.small_join(rows.select("source", "size", "h"), at.select("source", "prefix"), ["source"], F.xxhash64("h"))
        counts = inside.where(F.startswith(F.col("h"), F.col("prefix"))).groupBy("source", F.substring("h", level * DIGITS + 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = counts.select("source", "bucket", "n", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")).alias("upto"))
        known = at.select(F.col("source").alias("s"), "below", "budget")
        # the first bucket that does not fit whole; a source whose rows all fit ends past the last
        ends = upto.join(known, F.col("source").eqNullSafe(F.col("s"))).where(F.col("below") + F.col("upto") > F.col("budget"))
        ends = ends.groupBy("source").agg(F.min(F.struct("bucket", "n", "upto")).alias("e"))
        new = at.alias("a").join(ends.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
            F.col("a.source").alias("source"), "source_size", "target", "base", "budget",
            F.when(F.col("e").isNotNull(), F.concat("prefix", F.col("e.bucket"))).otherwise(F.concat("prefix", F.lit("g"))).alias("prefix"),
            (F.col("below") + F.coalesce(F.col("e.upto") - F.col("e.n"), F.lit(0))).cast("long").alias("below"), F.coalesce(F.col("e.n"), F.lit(0)).cast("long").alias("last"),
        )
        at = common.written(new, f"mix-level{level}")
        tables.append(at)
    # the bucket in which the budget ends is by now one document: it is taken if that comes nearer
    ends_in = F.col("below") + F.col("last") - F.col("budget") < F.col("budget") - F.col("below")
    limits = at.select("source", "source_size", "target", "base", "prefix", ends_in.alias("ends_in"))
    joined = common.small_join(numbers if keep else rows, limits, ["source"], F.xxhash64("h"))
    common.dropped(*tables[:-1], *([rows] if keep else []))
    more = (F.col("h") < F.col("prefix")) | ((F.col("h") == F.col("prefix")) & F.col("ends_in"))
    copies = (F.col("base") + F.when((F.col("base") < most) & more, 1).otherwise(0)).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *(F.col(f"__keep_{c}").alias(c) for c in keep))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of docs as often as mix() takes them, with all their columns, whatever their names."""
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"))
    taken = mix(whole, weights, most, ("__row",)).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("__row", F.col("copies").cast("int"))).alias("__row")).select("__row.*")
