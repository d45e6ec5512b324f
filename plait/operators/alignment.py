"""Stalks on rings aligned by place value: the columns of sums that carry nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions import digits as D


def align(rows: DataFrame, keys: list[str], cells: str = "d", ring: str = "e", sign: str | None = None) -> DataFrame:
    """The aligned sum of rows(keys, cells, ring[, sign]) in each group: keys, lo, hi, sums, owed, total.

    Cell i on ring e weighs 2^-(i+1-e). Digits are summed by weight before the shuffle, so a group's size costs nothing;
    sums runs from the coarsest weight lo to the finest hi, gaps as 0. A group without a lit cell has empty sums and total 0.
    """
    lit = rows.select(*keys, F.posexplode(cells).alias("i", "v"), F.col(ring).alias("__e"), (F.col(sign) if sign else F.lit(1)).alias("__s"))
    weights = lit.groupBy(*keys, (F.col("i") + 1 - F.col("__e")).alias("w")).agg(F.sum(F.col("v") * F.col("__s")).alias("s"), F.max(F.col("v") != 0).alias("lit"))
    held = weights.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("lit"), F.struct("w", "s")))).alias("m"))
    held = held.select(*keys, "m", F.array_min(F.map_keys("m")).alias("lo"), F.array_max(F.map_keys("m")).alias("hi"))
    sums = F.when(F.col("lo").isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(0))), lambda w: F.coalesce(F.element_at("m", w), F.lit(0))))
    out = held.select(*keys, "lo", "hi", sums.alias("sums"))
    num = D.sums_numerator(F.col("sums"))
    # below the point the total is num / 2^hi; a finest weight above it shifts the other way
    total = F.when(F.col("lo").isNull(), "0").otherwise(D.ratio((num * D.pow2(F.greatest(-F.coalesce("hi", F.lit(0)), F.lit(0)))).cast(D.EXACT), F.greatest(F.coalesce("hi", F.lit(0)), F.lit(0))))
    return out.select("*", F.size(F.filter("sums", lambda s: F.abs(s) > 1)).alias("owed"), total.alias("total"))
