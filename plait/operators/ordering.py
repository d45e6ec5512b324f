"""Positions in a total order without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.operators import shared

_ROW = 33  # bits of a row's number within its partition, in monotonically_increasing_id()


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's position, from 0, by `order`, which must leave no ties between rows that differ.

    df is made once and written; its rows are dealt over ranges of the order, sorted and numbered within them and
    written again; a running count over one row for each range gives the first position of each. A range holds an even
    share of the rows whatever their prefixes.
    """
    spark = df.sparkSession
    made = shared.written(df, "unordered")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = made.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = shared.written(dealt.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__part", F.shiftright("__id", _ROW))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    first = counts.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__first"))
    joined = rows.join(F.broadcast(first), F.col("__part") == F.col("__p"))  # a row for each of `parts` ranges
    own = F.col("__id").bitwiseAND(F.lit((1 << _ROW) - 1))
    return joined.withColumn(name, (F.col("__first") + own).cast("long")).drop("__id", "__part", "__p", "__first")
