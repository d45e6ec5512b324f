"""Racks of number cards: each card brings a number, plain or pushed, as a value or as an operand of what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.functions import digits as D

EXACT = D.EXACT


def _value(k: Column) -> Column:
    """struct(num, places) of an integer's stalk."""
    c = D.hex_cells(k)
    return F.struct(k.cast(EXACT).alias("num"), F.size(c).alias("places"))


def evaluate(rows: DataFrame, key: str, order: str, number: str, op: str) -> DataFrame:
    """key, value, cells, pushed of racks of rows(key, order, number, op): from left to right, exactly.

    op is null for a number of its own and one of + - * for an operand; an operand in the first place counts as a number.
    A number starts the running value anew. How a card is spelled never changes the value, and the result is pushed on
    the way out. Values stay exact up to 38 decimal digits.
    """
    cards = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(number).cast("bigint").alias("k"), F.col(op).alias("op"))))
    start = F.struct(D.whole(0).alias("num"), F.lit(1).alias("places"), F.lit(False).alias("any"))

    def step(s: Column, card: Column) -> Column:
        def one(v: Column) -> Column:
            places = F.greatest(s["places"], v["places"])
            up = lambda x: (x["num"] * D.pow2(places - x["places"])).cast(EXACT)
            made = lambda num, at: F.struct(num.cast(EXACT).alias("num"), at.cast("int").alias("places"), F.lit(True).alias("any"))
            own = made(v["num"], v["places"])
            return F.when(card["op"].isNull() | ~s["any"], own).when(card["op"] == "*", made(s["num"] * v["num"], s["places"] + v["places"])).when(card["op"] == "+", made(up(s) + up(v), places)).otherwise(made(up(s) - up(v), places))

        return D.let(_value(card["k"]), one)

    out = rows.groupBy(key).agg(cards.alias("cards")).select(key, F.aggregate("cards", start, step).alias("s"))
    ring = D.dyadic_on_ring(F.col("s.num"), F.col("s.places"))
    return out.select(key, D.ratio(F.col("s.num"), F.col("s.places")).alias("value"), ring.alias("r")).select(key, "value", F.col("r.e").alias("e"), D.text(F.col("r.d")).alias("cells"), D.text(D.push(F.col("r.d"))).alias("pushed"))
