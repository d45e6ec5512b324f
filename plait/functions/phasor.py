"""An integer as a point that turns: regions of its square give the radii, its digits the rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions import digits as D


def phasor(k: Column, push: bool = False) -> Column:
    """struct(inner_sum, fold_sum, outer_sum, greens, spread, amp, dir, rate_a, rate_b) of an integer, its digits pushed if asked."""

    def of(rows: Column) -> Column:
        total = lambda keep, what: F.aggregate(F.filter(rows, keep), F.lit(0.0), lambda a, s: a + what(s))
        weight = lambda s: F.pow(F.lit(2.0), -s["w"])
        within = lambda region: lambda s: s["region"] == region
        a, b, c = (total(within(r), lambda s: s["v"] * weight(s)) for r in ("inner", "fold", "outer"))
        spread = total(lambda s: (s["region"] == "outer") & (s["v"] == 0), weight)
        runs = F.aggregate(rows, F.struct(F.lit(9).alias("last"), F.lit(0).alias("n")), lambda x, s: F.struct(s["v"].alias("last"), (x["n"] + (x["last"] != s["v"]).cast("int")).alias("n")), lambda x: x["n"])
        fields = F.struct(a.alias("inner_sum"), b.alias("fold_sum"), c.alias("outer_sum"), F.size(F.filter(rows, lambda s: s["v"] == 0)).cast("bigint").alias("greens"), spread.alias("spread"), runs.alias("rate_b"))
        return D.let(fields, lambda f: F.struct(
            *(f[n].alias(n) for n in ("inner_sum", "fold_sum", "outer_sum", "greens", "spread")),
            (F.abs(f["fold_sum"]) + F.greatest(F.abs(f["inner_sum"]), F.abs(f["outer_sum"]))).alias("amp"),
            F.when(f["fold_sum"] != 0, F.signum(f["fold_sum"])).when(k < 0, -1).otherwise(1).cast("int").alias("dir"),
            F.when(k == 0, 1).otherwise(F.length(D.bits(k))).cast("int").alias("rate_a"), f["rate_b"].alias("rate_b"),
        ))

    return D.let(D.rows_of(D.push(D.hex_cells(k)) if push else D.hex_cells(k)), of)


def wavelength(value: Column) -> Column:
    """Nanometres of a value's colour."""
    return 380 + F.least(F.lit(1.0), F.abs(value)) * 350


def shown_wavelength(value: Column) -> Column:
    """wavelength() to three decimals, from its six: halves of the value as stored go up, as in SQL."""
    return F.floor(F.round(wavelength(value), 6) * 1000 + 0.5) / 1000


def point(p: Column, phase: Column, t: Column) -> Column:
    """struct(x, y, z) of a phasor at time t: A is longitude, B latitude; Inner reaches north, Outer south."""
    a = phase + p["dir"] * p["rate_a"] * t
    b = phase + F.when(p["dir"] < 0, F.pi()).otherwise(0.0) + p["dir"] * p["rate_b"] * t
    m, d, r = (p["inner_sum"] + p["outer_sum"]) / 2, (p["inner_sum"] - p["outer_sum"]) / 2, p["fold_sum"] * F.cos(b)
    return F.struct((r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), (m * F.sin(b) + d * F.abs(F.sin(b))).alias("z"))


def operand_phase(item: Column, items: Column, operand: Column, operands: Column) -> Column:
    """Degrees of an operand: items part the turn of their card, operands the turn of their item, which starts at its phase."""
    return F.lit(360.0) * item / items + F.lit(360.0) * operand / operands


def sites(n: Column) -> Column:
    """n points spread over the unit sphere: structs x, y, z, each a golden angle on from the one before, equal steps down."""
    angle = F.lit(3.0 - 5.0**0.5) * F.pi()

    def site(i: Column) -> Column:
        z = F.when(n == 1, F.lit(0.0)).otherwise(1 - (2 * i + 1) / n)
        r = F.sqrt(1 - z * z)
        return F.struct((r * F.cos(angle * i)).alias("x"), (r * F.sin(angle * i)).alias("y"), z.alias("z"))

    return F.transform(F.sequence(F.lit(0), n - 1), site)


def of_cells(cells: Column, sign: Column) -> Column:
    """phasor() of any digits: the fold's sign turns it, else the sign given; its rate is the number of its cells."""

    def of(rows: Column) -> Column:
        weight = lambda s: F.pow(F.lit(2.0), -s["w"])
        within = lambda region: lambda s: s["region"] == region
        total = lambda region: F.aggregate(F.filter(rows, within(region)), F.lit(0.0), lambda a, s: a + s["v"] * weight(s))
        runs = F.aggregate(rows, F.struct(F.lit(9).alias("last"), F.lit(0).alias("n")), lambda x, s: F.struct(s["v"].alias("last"), (x["n"] + (x["last"] != s["v"]).cast("int")).alias("n")), lambda x: x["n"])
        fields = F.struct(*(total(r).alias(f"{r}_sum") for r in ("inner", "fold", "outer")), runs.alias("rate_b"))
        return D.let(fields, lambda f: F.struct(f["inner_sum"].alias("inner_sum"), f["fold_sum"].alias("fold_sum"), f["outer_sum"].alias("outer_sum"), F.when(f["fold_sum"] != 0, F.signum(f["fold_sum"])).when(sign < 0, -1).otherwise(1).cast("int").alias("dir"), F.size(rows).alias("rate_a"), f["rate_b"].alias("rate_b")))

    return D.let(D.rows_of(cells), of)
