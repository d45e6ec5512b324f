"""Exact arithmetic on digit arrays: products as grids, quotients with remainders, all without rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions import digits as D
from plait.functions.digits import EXACT, let, pow2


def bits_of(n: Column) -> Column:
    """The binary digits of an exact non-negative integer, as text, up to 124."""

    def of(x: Column) -> Column:
        low = (x % D.whole(1 << 62)).cast("bigint")
        high = ((x - low.cast(EXACT)) / D.whole(1 << 62)).cast(EXACT).cast("bigint")
        return F.when(high == 0, F.bin(low)).otherwise(F.concat(F.bin(high), F.lpad(F.bin(low), 62, "0")))

    return let(n.cast(EXACT), of)


def grid(a: Column, b: Column) -> Column:
    """The product rectangle row by row: a along the columns, b down the rows; structs r, c, v, w, region."""

    def of(p: Column) -> Column:
        fold = F.least(F.size(p["a"]), F.size(p["b"])) - 1
        region = lambda d: F.when(d < fold, "inner").when(d == fold, "fold").otherwise("outer")
        return F.flatten(F.transform(p["b"], lambda y, r: F.transform(p["a"], lambda x, c: F.struct(r.alias("r"), c.alias("c"), (x * y).alias("v"), (r + c + 2).alias("w"), region(r + c).alias("region")))))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def grid_regions(a: Column, b: Column) -> Column:
    """What the regions of the product rectangle of two integers' stalks hold, without its cells: structs region, cells, lit, coarsest.

    coarsest is the least w of the region. Regions without a cell are left out; null where an operand is.
    """

    def of(p: Column) -> Column:
        shift = lambda x, by: F.call_function("shiftright", x, by.cast("int"))
        one = F.lit(1).cast("bigint")
        k = F.least(p["m"], p["n"])  # the fold is diagonal k - 1
        row = lambda r: shift(p["b"], p["n"] - 1 - r).bitwiseAND(one)
        # of a lit row r, the first k - r cells lie in inner and fold, the last of these in the fold
        upto = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0), lambda s, r: s + F.when(row(r) == 1, F.bit_count(shift(p["a"], p["m"] - k + r))).otherwise(0))
        fold = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0), lambda s, r: s + row(r).bitwiseAND(shift(p["a"], p["m"] - k + r)).cast("int"))
        sums = F.struct(k.alias("k"), (p["m"] * p["n"]).alias("all"), upto.alias("upto"), fold.alias("fold"), (F.bit_count(p["a"]) * F.bit_count(p["b"])).alias("lit"))
        part = lambda name, cells, lit, w: F.struct(F.lit(name).alias("region"), cells.cast("bigint").alias("cells"), lit.cast("bigint").alias("lit"), w.cast("int").alias("coarsest"))
        parts = lambda s: F.array(
            part("inner", s["k"] * (s["k"] - 1) / 2, s["upto"] - s["fold"], F.lit(2)),
            part("fold", s["k"], s["fold"], s["k"] + 1),
            part("outer", s["all"] - s["k"] * (s["k"] + 1) / 2, s["lit"] - s["upto"], s["k"] + 2),
        )
        return F.filter(let(sums, parts), lambda x: x["cells"] > 0)

    operands = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"), D.hex_length(a).alias("m"), D.hex_length(b).alias("n"))
    return F.when(a.isNotNull() & b.isNotNull(), let(operands, of))


def squash(a: Column, b: Column) -> Column:
    """The sums of the rectangle's anti-diagonals; the d-th weighs 2^-(d+2)."""

    def of(p: Column) -> Column:
        m, n = F.size(p["a"]), F.size(p["b"])
        one = lambda d: F.aggregate(F.sequence(F.greatest(F.lit(0), d - n + 1), F.least(d, m - 1)), F.lit(0), lambda s, c: s + p["a"][c] * p["b"][d - c])
        return F.transform(F.sequence(F.lit(0), m + n - 2), one)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def owed(sums: Column) -> Column:
    """How many sums are no digits and owe a carry."""
    return F.size(F.filter(sums, lambda s: F.abs(s) > 1))


def product_numerator(a: Column, b: Column) -> Column:
    """The value of the rectangle over 2 to the number of its rows and columns."""
    return D.numerator(squash(a, b))


def product_digits(a: Column, b: Column) -> Column:
    """The rectangle read back as a stalk of as many cells as it has rows and columns."""
    size = (F.size(a) + F.size(b)).cast("int")
    return let(product_numerator(a, b), lambda n: F.transform(F.split(F.lpad(bits_of(D.magnitude(n)), size, "0"), ""), lambda c: c.cast("int") * F.signum(n).cast("int")))


def region_value(sums: Column, fold: Column, region: str) -> Column:
    """The sum of a region of a rectangle as text, from its squashed sums and the diagonal of its fold."""

    def of(s: Column) -> Column:
        keep = {"inner": lambda i: i < fold, "fold": lambda i: i == fold, "outer": lambda i: i > fold}[region]
        return D.ratio(D.numerator(F.transform(s, lambda v, i: F.when(keep(i), v).otherwise(0))), F.size(s) + 1)

    return let(sums, of)


def divide(a_num: Column, a_places: Column, b_num: Column, b_places: Column, width: Column) -> Column:
    """A = 2^e * Q * B + R for A = a_num / 2^a_places, B alike; Q has `width` digits, cut toward zero.

    struct(e, q (the digits of Q as one integer), r_num, r_places); null where B is 0. e is the least with |A/B| < 2^e.
    """

    def of(x: Column) -> Column:
        a, b, p, q, w = D.magnitude(x["a"]), D.magnitude(x["b"]), x["p"], x["q"], x["w"]
        guess = F.length(bits_of(a)) + q - F.length(bits_of(b)) - p

        def on(g: Column) -> Column:
            fits = (a * pow2(F.greatest(q - p - g, F.lit(0)))).cast(EXACT) < (b * pow2(F.greatest(p + g - q, F.lit(0)))).cast(EXACT)
            return F.when(a == 0, 0).when(fits, g).otherwise(g + 1)

        def done(e: Column) -> Column:
            shift = q - p + w - e
            up, down = (a * pow2(F.greatest(shift, F.lit(0)))).cast(EXACT), (b * pow2(F.greatest(-shift, F.lit(0)))).cast(EXACT)
            rest = (up % down).cast(EXACT)
            sign = (F.signum(x["a"]) * F.signum(x["b"])).cast("int")
            return F.struct(
                e.cast("int").alias("e"), (((up - rest) / down).cast(EXACT) * sign).cast(EXACT).alias("q"),
                (rest * F.signum(x["a"]).cast("int")).cast(EXACT).alias("r_num"), F.when(shift >= 0, q + w - e).otherwise(p).cast("int").alias("r_places"),
            )

        return F.when(b != 0, let(let(guess, on), done))

    fields = {"a": a_num.cast(EXACT), "p": a_places, "b": b_num.cast(EXACT), "q": b_places, "w": width}
    return let(F.struct(*(v.alias(k) for k, v in fields.items())), of)


def divide_integers(a: Column, b: Column, width: Column) -> Column:
    """divide() of the stalks of two integers."""
    cells = lambda k: F.when(k == 0, 1).otherwise((F.ceil(F.length(D.bits(k)) / 4) * 4).cast("int"))
    return divide(a, cells(a), b, cells(b), width)


def digits_of_integer(n: Column, width: Column) -> Column:
    """An exact integer as `width` signed digits."""
    return let(n.cast(EXACT), lambda x: F.transform(F.split(F.lpad(bits_of(D.magnitude(x)), width.cast("int"), "0"), ""), lambda c: c.cast("int") * F.signum(x).cast("int")))


def product_chain(nums: Column, places: Column) -> Column:
    """The value of a product of many stalks as text, from ordered arrays of numerators and places."""
    num = F.aggregate(nums, D.whole(1), lambda a, x: (a * x).cast(EXACT))
    return D.ratio(num, F.aggregate(places, F.lit(0), lambda a, x: a + x))


def division_chain(nums: Column, width: int) -> Column:
    """struct(num, e): the first integer's stalk divided by the others in turn; mantissas carry, exponents add.

    A zero divisor drops its step. The mantissa is num over 2^width (over the first stalk's cells where nothing divided).
    """
    cells = lambda k: F.when(k == 0, 1).otherwise((F.ceil(F.length(D.bits(k)) / 4) * 4).cast("int"))
    first = F.struct(nums[0].cast(EXACT).alias("num"), cells(nums[0]).cast("int").alias("places"), F.lit(0).alias("e"))

    def step(s: Column, k: Column) -> Column:
        made = divide(s["num"], s["places"], k, cells(k), F.lit(width))
        return let(made, lambda m: F.when(m.isNull(), s).otherwise(F.struct(m["q"].alias("num"), F.lit(width).alias("places"), (s["e"] + m["e"]).alias("e"))))

    return F.aggregate(F.slice(nums, 2, 1 << 30), first, step)
