"""Signed-digit numbers as columns: arrays of -1, 0, +1, folded into squares, cut into regions, re-spelled.

All functions take and return Columns and stay inside the JVM. A lambda evaluates what it closes over once for each
element, so arrays that several lambdas share are bound first with let().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def whole(n: int | str) -> Column:
    return F.lit(str(n)).cast(EXACT)


def magnitude(n: Column) -> Column:
    """|n| of an exact integer; abs() and the unary minus of decimals round to 34 digits."""
    return F.greatest(n.cast(EXACT), (whole(0) - n.cast(EXACT)).cast(EXACT))


def parse(text: Column) -> Column:
    """Decimal, 0x or 0b with one leading minus, ignoring blanks, commas and underscores; null for anything else."""
    t = F.regexp_replace(F.trim(text), r"[_,\s]", "")
    body = F.regexp_replace(t, "^-", "")
    value = (
        F.when(body.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(body, 3, 1 << 30), 16, 10))
        .when(body.rlike("^0[bB][01]+$"), F.conv(F.substring(body, 3, 1 << 30), 2, 10))
        .when(body.rlike(r"^[0-9]+$"), body)
    ).cast("bigint")
    return F.when(F.startswith(t, F.lit("-")), -value).otherwise(value)


def bits(k: Column) -> Column:
    """The binary digits of |k| as text."""
    return F.bin(F.abs(k))


def _digits(text: Column, sign: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int") * sign)


def hex_cells(k: Column) -> Column:
    """Most significant first, whole nibbles; zero is one green cell."""
    b = bits(k)
    return F.when(k == 0, F.array(F.lit(0))).otherwise(_digits(F.lpad(b, (F.ceil(F.length(b) / 4) * 4).cast("int"), "0"), F.signum(k).cast("int")))


def hex_length(k: Column) -> Column:
    """The number of hex_cells()."""
    return F.when(k == 0, 1).otherwise((F.ceil(F.length(bits(k)) / 4) * 4).cast("int"))


def exact_bits(k: Column) -> Column:
    """The bits of the magnitude of an exact integer below 2^124, without leading zeros."""

    def of(m: Column) -> Column:
        low = (m % whole(1 << 62)).cast("bigint")
        high = ((m - low.cast(EXACT)) / whole(1 << 62)).cast(EXACT).cast("bigint")
        return F.when(high == 0, F.bin(low)).otherwise(F.concat(F.bin(high), F.lpad(F.bin(low), 62, "0")))

    return let(magnitude(k), of)


def exact_cells(text: Column) -> Column:
    """hex_cells() of an integer written in decimals, below 2^124 in magnitude."""

    def of(k: Column) -> Column:
        return let(exact_bits(k), lambda b: F.when(k == 0, F.array(F.lit(0))).otherwise(_digits(F.lpad(b, (F.ceil(F.length(b) / 4) * 4).cast("int"), "0"), F.signum(k).cast("int"))))

    return let(text.cast(EXACT), of)


def v2_cells(k: Column) -> Column:
    """A reserved green cell, then the bits, least significant first; zero is the reserved cell."""
    return F.when(k == 0, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), _digits(F.reverse(bits(k)), F.signum(k).cast("int"))))


def side(length: Column) -> Column:
    """Side of the smallest square that holds so many cells."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(length))).cast("int")


def padded(cells: Column) -> Column:
    """Green cells up to a full square."""
    return let(cells, lambda c: F.concat(c, F.array_repeat(F.lit(0), (side(F.size(c)) * side(F.size(c)) - F.size(c)).cast("int"))))


def text(cells: Column) -> Column:
    """'+', '0', '-' for each digit."""
    return F.array_join(F.transform(cells, lambda d: F.when(d > 0, "+").when(d < 0, "-").otherwise("0")), "")


def colours(cells: Column) -> Column:
    """b, g, r: the colour classes of +1, 0, -1."""
    return F.array_join(F.transform(cells, lambda d: F.when(d > 0, "b").when(d < 0, "r").otherwise("g")), "")


#: Cells up to which digits are read in 64 bits.
NARROW = 54


def sums_numerator(sums: Column) -> Column:
    """Sums of any size read in base two, in decimals; more than 38 of their digits fail."""
    return F.aggregate(sums, whole(0), lambda a, d: (a * 2 + d).cast(EXACT))


def numerator(cells: Column) -> Column:
    """The digits read in base two; the value is this over 2 to the number of cells. Wide arrays are read in decimals.

    Cells are digits, or sums of at most a hundred digits; sums_numerator() reads others.
    """

    def of(c: Column) -> Column:
        narrow = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, d: a * 2 + d).cast(EXACT)
        return F.when(F.size(c) <= NARROW, narrow).otherwise(sums_numerator(c))

    return let(cells, of)


def pow2(n: Column) -> Column:
    """2 to the n, exactly, for n up to 125."""
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(n, F.lit(62)).cast("int")).cast(EXACT)
    mid = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.least(n - 62, F.lit(62)), F.lit(0)).cast("int")).cast(EXACT)
    return (low * mid).cast(EXACT) * F.when(n > 124, 2).otherwise(1)


def ratio(num: Column, places: Column) -> Column:
    """num / 2^places in lowest terms as text, 'n' where it is whole. num is exact, places not negative."""
    trailing = lambda s: F.length(s) - F.length(F.rtrim(s, F.lit("0")))

    def of(n: Column) -> Column:
        # halves of at most 62 bits, each an exact BIGINT
        low = lambda m: (m % whole(1 << 62)).cast("bigint")
        halves = let(magnitude(n), lambda m: F.struct(low(m).alias("low"), ((m - low(m).cast(EXACT)) / whole(1 << 62)).cast(EXACT).cast("bigint").alias("high")))
        wide = let(halves, lambda h: let(F.least(F.when(h["low"] != 0, trailing(F.bin(h["low"]))).otherwise(62 + trailing(F.bin(h["high"]))), places), lambda k: lowest(n, h, k)))
        return F.when((places < 62) & (n < whole(1 << 62)) & (n > whole(-(1 << 62))), let(n.cast("bigint"), narrow)).otherwise(F.when(n == 0, "0").otherwise(wide))

    def lowest(n: Column, h: Column, k: Column) -> Column:
        right = lambda x, by: F.call_function("shiftright", x, by.cast("int")).cast(EXACT)
        # both halves are shifted by k, as a decimal quotient has room for 32 whole digits only
        upper = (h["high"].cast(EXACT) * pow2(F.greatest(62 - k, F.lit(0)))).cast(EXACT)
        cut = F.when(k < 62, (upper + right(h["low"], k)).cast(EXACT)).otherwise(right(h["high"], k - 62))
        return F.concat(F.when(n < 0, "-").otherwise(""), cut.cast("string"), F.when(places > k, F.concat(F.lit("/"), pow2(places - k).cast("string"))).otherwise(""))

    def narrow(n: Column) -> Column:
        def cut(k: Column) -> Column:
            over = F.when(places > k, F.concat(F.lit("/"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (places - k).cast("int")).cast("string"))).otherwise("")
            return F.concat(F.call_function("shiftright", n, k.cast("int")).cast("string"), over)

        return F.when(n == 0, "0").otherwise(let(F.least(let(F.bin(F.abs(n)), trailing), places), cut))

    return let(num.cast(EXACT), of)


def value(cells: Column) -> Column:
    """The exact value of digits that weigh 1/2, 1/4, ... as text."""
    return let(cells, lambda c: ratio(numerator(c), F.size(c)))


def v2_value(cells: Column) -> Column:
    """The exact value of digits that weigh 1, 1/2, 1/4, ... as text."""
    return let(cells, lambda c: ratio(numerator(c), F.size(c) - 1))


def push(cells: Column) -> Column:
    """Lit cells step left into greens and leave their negative, to the end: the digit to the right that is lit decides.

    With s the first lit digit at or after a cell, the cell becomes -s after a green and s otherwise; without one it stays
    green. The value does not change.
    """

    def step(state: Column, v: Column) -> Column:  # from the right: state is (next lit digit, cells so far)
        return F.struct(F.when(v != 0, v).otherwise(state["next"]).alias("next"), F.concat(F.array(F.when(v != 0, v).otherwise(state["next"])), state["out"]).alias("out"))

    def of(c: Column) -> Column:
        empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))
        nexts = F.aggregate(F.reverse(c), empty, step, lambda s: s["out"])
        return let(nexts, lambda s: F.transform(c, lambda v, i: F.when(s[i] == 0, 0).otherwise(F.when((i > 0) & (F.get(c, i - 1) == 0), -s[i]).otherwise(s[i]))))

    return let(cells, of)


def spread(cells: Column) -> Column:
    """struct(d, bar, at, short): the last lit cell empties and the trailing greens take its sign, barred.

    short is what the finite reading lacks, over 2 to the number of cells. Without trailing greens nothing changes.
    """

    def of(c: Column) -> Column:
        last = F.aggregate(F.transform(c, lambda v, i: F.when(v != 0, i).otherwise(-1)), F.lit(-1), lambda a, i: F.greatest(a, i))

        def done(k: Column) -> Column:
            moves = (k >= 0) & (k < F.size(c) - 1)
            d = F.when(moves, F.transform(c, lambda v, i: F.when(i < k, v).when(i == k, 0).otherwise(c[k]))).otherwise(c)
            return F.struct(d.alias("d"), moves.alias("bar"), F.when(moves, k + 1).otherwise(-1).alias("at"), F.when(moves, c[k]).otherwise(0).alias("short"))

        return let(last, done)

    return let(cells, of)


def arcs(n: Column) -> Column:
    """1, 2, ... n, ... 2, 1."""
    return F.concat(F.sequence(F.lit(1), n), F.when(n > 1, F.reverse(F.sequence(F.lit(1), n - 1))).otherwise(F.array().cast("array<int>")))


def commas(cells: Column) -> Column:
    """The digits as text, a comma after each anti-diagonal of their square."""

    def of(c: Column) -> Column:
        ends = let(arcs(side(F.size(c))), lambda a: F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0), lambda s, y: s + y)))
        return F.array_join(F.filter(let(ends, lambda e: F.transform(e, lambda end, i: text(F.slice(c, F.when(i == 0, 1).otherwise(F.get(e, i - 1) + 1), end - F.when(i == 0, 0).otherwise(F.get(e, i - 1)))))), lambda g: g != ""), ",")

    return let(cells, of)


def hankel_order(n: Column) -> Column:
    """Cells (r, c) of an n by n square by anti-diagonals, each from the bottom left."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.struct((r + c).alias("d"), (-r).alias("up"), r.alias("r"), c.alias("c")))))
    return F.sort_array(cells)


def square(cells: Column) -> Column:
    """Cells laid along the anti-diagonals of the smallest square that holds them, read row by row."""

    def of(c: Column) -> Column:
        n = side(F.size(cells))
        order = F.sort_array(F.transform(hankel_order(n), lambda s, i: F.struct(s["r"].alias("r"), s["c"].alias("c"), i.alias("i"))))
        return F.transform(order, lambda s: F.get(c, s["i"]))

    return let(padded(cells), of)


def diagonal_regions(cells: Column) -> Column:
    """struct(inner, fold, outer): the cells of square() above, on and below its main anti-diagonal, in their order."""

    def of(c: Column) -> Column:
        n = side(F.size(c))
        above = (n * (n - 1) / 2).cast("int")
        return F.struct(F.slice(c, F.lit(1), above).alias("inner"), F.slice(c, above + 1, n).alias("fold"), F.slice(c, above + n + 1, above).alias("outer"))

    return let(padded(cells), of)


def rows_of(cells: Column) -> Column:
    """The cells of the padded square, row by row: structs i, r, c, v, w (weight 2^-w), region."""

    def of(c: Column) -> Column:
        n = side(F.size(c))
        where = lambda i: (F.floor(i / n) + i % n).cast("int")
        region = lambda i: F.when(where(i) < n - 1, "inner").when(where(i) == n - 1, "fold").otherwise("outer")
        return F.transform(c, lambda v, i: F.struct(i.alias("i"), F.floor(i / n).cast("int").alias("r"), (i % n).cast("int").alias("c"), v.alias("v"), (i + 1).alias("w"), region(i).alias("region")))

    return let(padded(cells), of)


def region_sum(cells: Column, region: str) -> Column:
    """The sum of a region of the padded square, over 2 to the number of its cells, as an exact integer."""

    def of(c: Column) -> Column:
        def within(n: Column) -> Column:
            where = lambda i: (i / n).cast("int") + i % n - n + 1
            keep = {"inner": lambda i: where(i) < 0, "fold": lambda i: where(i) == 0, "outer": lambda i: where(i) > 0}[region]
            return numerator(F.transform(c, lambda v, i: F.when(keep(i), v).otherwise(0)))

        return let(side(F.size(c)), within)

    return let(padded(cells), of)


def ring(k: Column) -> Column:
    """The ring of |k| in [2^r, 2^(r+1)); null for 0."""
    return F.when(k != 0, F.length(bits(k)) - 1)


def bit_reverse(x: Column, width: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), width.cast("int"), "0")), 2, 10).cast("bigint")


def slot_of(k: Column) -> Column:
    """The place of |k| on its ring by value."""
    return ((bit_reverse(F.abs(k), ring(k) + 1) - 1) / 2).cast("bigint")


def at_slot(slot: Column, r: Column) -> Column:
    return bit_reverse(2 * slot + 1, r + 1)


def chain(k: Column) -> Column:
    """|k|, then |k| without its last bits one by one."""
    return F.transform(F.sequence(F.lit(0), ring(k)), lambda j: F.call_function("shiftright", F.abs(k), j))


def dyadic_stalk(f_num: Column, f_den: Column, width: int = 24) -> Column:
    """struct(d, e, exact, rem_num, rem_den) of num / den cut to `width` cells on the first ring that holds it, e >= 0."""

    def of(p: Column) -> Column:
        num, den = magnitude(p["n"]), p["d"]
        e = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0), lambda a, i: F.when(num >= den * F.call_function("shiftleft", F.lit(1).cast("bigint"), i).cast(EXACT), i + 1).otherwise(a))

        def on(ring_: Column) -> Column:
            up = (num * pow2(F.lit(width))).cast(EXACT)
            down = (den * pow2(ring_)).cast(EXACT)
            m = ((up - up % down) / down).cast(EXACT)
            rest = (up % down).cast(EXACT)
            d = _digits(F.lpad(F.bin(m.cast("bigint")), width, "0"), F.signum(p["n"]).cast("int"))
            return F.struct(d.alias("d"), ring_.alias("e"), (rest == 0).alias("exact"), (rest * F.signum(p["n"]).cast("int")).cast(EXACT).alias("rem_num"), down.alias("rem_den"))

        return let(e, on)

    return let(F.struct(f_num.cast(EXACT).alias("n"), f_den.cast(EXACT).alias("d")), of)


def is_dyadic(den: Column) -> Column:
    """Whether an exact positive denominator is a power of two."""

    def of(d: Column) -> Column:
        low = (d % whole(1 << 62)).cast("bigint")
        high = ((d - low.cast(EXACT)) / whole(1 << 62)).cast(EXACT).cast("bigint")
        one = lambda x: F.bit_count(x) == 1
        return F.when(high == 0, one(low)).otherwise((low == 0) & one(high))

    return let(den.cast(EXACT), of)


def log2(den: Column) -> Column:
    """The exponent of a power of two up to 2^62."""
    return F.length(F.bin(den.cast("bigint"))) - 1


def dyadic_digits(num: Column, places: Column) -> Column:
    """num / 2^places, inside (-1, 1) and in lowest terms, as its digits; a whole number is one green cell."""
    return F.when(places == 0, F.array(F.lit(0))).otherwise(_digits(F.lpad(F.bin(F.abs(num).cast("bigint")), places.cast("int"), "0"), F.signum(num).cast("int")))


def dyadic_on_ring(num: Column, places: Column) -> Column:
    """struct(d, e) of num / 2^places with the leading cell lit; e may be negative; 0 is one green cell on ring 0."""

    def of(p: Column) -> Column:
        n, k = p["n"], p["k"]
        b = F.bin(F.abs(n))
        e = F.length(b) - k
        twos = F.least(F.length(b) - F.length(F.rtrim(b, F.lit("0"))), k)  # lowest terms have fewer cells
        lit = F.struct(_digits(F.substring(b, F.lit(1), F.length(b) - twos), F.signum(n).cast("int")).alias("d"), e.cast("int").alias("e"))
        return F.when(n == 0, F.struct(F.array(F.lit(0)).alias("d"), F.lit(0).alias("e"))).otherwise(lit)

    return let(F.struct(num.cast("bigint").alias("n"), places.alias("k")), of)


def on_ring(cells: Column, e: Column) -> Column:
    """The value 2^e times a stalk as text."""
    return let(cells, lambda c: ratio((numerator(c) * pow2(F.greatest(e - F.size(c), F.lit(0)))).cast(EXACT), F.greatest(F.size(c) - e, F.lit(0))))


SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def scientific(num: Column, den: Column, figures: int = 6) -> Column:
    """num / den in scientific form with `figures` digits, cut and not rounded, so that it never exceeds the value.

    For integers up to 2^62: the quotient is scaled so that its whole part has figures + 1 digits at least.
    """

    def of(p: Column) -> Column:
        n, d = F.abs(p["n"]).cast(EXACT), p["d"].cast(EXACT)
        k = F.lit(figures + 1) + F.greatest(F.length(d.cast("string")) - F.length(n.cast("string")), F.lit(0))
        scaled = (n * F.rpad(F.lit("1"), (k + 1).cast("int"), "0").cast(EXACT)).cast(EXACT)
        q = ((scaled - scaled % d) / d).cast(EXACT).cast("string")
        e = F.length(q) - 1 - k
        up = F.translate(F.abs(e).cast("string"), "0123456789", SUPERSCRIPTS)
        return F.when(p["n"] == 0, "0").otherwise(F.concat(F.when(p["n"] < 0, "−").otherwise(""), F.substring(q, 1, 1), F.lit("."), F.substring(q, 2, figures - 1), F.lit("×10"), F.when(e < 0, "⁻").otherwise(""), up))

    return let(F.struct(num.alias("n"), den.alias("d")), of)
