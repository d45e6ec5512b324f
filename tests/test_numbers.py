"""Goldens and invariants of signed-digit numbers."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plait.functions import arithmetic as A
from plait.functions import digits as D

STALKS = {0: "0", 1: "000+", 2: "00+0", 3: "00++", 7: "0+++", 8: "+000", 15: "++++", 16: "000+0000", 255: "++++++++", 6: "0++0", -6: "0--0"}
PUSHED = {1: "+---", 2: "+--0", 3: "+--+", 7: "+-++", 8: "+000", 15: "++++", 16: "+---0000", 255: "++++++++"}
VALUES = {1: "1/16", 2: "1/8", 3: "3/16", 7: "7/16", 8: "1/2", 15: "15/16", 16: "1/16", 255: "255/256", 22339: "22339/65536", -22339: "-22339/65536", 0: "0"}
EDGES = [0, 1, -1, 2, -2, 8, 15, 16, 255, 256, 65535, 65536, 4294967295, 4294967296, 1099511627775]


def column(spark, ks, **columns):
    rows = spark.createDataFrame([(k,) for k in ks], "k long")
    return {r.k: r for r in rows.select("k", *(c.alias(n) for n, c in columns.items())).collect()}


def test_goldens(spark):
    k = F.col("k")
    got = column(spark, {*STALKS, *PUSHED, *VALUES}, cells=D.text(D.hex_cells(k)), push=D.text(D.push(D.hex_cells(k))), value=D.value(D.hex_cells(k)))
    assert all(got[i].cells == s for i, s in STALKS.items())
    assert all(got[i].push == s for i, s in PUSHED.items())
    assert all(got[i].value == s for i, s in VALUES.items())


def test_commas_regions_and_colours(spark):
    k = F.col("k")
    c = D.hex_cells(k)
    got = column(spark, [3, -3], commas=D.commas(c), colours=D.colours(c), **{r: D.ratio(D.region_sum(c, r), F.lit(4)) for r in ("inner", "fold", "outer")})
    assert got[3].commas == "0,0+,+" and got[3].colours == "ggbb" and got[-3].colours == "ggrr"
    assert (got[3].inner, got[3].fold, got[3].outer) == ("0", "1/8", "1/16")


def pushed(d):
    d, moved = list(d), True
    while moved:
        moved = False
        for i in range(len(d) - 1, 0, -1):
            if d[i] and not d[i - 1]:
                d[i - 1], d[i], moved = d[i], -d[i], True
    return d


def test_push_is_the_fixpoint(spark):
    r = random.Random(1)
    rows = [[r.choice((-1, 0, 0, 1)) for _ in range(r.randint(1, 24))] for _ in range(400)]
    frame = spark.createDataFrame([(x,) for x in rows], "c array<int>")
    for x in frame.select("c", D.push(F.col("c")).alias("p"), D.push(D.push(F.col("c"))).alias("q"), D.numerator(F.col("c")).alias("a"), D.numerator(D.push(F.col("c"))).alias("b")).collect():
        assert x.p == x.q == pushed(x.c) and x.a == x.b


def test_spread(spark):
    got = column(spark, [2, 3, 8, -16, 0], s=D.spread(D.hex_cells(F.col("k"))))
    assert (got[2].s.d, got[2].s.bar, got[2].s.at, got[2].s.short) == ([0, 0, 0, 1], True, 3, 1)
    assert not got[3].s.bar and got[8].s.d == [0, 1, 1, 1] and got[-16].s.d == [0, 0, 0, 0, -1, -1, -1, -1] and not got[0].s.bar


def test_products_and_quotients_on_edges(spark):
    pairs = [(a, b) for a in EDGES for b in EDGES]
    frame = spark.createDataFrame(pairs, "a long, b long")
    x, y = D.hex_cells(F.col("a")), D.hex_cells(F.col("b"))
    small = frame.where("abs(a) < 4294967296 and abs(b) < 4294967296")
    for r in small.select("a", "b", D.ratio(A.product_numerator(x, y), F.size(x) + F.size(y)).alias("p"), A.product_digits(x, y).alias("d"), F.size(x).alias("m"), F.size(y).alias("n"), A.squash(x, y).alias("s")).collect():
        want = Fraction(r.a, 2**r.m) * Fraction(r.b, 2**r.n)
        assert Fraction(r.p) == want and len(r.d) == r.m + r.n and len(r.s) == r.m + r.n - 1
        assert sum(Fraction(v, 2 ** (i + 1)) for i, v in enumerate(r.d)) == want
        assert sum(Fraction(v, 2 ** (i + 2)) for i, v in enumerate(r.s)) == want
    for w in (4, 11, 24):
        d = A.divide_integers(F.col("a"), F.col("b"), F.lit(w))
        for r in frame.select("a", "b", F.size(x).alias("m"), F.size(y).alias("n"), d.alias("d")).collect():
            if r.b == 0:
                assert r.d is None
                continue
            a, b, q = Fraction(r.a, 2**r.m), Fraction(r.b, 2**r.n), Fraction(int(r.d.q), 2**w)
            assert a == Fraction(2) ** r.d.e * q * b + Fraction(int(r.d.r_num), 2**r.d.r_places)
            assert abs(q) < 1 and (r.a == 0 or abs(a / b) < Fraction(2) ** r.d.e and not abs(a / b) < Fraction(2) ** (r.d.e - 1))


def test_division_goldens(spark):
    d = lambda w: A.divide_integers(F.lit(3).cast("long"), F.lit(10).cast("long"), F.lit(w))
    for w, q, r in ((4, "+00+", "3/256"), (8, "+00++00+", "3/4096")):
        got = spark.range(1).select(D.text(A.digits_of_integer(d(w)["q"], F.lit(w))).alias("q"), d(w)["e"].alias("e"), D.ratio(d(w)["r_num"], d(w)["r_places"]).alias("r")).first()
        assert (got.q, got.e, got.r) == (q, -1, r)


def test_full_square_squashes_to_arcs(spark):
    for n in range(1, 13):
        one = F.array_repeat(F.lit(1), n)
        got = spark.range(1).select(A.squash(one, one).alias("s"), D.arcs(F.lit(n)).alias("a")).first()
        assert got.s == got.a


def test_255_squared(spark):
    c = D.hex_cells(F.lit(255).cast("long"))
    got = spark.range(1).select(A.squash(c, c).alias("s"), D.text(A.product_digits(c, c)).alias("d"), A.owed(A.squash(c, c)).alias("o")).first()
    assert got.s == [1, 2, 3, 4, 5, 6, 7, 8, 7, 6, 5, 4, 3, 2, 1] and got.d == "+++++++00000000+" and got.o == 13


def test_parse(spark):
    texts = {"0x1F": 31, "-0b101": -5, "1,000": 1000, " -42 ": -42, "1_0": 10, "--1": None, "abc": None, "": None, "0x": None, "1.5": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.parse(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == texts


def test_align_between_rings(spark):
    from plait.operators.alignment import align

    rows = spark.createDataFrame([(1, [1] * 8, 0), (1, [1] * 8, 0), (2, [1, 0, 1], 3), (2, [1], 1), (3, [0, 0], 0), (4, [1, 0, 0, 0], 4)], "g int, d array<int>, e int")
    got = {r.g: r for r in align(rows, ["g"]).collect()}
    assert (got[1].sums, got[1].owed, got[1].total) == ([2] * 8, 8, "255/128")
    assert got[2].total == "6" and got[3].total == "0" and got[3].sums == []
    assert got[4].total == "8" and got[4].hi == -3


@pytest.mark.parametrize("width", [16])
def test_cut_fractions(spark, width):
    rows = spark.createDataFrame([(1, 3), (2, 3), (-1, 3), (5, 2), (1, 4), (0, 7)], "a long, b long")
    got = {(r.a, r.b): r.s for r in rows.select("a", "b", D.dyadic_stalk(F.col("a"), F.col("b"), width).alias("s")).collect()}
    assert "".join(map(str, got[1, 3].d)) == "0101010101010101" and "".join(map(str, got[2, 3].d)) == "1010101010101010"
    assert got[5, 2].e == 2 and got[5, 2].exact and not got[-1, 3].exact
    for (a, b), s in got.items():
        value = sum(Fraction(v, 2 ** (i + 1)) for i, v in enumerate(s.d)) * 2**s.e
        rest = Fraction(int(s.rem_num), int(s.rem_den)) * Fraction(2) ** (s.e - width)
        assert value + rest == Fraction(a, b)
