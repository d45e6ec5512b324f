"""Further queries: facts of a number, dyadic fractions on rings, racks, requests of the text engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from plait.functions import digits as D
from plait.functions import phasor
from plait.operators import api, racks
from plait.plans.numbers import _BASE, _K, _L, frac, orders, table, two

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("q_dyadic_ring", f"WITH {_K}, {_L} SELECT o_orderkey, CASE WHEN k = 0 THEN 0 ELSE CAST(length(bin(abs(k))) - len AS INTEGER) END AS e, CASE WHEN k = 0 THEN '0' WHEN k < 0 THEN replace(rtrim(bin(abs(k)), '0'), '1', '-') ELSE replace(rtrim(bin(k), '0'), '1', '+') END AS cells, {frac('k', two('len'))} AS value FROM kl")
def q_dyadic_ring(spark, sf_dir):
    """A stalk's value with its leading cell lit, on the ring where it then lies, and read back."""
    rows = orders(spark, sf_dir).withColumn("s", D.dyadic_on_ring(F.col("k"), F.size(D.hex_cells(F.col("k")))))
    return rows.select("o_orderkey", F.col("s.e").alias("e"), D.text(F.col("s.d")).alias("cells"), D.on_ring(F.col("s.d"), F.col("s.e")).alias("value"))


@query("q_scientific", "WITH p AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b FROM lineitem WHERE l_suppkey > 0), q AS (SELECT *, 7 + greatest(length(CAST(b AS VARCHAR)) - length(CAST(a AS VARCHAR)), 0) AS k FROM p), r AS (SELECT *, CAST(a::HUGEINT * CAST('1' || repeat('0', k) AS HUGEINT) // b AS VARCHAR) AS s FROM q) SELECT a, b, CASE WHEN a = 0 THEN '0' ELSE s[1] || '.' || substr(s, 2, 5) || '×10' || CASE WHEN length(s) - 1 - k < 0 THEN '⁻' ELSE '' END || translate(CAST(abs(length(s) - 1 - k) AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') END AS text FROM r")
def q_scientific(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey > 0").select(F.col("l_partkey").cast("bigint").alias("a"), F.col("l_suppkey").cast("bigint").alias("b")).distinct()
    return rows.select("a", "b", D.scientific(F.col("a"), F.col("b")).alias("text"))


@query("q_is_dyadic", "SELECT CAST(l_suppkey AS BIGINT) AS den, bit_count(CAST(l_suppkey AS BIGINT)) = 1 AS dyadic FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey > 0)")
def q_is_dyadic(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey > 0").select(F.col("l_suppkey").cast("bigint").alias("den")).distinct()
    return rows.select("den", D.is_dyadic(F.col("den")).alias("dyadic"))


@query("q_colours", f"{_BASE} SELECT o_orderkey, count(*) FILTER (v > 0) AS blue, count(*) FILTER (v = 0) AS green, count(*) FILTER (v < 0) AS red FROM c0 GROUP BY o_orderkey")
def q_colours(spark, sf_dir):
    c = D.colours(D.padded(D.hex_cells(F.col("k"))))
    rows = orders(spark, sf_dir).withColumn("c", c)
    return rows.select("o_orderkey", *(F.regexp_count("c", F.lit(x)).cast("bigint").alias(n) for x, n in (("b", "blue"), ("g", "green"), ("r", "red"))))


@query("q_facts")
def q_facts(spark, sf_dir):
    """One wide row for each number: what its card's first page says."""
    k = F.col("k")
    rows = orders(spark, sf_dir).withColumn("c", D.hex_cells(k)).withColumn("n", D.side(F.size("c"))).withColumn("p", phasor.phasor(k))
    sums = [D.ratio(D.region_sum(F.col("c"), r), F.col("n") * F.col("n")).alias(f"{r}_sum") for r in ("inner", "fold", "outer")]
    return rows.select("o_orderkey", "n", D.text(F.col("c")).alias("cells"), D.commas(F.col("c")).alias("commas"), D.text(D.push(F.col("c"))).alias("push"), D.text(D.spread(F.col("c"))["d"]).alias("spread"), D.value(F.col("c")).alias("value"), *sums, F.col("p.greens").alias("greens"), phasor.shown_wavelength(F.col("p.inner_sum") + F.col("p.fold_sum") + F.col("p.outer_sum")).alias("nm"))


@query("q_frac_phasor")
def q_frac_phasor(spark, sf_dir):
    """Fractions cut to 16 cells as points that turn."""
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey > 0").select(F.col("l_linenumber").cast("bigint").alias("a"), F.col("l_suppkey").cast("bigint").alias("b")).distinct()
    rows = rows.withColumn("s", D.dyadic_stalk(F.col("a"), F.col("b"), 16)).withColumn("p", phasor.of_cells(F.col("s.d"), F.col("a")))
    return rows.select("a", "b", F.col("s.e").alias("e"), F.col("s.exact").alias("exact"), *(F.round(F.col(f"p.{r}_sum"), 9).alias(f"{r}_sum") for r in ("inner", "fold", "outer")), F.col("p.dir").alias("dir"), F.col("p.rate_b").alias("rate_b"))


_RACK = "c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS n, CAST(l_suppkey AS BIGINT) AS k, 4 * ((length(bin(l_suppkey)) + 3) // 4) AS m, l_linenumber FROM lineitem WHERE l_suppkey > 0)"


@query("q_racks", f"WITH {_RACK}, t AS (SELECT l_orderkey, sum(CASE WHEN n % 2 = 0 THEN -k ELSE k END * {two('16 - m')})::HUGEINT AS num FROM c GROUP BY l_orderkey) SELECT l_orderkey, {frac('num', two('16'))} AS value FROM t")
def q_racks(spark, sf_dir):
    """Lines of an order as cards, added and subtracted in turn."""
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey > 0").select("l_orderkey", F.row_number().over(own).alias("at"), "l_suppkey")
    rows = rows.withColumn("op", F.when(F.col("at") % 2 == 0, "-").otherwise("+"))
    return racks.evaluate(rows, "l_orderkey", "at", "l_suppkey", "op").select("l_orderkey", "value")


@query("q_api_sort")
def q_api_sort(spark, sf_dir):
    names = spark.createDataFrame([(w,) for w in "canvas clear cervezas dox knicks kicks".split()], "name string")
    rows = api.sort(names, "name", "en").unionByName(api.sort(names, "name", "en", push="ctx")).unionByName(api.sort(names, "name", axis="spell", push="all"))
    return rows.select("name", "reading", "of", "truncated", F.array_join(F.transform("key", lambda x: x.cast("string")), " ").alias("key"))


@query("q_api_read")
def q_api_read(spark, sf_dir):
    return api.read(spark, "cerveza", "es-ES").unionByName(api.read(spark, "night")).withColumn("codes", F.array_join(F.transform("codes", lambda x: x.cast("string")), " "))


@query("q_api_cards")
def q_api_cards(spark, sf_dir):
    items = api.cards(spark, "hello, 3, 45\ncerveza\na, -a")
    return items.join(api.card_sums(items), "card").select("card", "item", "text", "neg", "is_number", F.array_join(F.transform("codes", lambda x: x.cast("string")), " ").alias("codes"), F.col("number").cast("string").alias("number"), F.col("sum_as_coded").cast("string").alias("sum_as_coded"), F.col("signed_sum").cast("string").alias("signed_sum"))


@query("q_horizon", "SELECT CAST(e AS INTEGER) AS e, CAST(w AS INTEGER) AS w, CAST((CAST(1 AS BIGINT) << (e + w)) - (CAST(1 AS BIGINT) << e) AS BIGINT) AS bound_scaled FROM (SELECT unnest(range(8)) AS e), (SELECT unnest([4, 8, 16]) AS w)")
def q_horizon(spark, sf_dir):
    """How far a stalk of w cells on ring e reaches: 2^e - 2^(e-w), here times 2^w."""
    rows = spark.range(8).select(F.col("id").cast("int").alias("e"), F.explode(F.array(*(F.lit(w) for w in (4, 8, 16)))).alias("w"))
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    return rows.select("e", "w", (one(F.col("e") + F.col("w")) - one(F.col("e"))).alias("bound_scaled"))
