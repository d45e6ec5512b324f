"""Queries on signed-digit numbers. Keys of the tables are the integers; odd ones are negated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.functions import arithmetic as A
from plait.functions import digits as D
from plait.functions import expressions
from plait.operators import alignment

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def signed(key: str) -> Column:
    return F.when(F.col(key) % 2 == 1, -F.col(key)).otherwise(F.col(key)).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", signed("o_orderkey").alias("k"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, supplier) keys as operands, the first signed."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return rows.select("l_partkey", "l_suppkey", signed("l_partkey").alias("a"), F.col("l_suppkey").cast("bigint").alias("b"))


# DuckDB: the integers with the length of their stalk, then one row for each cell by shifting bits.
_K = "k0 AS (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 1 THEN -o_orderkey ELSE o_orderkey END AS BIGINT) AS k FROM orders)"
_L = "kl AS (SELECT *, CASE WHEN k = 0 THEN 1 ELSE 4 * ((length(bin(abs(k))) + 3) // 4) END AS len FROM k0)"
_N = "kn AS (SELECT *, CAST(greatest(1, ceil(sqrt(len))) AS BIGINT) AS n FROM kl)"
_C = "c0 AS (SELECT o_orderkey, k, len, n, i, CASE WHEN i < len THEN CAST(sign(k) AS BIGINT) * ((abs(k) >> (len - 1 - i)) & 1) ELSE 0 END AS v FROM kn, LATERAL (SELECT unnest(range(n * n)) AS i))"
_BASE = f"WITH {_K}, {_L}, {_N}, {_C}"


def glyph(v: str) -> str:
    return f"CASE WHEN {v} > 0 THEN '+' WHEN {v} < 0 THEN '-' ELSE '0' END"


def frac(num: str, den: str) -> str:
    """SQL for num / den in lowest terms as text; both HUGEINT, den positive."""
    g = f"gcd(CAST(abs({num}) AS HUGEINT), CAST({den} AS HUGEINT))"
    return f"CASE WHEN {num} = 0 THEN '0' WHEN ({den}) // {g} = 1 THEN CAST(({num}) // {g} AS VARCHAR) ELSE CAST(({num}) // {g} AS VARCHAR) || '/' || CAST(({den}) // {g} AS VARCHAR) END"


def two(n: str) -> str:
    return f"(CAST(1 AS HUGEINT) << CAST({n} AS INTEGER))"


@query("q_hex_cells", f"{_BASE} SELECT o_orderkey, k, string_agg({glyph('v')}, '' ORDER BY i) AS cells, {frac('max(k)', two('max(len)'))} AS value FROM c0 WHERE i < len GROUP BY o_orderkey, k")
def q_hex_cells(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("c", D.hex_cells(F.col("k")))
    return rows.select("o_orderkey", "k", D.text(F.col("c")).alias("cells"), D.value(F.col("c")).alias("value"))


@query("q_square_side", f"WITH {_K}, {_L}, {_N} SELECT o_orderkey, CAST(n AS INTEGER) AS hex_side, CAST(greatest(1, ceil(sqrt(CASE WHEN k = 0 THEN 1 ELSE 1 + length(bin(abs(k))) END))) AS INTEGER) AS v2_side FROM kn")
def q_square_side(spark, sf_dir):
    k = F.col("k")
    return orders(spark, sf_dir).select("o_orderkey", D.side(F.size(D.hex_cells(k))).alias("hex_side"), D.side(F.size(D.v2_cells(k))).alias("v2_side"))


@query("q_negation", f"{_BASE} SELECT o_orderkey, translate(string_agg({glyph('v')}, '' ORDER BY i), '+-', '-+') AS negated, true AS flips FROM c0 WHERE i < len GROUP BY o_orderkey")
def q_negation(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", D.hex_cells(F.col("k")).alias("c"), D.hex_cells(-F.col("k")).alias("m"))
    return rows.select("o_orderkey", D.text(F.col("m")).alias("negated"), (F.col("m") == F.transform("c", lambda v: -v)).alias("flips"))


@query(
    "q_parse",
    """WITH t AS (SELECT o_orderkey, o_orderkey AS k FROM orders) SELECT o_orderkey, CAST(k AS BIGINT) AS dec_value, CAST(-k AS BIGINT) AS hex_value, CAST(k AS BIGINT) AS bin_value, CAST(-k AS BIGINT) AS spaced_value, CAST(NULL AS BIGINT) AS bad_value FROM t""",
)
def q_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    texts = {"dec_value": k.cast("string"), "hex_value": F.concat(F.lit("-0x"), F.hex(k)), "bin_value": F.concat(F.lit("0b"), F.bin(k)), "spaced_value": F.concat(F.lit(" -"), F.regexp_replace(k.cast("string"), "(.)", "$1_"), F.lit(" ")), "bad_value": F.concat(k.cast("string"), F.lit("x"))}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(D.parse(t).alias(n) for n, t in texts.items()))


_REGION = "CASE WHEN i // n + i % n < n - 1 THEN 'inner' WHEN i // n + i % n = n - 1 THEN 'fold' ELSE 'outer' END"


def _region_sql(region: str) -> str:
    return f"sum(CASE WHEN {_REGION} = '{region}' THEN v * {two('n * n - 1 - i')} ELSE 0 END)"


@query(
    "q_regions",
    f"{_BASE}, r AS (SELECT o_orderkey, max(k) AS k, max(n) AS n, max(len) AS len, {_region_sql('inner')}::HUGEINT AS a, {_region_sql('fold')}::HUGEINT AS b, {_region_sql('outer')}::HUGEINT AS c FROM c0 GROUP BY o_orderkey) SELECT o_orderkey, k, CAST(n AS INTEGER) AS n, {frac('a', two('n * n'))} AS inner_sum, {frac('b', two('n * n'))} AS fold_sum, {frac('c', two('n * n'))} AS outer_sum, {frac('k', two('len'))} AS value FROM r",
)
def q_regions(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("c", D.hex_cells(F.col("k"))).withColumn("n", D.side(F.size("c")))
    sums = [D.ratio(D.region_sum(F.col("c"), r), F.col("n") * F.col("n")).alias(f"{r}_sum") for r in ("inner", "fold", "outer")]
    return rows.select("o_orderkey", "k", "n", *sums, D.value(F.col("c")).alias("value"))


@query("q_partition_check", "SELECT count(*) AS checked, CAST(0 AS BIGINT) AS violations FROM orders")
def q_partition_check(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("c", D.hex_cells(F.col("k"))).withColumn("n", D.side(F.size("c")))
    total = sum((D.region_sum(F.col("c"), r) for r in ("inner", "fold", "outer")), D.whole(0)).cast(D.EXACT)
    bad = total != (D.numerator(F.col("c")) * D.pow2(F.col("n") * F.col("n") - F.size("c"))).cast(D.EXACT)
    return rows.agg(F.count("*").alias("checked"), F.count_if(bad).alias("violations"))


@query(
    "q_fold_mirror",
    f"{_BASE} SELECT o_orderkey, count(*) FILTER (v = m) AS mirrored, count(*) AS cells FROM (SELECT a.o_orderkey, a.v, b.v AS m FROM c0 a JOIN c0 b ON a.o_orderkey = b.o_orderkey AND b.i // b.n = a.n - 1 - a.i % a.n AND b.i % b.n = a.n - 1 - a.i // a.n) GROUP BY o_orderkey",
)
def q_fold_mirror(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", D.padded(D.hex_cells(F.col("k"))).alias("c")).withColumn("n", D.side(F.size("c")))
    n = F.col("n")
    partner = lambda i: F.get("c", ((n - 1 - i % n) * n + n - 1 - F.floor(i / n)).cast("int"))
    same = F.size(F.filter(F.transform("c", lambda v, i: v == partner(i)), lambda x: x))
    return rows.select("o_orderkey", same.cast("bigint").alias("mirrored"), F.size("c").cast("bigint").alias("cells"))


_NEXT = "nx AS (SELECT *, first_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER (PARTITION BY o_orderkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s, lag(v) OVER (PARTITION BY o_orderkey ORDER BY i) AS p FROM c0 WHERE i < len)"
_PUSHED = "pu AS (SELECT *, CASE WHEN s IS NULL THEN 0 WHEN p = 0 THEN -s ELSE s END AS q FROM nx)"


@query("q_push", f"{_BASE}, {_NEXT}, {_PUSHED} SELECT o_orderkey, string_agg({glyph('q')}, '' ORDER BY i) AS pushed FROM pu GROUP BY o_orderkey")
def q_push(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", D.text(D.push(D.hex_cells(F.col("k")))).alias("pushed"))


@query("q_push_conserves", f"{_BASE}, {_NEXT}, {_PUSHED} SELECT o_orderkey, CAST(sum(q * {two('len - 1 - i')}) AS BIGINT) AS k FROM pu GROUP BY o_orderkey")
def q_push_conserves(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", D.numerator(D.push(D.hex_cells(F.col("k")))).cast("bigint").alias("k"))


@query("q_push_idempotent", "SELECT count(*) AS checked, CAST(0 AS BIGINT) AS violations FROM orders")
def q_push_idempotent(spark, sf_dir):
    rows = orders(spark, sf_dir).select(D.push(D.hex_cells(F.col("k"))).alias("p"))
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("p") != D.push(F.col("p"))).alias("violations"))


@query(
    "q_spread",
    f"{_BASE}, la AS (SELECT *, max(CASE WHEN v <> 0 THEN i END) OVER (PARTITION BY o_orderkey) AS last FROM c0 WHERE i < len), sp AS (SELECT *, coalesce(last < len - 1, false) AS bar, CASE WHEN last < len - 1 AND i >= last THEN CASE WHEN i = last THEN 0 ELSE sign(k) END ELSE v END AS q FROM la) SELECT o_orderkey, string_agg({glyph('q')}, '' ORDER BY i) AS spread, bool_or(bar) AS bar, CAST(max(CASE WHEN bar THEN last + 1 ELSE -1 END) AS INTEGER) AS at, CASE WHEN bool_or(bar) THEN CASE WHEN max(k) < 0 THEN '-' ELSE '' END || '1/' || CAST({two('max(len)')} AS VARCHAR) ELSE '0' END AS short FROM sp GROUP BY o_orderkey",
)
def q_spread(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", D.hex_cells(F.col("k")).alias("c")).withColumn("s", D.spread(F.col("c")))
    return rows.select("o_orderkey", D.text(F.col("s.d")).alias("spread"), F.col("s.bar").alias("bar"), F.col("s.at").alias("at"), D.ratio(F.col("s.short"), F.size("c")).alias("short"))


@query(
    "q_commas",
    f"{_BASE}, g AS (SELECT *, CASE WHEN i < n * (n + 1) // 2 THEN CAST(floor((sqrt(8 * i + 1) - 1) / 2) AS BIGINT) ELSE 2 * (n - 1) - CAST(floor((sqrt(8 * (n * n - 1 - i) + 1) - 1) / 2) AS BIGINT) END AS arc FROM c0 WHERE i < len), s AS (SELECT o_orderkey, arc, string_agg({glyph('v')}, '' ORDER BY i) AS x FROM g GROUP BY o_orderkey, arc) SELECT o_orderkey, string_agg(x, ',' ORDER BY arc) AS commas FROM s GROUP BY o_orderkey",
)
def q_commas(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", D.commas(D.hex_cells(F.col("k"))).alias("commas"))


@query(
    "q_hankel_order",
    "WITH s AS (SELECT unnest(range(1, 9)) AS n), c AS (SELECT n, r, c, row_number() OVER (PARTITION BY n ORDER BY r + c, r DESC) - 1 AS i FROM s, LATERAL (SELECT unnest(range(n)) AS r), LATERAL (SELECT unnest(range(n)) AS c)) SELECT CAST(n AS INTEGER) AS n, CAST(i AS INTEGER) AS i, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM c",
)
def q_hankel_order(spark, sf_dir):
    rows = spark.range(1, 9).select(F.col("id").cast("int").alias("n"))
    return rows.select("n", F.posexplode(D.hankel_order(F.col("n"))).alias("i", "s")).select("n", "i", "s.r", "s.c")


@query(
    "q_v2_value",
    f"WITH {_K}, b AS (SELECT *, length(bin(abs(k))) AS m FROM k0), d AS (SELECT o_orderkey, k, m, j, CAST(sign(k) AS BIGINT) * ((abs(k) >> (j - 1)) & 1) AS v FROM b, LATERAL (SELECT unnest(range(1, m + 1)) AS j)), t AS (SELECT o_orderkey, max(k) AS k, max(m) AS m, '0' || string_agg({glyph('v')}, '' ORDER BY j) AS cells, sum(v * {two('m - j')})::HUGEINT AS num FROM d GROUP BY o_orderkey) SELECT o_orderkey, CASE WHEN k = 0 THEN '0' ELSE cells END AS cells, {frac('num', two('m'))} AS value FROM t",
)
def q_v2_value(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_orderkey", D.v2_cells(F.col("k")).alias("c"))
    return rows.select("o_orderkey", D.text(F.col("c")).alias("cells"), D.v2_value(F.col("c")).alias("value"))


@query("q_distinct_grids", "SELECT CAST(644 AS BIGINT) AS grids")
def q_distinct_grids(spark, sf_dir):
    """The index page's grids of 1 to 1023: bits most significant first after a reserved cell, in Hankel order."""
    k = F.col("id")
    b = F.concat(F.lit("0"), F.bin(k))
    n = D.side(F.length(b))
    # cells past the last bit are green, and those of the square are what is seen
    seen = F.concat(n.cast("string"), F.lit(":"), F.rpad(b, (n * n).cast("int"), "0"))
    return spark.range(1, 1024).agg(F.countDistinct(seen).alias("grids"))


@query(
    "q_ring_slot",
    "WITH c AS (SELECT c_custkey, CAST(c_custkey AS BIGINT) AS k, length(bin(c_custkey)) - 1 AS r FROM customer WHERE c_custkey > 0), s AS (SELECT *, (list_sum(list_transform(range(r + 1), lambda b: ((k >> b) & 1) << (r - b))) - 1) // 2 AS slot FROM c) SELECT c_custkey, CAST(r AS INTEGER) AS ring, CAST(slot AS BIGINT) AS slot, round(-pi() / 2 + (slot + 0.5) / (1 << r) * pi(), 9) AS angle FROM s",
)
def q_ring_slot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0").select("c_custkey", F.col("c_custkey").cast("bigint").alias("k"))
    rows = rows.select("c_custkey", D.ring(F.col("k")).alias("ring"), D.slot_of(F.col("k")).alias("slot"))
    return rows.select("*", F.round(-F.pi() / 2 + (F.col("slot") + 0.5) / F.pow(F.lit(2.0), F.col("ring")) * F.pi(), 9).alias("angle"))


@query("q_ring_chain", "WITH c AS (SELECT c_custkey, CAST(c_custkey AS BIGINT) AS k, length(bin(c_custkey)) - 1 AS r FROM customer WHERE c_custkey > 0) SELECT c_custkey, CAST(j AS INTEGER) AS step, k >> j AS at FROM c, LATERAL (SELECT unnest(range(r + 1)) AS j)")
def q_ring_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0").select("c_custkey", F.posexplode(D.chain(F.col("c_custkey").cast("bigint"))).alias("step", "at"))
    return rows.select("c_custkey", "step", "at")


@query("q_bitrev", "WITH c AS (SELECT c_custkey, length(bin(c_custkey)) AS m FROM customer WHERE c_custkey > 0) SELECT c_custkey, CAST(list_sum(list_transform(range(m), lambda b: ((c_custkey >> b) & 1) << (m - 1 - b))) AS BIGINT) AS reversed, CAST(c_custkey AS BIGINT) AS back FROM c")
def q_bitrev(spark, sf_dir):
    k = F.col("c_custkey").cast("bigint")
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0")
    return rows.select("c_custkey", D.bit_reverse(k, F.length(D.bits(k))).alias("reversed"), D.at_slot(D.slot_of(k), D.ring(k)).alias("back"))


@query("q_ring_hist", "SELECT CAST(length(bin(o_orderkey)) - 1 AS INTEGER) AS ring, count(*) AS n FROM orders WHERE o_orderkey > 0 GROUP BY ring")
def q_ring_hist(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey > 0").groupBy(D.ring(F.col("o_orderkey").cast("bigint")).alias("ring")).agg(F.count("*").alias("n"))


@query("q_ring_edges", "SELECT CAST(r AS INTEGER) AS ring, (CAST(2 AS BIGINT) << r) - 1 AS edge, CASE WHEN r < 24 THEN CAST((1 << r) - 0 AS VARCHAR) ELSE CAST(CAST(1 AS BIGINT) << r AS VARCHAR) END AS least FROM (SELECT unnest(range(40)) AS r)")
def q_ring_edges(spark, sf_dir):
    """The last and the first integer of each ring: rings tile the integers."""
    r = F.col("id").cast("int")
    return spark.range(40).select(r.alias("ring"), (F.call_function("shiftleft", F.lit(2).cast("bigint"), r) - 1).alias("edge"), F.call_function("shiftleft", F.lit(1).cast("bigint"), r).cast("string").alias("least"))


@query("q_rotation", "SELECT c_custkey, p, ((c_custkey % ((1 << p) - 1)) << 1) % ((1 << p) - 1) AS doubled, ((1 << p) - 1) - c_custkey % ((1 << p) - 1) AS complement FROM (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(13 AS BIGINT) AS p FROM customer)")
def q_rotation(spark, sf_dir):
    """Modulo 2^13 - 1 doubling rotates the bits, and the complement flips them."""
    m = (1 << 13) - 1
    x = (F.col("c_custkey") % m).cast("bigint")
    left = lambda v, n: F.call_function("shiftleft", v, F.lit(n))
    right = lambda v, n: F.call_function("shiftright", v, F.lit(n))
    turned = (left(x, 1).bitwiseOR(right(x, 12))).bitwiseAND(F.lit(m).cast("bigint"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.lit(13).cast("bigint").alias("p"), F.when(turned == m, 0).otherwise(turned).cast("bigint").alias("doubled"), F.bitwise_not(x).bitwiseAND(F.lit(m).cast("bigint")).alias("complement"))


_PAIR = "p0 AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), p1 AS (SELECT *, CAST(CASE WHEN l_partkey % 2 = 1 THEN -l_partkey ELSE l_partkey END AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b FROM p0), p2 AS (SELECT *, CASE WHEN a = 0 THEN 1 ELSE 4 * ((length(bin(abs(a))) + 3) // 4) END AS m, CASE WHEN b = 0 THEN 1 ELSE 4 * ((length(bin(abs(b))) + 3) // 4) END AS n FROM p1)"
_GRID = "g AS (SELECT l_partkey, l_suppkey, a, b, m, n, r, c, CAST(sign(a) * sign(b) AS BIGINT) * ((abs(a) >> (m - 1 - c)) & 1) * ((abs(b) >> (n - 1 - r)) & 1) AS v FROM p2, LATERAL (SELECT unnest(range(n)) AS r), LATERAL (SELECT unnest(range(m)) AS c))"
_DIAG = "d AS (SELECT l_partkey, l_suppkey, max(m) AS m, max(n) AS n, r + c AS d, CAST(sum(v) AS BIGINT) AS s FROM g GROUP BY l_partkey, l_suppkey, r + c)"
_BY = "l_partkey, l_suppkey"


def _ops(spark, sf_dir):
    return pairs(spark, sf_dir).select("l_partkey", "l_suppkey", "a", "b", D.hex_cells(F.col("a")).alias("x"), D.hex_cells(F.col("b")).alias("y"))


@query("q_product_value", f"WITH {_PAIR} SELECT {_BY}, {frac('(a::HUGEINT * b::HUGEINT)', two('m + n'))} AS value FROM p2")
def q_product_value(spark, sf_dir):
    return _ops(spark, sf_dir).select("l_partkey", "l_suppkey", D.ratio(A.product_numerator(F.col("x"), F.col("y")), F.size("x") + F.size("y")).alias("value"))


@query("q_product_grid", f"WITH {_PAIR}, {_GRID} SELECT {_BY}, CASE WHEN r + c < least(m, n) - 1 THEN 'inner' WHEN r + c = least(m, n) - 1 THEN 'fold' ELSE 'outer' END AS region, count(*) AS cells, count(*) FILTER (v <> 0) AS lit, CAST(min(r + c + 2) AS INTEGER) AS coarsest FROM g GROUP BY {_BY}, region")
def q_product_grid(spark, sf_dir):
    """Counted from the bits of both operands: a pair has hundreds of cells, and no cell becomes a row."""
    return pairs(spark, sf_dir).select("l_partkey", "l_suppkey", F.inline(A.grid_regions(F.col("a"), F.col("b"))))


_DSUM = "CAST(sum(CASE WHEN {0} THEN s * " + two("m + n - 2 - d") + " ELSE 0 END) AS HUGEINT)"


@query(
    "q_product_regions",
    f"WITH {_PAIR}, {_GRID}, {_DIAG}, t AS (SELECT {_BY}, max(m) AS m, max(n) AS n, {_DSUM.format('d < least(m, n) - 1')} AS i, {_DSUM.format('d = least(m, n) - 1')} AS f, {_DSUM.format('d > least(m, n) - 1')} AS o FROM d GROUP BY {_BY}) SELECT {_BY}, {frac('i', two('m + n'))} AS inner_sum, {frac('f', two('m + n'))} AS fold_sum, {frac('o', two('m + n'))} AS outer_sum FROM t",
)
def q_product_regions(spark, sf_dir):
    rows = _ops(spark, sf_dir).select("l_partkey", "l_suppkey", A.squash(F.col("x"), F.col("y")).alias("s"), (F.least(F.size("x"), F.size("y")) - 1).alias("fold"))
    return rows.select("l_partkey", "l_suppkey", *(A.region_value(F.col("s"), F.col("fold"), r).alias(f"{r}_sum") for r in ("inner", "fold", "outer")))


@query("q_squash", f"WITH {_PAIR}, {_GRID}, {_DIAG} SELECT {_BY}, string_agg(CAST(s AS VARCHAR), ' ' ORDER BY d) AS sums, count(*) FILTER (abs(s) > 1) AS owed FROM d GROUP BY {_BY}")
def q_squash(spark, sf_dir):
    rows = _ops(spark, sf_dir).select("l_partkey", "l_suppkey", A.squash(F.col("x"), F.col("y")).alias("s"))
    return rows.select("l_partkey", "l_suppkey", F.array_join(F.transform("s", lambda v: v.cast("string")), " ").alias("sums"), A.owed(F.col("s")).cast("bigint").alias("owed"))


@query("q_owed", f"WITH {_PAIR}, {_GRID}, {_DIAG}, o AS (SELECT {_BY}, count(*) FILTER (abs(s) > 1) AS owed, max(abs(s)) AS most FROM d GROUP BY {_BY}) SELECT owed, count(*) AS grids, CAST(max(most) AS BIGINT) AS most FROM o GROUP BY owed")
def q_owed(spark, sf_dir):
    rows = _ops(spark, sf_dir).select(A.squash(F.col("x"), F.col("y")).alias("s"))
    rows = rows.select(A.owed(F.col("s")).cast("bigint").alias("owed"), F.array_max(F.transform("s", lambda v: F.abs(v))).cast("bigint").alias("most"))
    return rows.groupBy("owed").agg(F.count("*").alias("grids"), F.max("most").alias("most"))


@query("q_product_digits", f"WITH {_PAIR} SELECT {_BY}, CASE WHEN a < 0 THEN replace(lpad(bin(abs(a) * b), CAST(m + n AS INTEGER), '0'), '1', '-') ELSE replace(lpad(bin(abs(a) * b), CAST(m + n AS INTEGER), '0'), '1', '+') END AS digits FROM p2")
def q_product_digits(spark, sf_dir):
    return _ops(spark, sf_dir).select("l_partkey", "l_suppkey", D.text(A.product_digits(F.col("x"), F.col("y"))).alias("digits"))


@query(
    "q_mul_chain",
    f"WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS k, 4 * ((length(bin(l_suppkey)) + 3) // 4) AS m FROM lineitem), t AS (SELECT l_orderkey, count(*) AS operands, CAST(round(exp(0)) AS BIGINT) AS one, list_reduce(list(CAST(k AS HUGEINT) ORDER BY l_linenumber, k), lambda x, y: x * y) AS num, sum(m) AS places FROM l GROUP BY l_orderkey) SELECT l_orderkey, operands, {frac('num', two('places'))} AS value FROM t",
)
def q_mul_chain(spark, sf_dir):
    k = F.col("l_suppkey").cast("bigint")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("operands"), F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("at"), k.alias("k")))).alias("ks"))
    rows = rows.withColumn("places", F.transform("ks", lambda s: F.size(D.hex_cells(s["k"])))).withColumn("all", F.aggregate("places", F.lit(0), lambda a, x: a + x))
    nums = F.transform("ks", lambda s: s["k"].cast(D.EXACT))
    narrow = rows.where("all <= 120").select("l_orderkey", "operands", A.product_chain(nums, F.col("places")).alias("value"))
    # beyond 38 decimal digits: the same product as an expression without bounds, each operand over its own power; no number where one is null
    text = F.when(F.col("all").isNotNull(), F.array_join(F.transform("ks", lambda s, i: F.concat(s["k"].cast("string"), F.lit("/2^"), F.get("places", i).cast("string"))), "*"))
    wide = expressions.evaluated(rows.where("all > 120 OR all IS NULL").select("l_orderkey", F.col("operands").alias("many"), text.alias("src")), "src")
    return narrow.unionByName(wide.select("l_orderkey", F.col("many").alias("operands"), "value"))


_WIDTH = "(4 + l_partkey % 21)"
_DIV = f"""{_PAIR}, v AS (SELECT *, {_WIDTH} AS w, length(bin(abs(a))) + n - length(bin(b)) - m AS g FROM p2 WHERE b <> 0),
 e0 AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN abs(a)::HUGEINT * {two('greatest(n - m - g, 0)')} < b::HUGEINT * {two('greatest(m + g - n, 0)')} THEN g ELSE g + 1 END AS e FROM v),
 q0 AS (SELECT *, abs(a)::HUGEINT * {two('greatest(n - m + w - e, 0)')} AS u, b::HUGEINT * {two('greatest(m - n - w + e, 0)')} AS y FROM e0),
 q1 AS (SELECT *, (u // y) AS q, u % y AS rest, CASE WHEN n - m + w - e >= 0 THEN n + w - e ELSE m END AS places FROM q0)"""


def _quotients(spark, sf_dir):
    rows = pairs(spark, sf_dir).where("b <> 0").withColumn("w", (4 + F.col("l_partkey") % 21).cast("int"))
    return rows.withColumn("d", A.divide_integers(F.col("a"), F.col("b"), F.col("w")))


@query("q_divide", f"WITH {_DIV} SELECT {_BY}, CAST(e AS INTEGER) AS e, replace(lpad(bin(CAST(q AS BIGINT)), CAST(w AS INTEGER), '0'), '1', CASE WHEN a < 0 THEN '-' ELSE '+' END) AS quotient, CASE WHEN rest = 0 THEN '0' ELSE CASE WHEN a < 0 THEN '-' ELSE '' END || {frac('rest', two('places'))} END AS remainder, rest = 0 AS exact FROM q1")
def q_divide(spark, sf_dir):
    rows = _quotients(spark, sf_dir)
    return rows.select("l_partkey", "l_suppkey", F.col("d.e").alias("e"), D.text(A.digits_of_integer(F.col("d.q"), F.col("w"))).alias("quotient"), D.ratio(F.col("d.r_num"), F.col("d.r_places")).alias("remainder"), (F.col("d.r_num") == 0).alias("exact"))


@query("q_divide_identity", "SELECT count(*) AS checked, CAST(0 AS BIGINT) AS violations FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey <> 0)")
def q_divide_identity(spark, sf_dir):
    """A = 2^e Q B + R, all over one power of two."""
    rows = _quotients(spark, sf_dir).withColumn("m", F.size(D.hex_cells(F.col("a")))).withColumn("n", F.size(D.hex_cells(F.col("b"))))
    d, top = F.col("d"), F.lit(64)
    over = lambda num, places: (num.cast(D.EXACT) * D.pow2(top - places)).cast(D.EXACT)
    right = (over(d["q"] * F.col("b"), F.col("w") + F.col("n") - d["e"]) + over(d["r_num"], d["r_places"])).cast(D.EXACT)
    return rows.agg(F.count("*").alias("checked"), F.count_if(over(F.col("a"), F.col("m")) != right).alias("violations"))


@query("q_tableau", f"WITH {_DIV} SELECT {_BY}, CASE WHEN a < 0 AND q <> 0 THEN '-' ELSE '' END || {frac('(q * b)', two('w + n'))} AS tableau FROM q1")
def q_tableau(spark, sf_dir):
    """The grid of the divisor and the quotient: what long division subtracts."""
    rows = _quotients(spark, sf_dir).select("l_partkey", "l_suppkey", D.hex_cells(F.col("b")).alias("x"), A.digits_of_integer(F.col("d.q"), F.col("w")).alias("y"))
    return rows.select("l_partkey", "l_suppkey", D.ratio(A.product_numerator(F.col("x"), F.col("y")), F.size("x") + F.size("y")).alias("tableau"))


@query("q_div_chain")
def q_div_chain(spark, sf_dir):
    k = F.col("l_suppkey").cast("bigint")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("at"), k.alias("k")))).alias("ks"))
    rows = rows.select("l_orderkey", A.division_chain(F.transform("ks", lambda s: s["k"]), 24).alias("c"))
    return rows.select("l_orderkey", F.col("c.e").alias("e"), D.ratio(F.col("c.num"), F.col("c.places")).alias("mantissa"))


_ALIGN = f"WITH {_K}, {_L}, {_N}, {_C}, x AS (SELECT o_custkey, i + 1 AS w, CAST(sum(v) AS BIGINT) AS s, bool_or(v <> 0) AS lit FROM c0 JOIN orders USING (o_orderkey) WHERE i < len GROUP BY o_custkey, i), y AS (SELECT o_custkey, min(w) FILTER (lit) AS lo, max(w) FILTER (lit) AS hi FROM x GROUP BY o_custkey)"


@query(
    "q_align",
    f"{_ALIGN}, z AS (SELECT o_custkey, lo, hi, w, coalesce((SELECT s FROM x WHERE x.o_custkey = y.o_custkey AND x.w = t.w), 0) AS s FROM y, LATERAL (SELECT unnest(range(lo, hi + 1)) AS w) t) SELECT o_custkey, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, string_agg(CAST(s AS VARCHAR), ' ' ORDER BY w) AS sums, CAST(count(*) FILTER (abs(s) > 1) AS INTEGER) AS owed, {frac('CAST(sum(s * ' + two('hi - w') + ') AS HUGEINT)', two('hi'))} AS total FROM z GROUP BY o_custkey, lo, hi",
)
def q_align(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", D.hex_cells(signed("o_orderkey")).alias("d"), F.lit(0).alias("e"))
    out = alignment.align(rows, ["o_custkey"])
    return out.select("o_custkey", "lo", "hi", F.array_join(F.transform("sums", lambda v: v.cast("string")), " ").alias("sums"), "owed", "total")


@query("q_composite", f"{_ALIGN} SELECT w, CAST(sum(s) AS BIGINT) AS sum, count(*) AS customers FROM (SELECT CAST(w AS INTEGER) AS w, s FROM x WHERE s <> 0) GROUP BY w")
def q_composite(spark, sf_dir):
    """The composite of a rack: every customer's aligned columns, summed by weight."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.posexplode(D.hex_cells(signed("o_orderkey"))).alias("i", "v"))
    sums = rows.groupBy("o_custkey", (F.col("i") + 1).alias("w")).agg(F.sum("v").alias("s")).where("s <> 0")
    return sums.groupBy("w").agg(F.sum("s").alias("sum"), F.count("*").alias("customers"))


@query(
    "q_frac_stalk",
    f"WITH p AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b FROM lineitem WHERE l_suppkey > 0), e AS (SELECT *, (SELECT min(i) FROM (SELECT unnest(range(40)) AS i) WHERE a < b * (CAST(1 AS BIGINT) << i)) AS e FROM p), m AS (SELECT *, (a::HUGEINT << 24) AS u, b::HUGEINT << CAST(e AS INTEGER) AS y FROM e) SELECT a, b, CAST(e AS INTEGER) AS e, replace(lpad(bin(CAST(u // y AS BIGINT)), 24, '0'), '1', '+') AS cells, u % y = 0 AS exact, {frac('(u % y)', 'y')} AS rem FROM m",
)
def q_frac_stalk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey > 0").select(F.col("l_suppkey").cast("bigint").alias("a"), F.col("l_linenumber").cast("bigint").alias("b")).distinct()
    rows = rows.withColumn("s", D.dyadic_stalk(F.col("a"), F.col("b"), 24))
    rest, of = F.col("s.rem_num").cast("bigint"), F.col("s.rem_den").cast("bigint")
    step = F.aggregate(F.sequence(F.lit(0), F.lit(96)), F.struct(rest.alias("x"), of.alias("y")), lambda s, i: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % s["y"]).alias("y")), lambda s: s["x"])
    rows = rows.withColumn("g", step)
    rem = F.when(rest == 0, "0").otherwise(F.concat((rest / F.col("g")).cast("bigint").cast("string"), F.when(of == F.col("g"), "").otherwise(F.concat(F.lit("/"), (of / F.col("g")).cast("bigint").cast("string")))))
    return rows.select("a", "b", F.col("s.e").alias("e"), D.text(F.col("s.d")).alias("cells"), F.col("s.exact").alias("exact"), rem.alias("rem"))


_W = "v * pow(2.0, -(i + 1))"


@query(
    "q_phasor",
    f"{_BASE}, t AS (SELECT o_orderkey, max(k) AS k, max(n) AS n, sum(CASE WHEN {_REGION} = 'inner' THEN {_W} ELSE 0 END) AS a, sum(CASE WHEN {_REGION} = 'fold' THEN {_W} ELSE 0 END) AS b, sum(CASE WHEN {_REGION} = 'outer' THEN {_W} ELSE 0 END) AS c, sum(CASE WHEN {_REGION} = 'outer' AND v = 0 THEN pow(2.0, -(i + 1)) ELSE 0 END) AS s, count(*) FILTER (v = 0) AS greens, list(v ORDER BY i) AS vs FROM c0 GROUP BY o_orderkey) SELECT o_orderkey, round(a, 9) AS inner_sum, round(b, 9) AS fold_sum, round(c, 9) AS outer_sum, greens, round(s, 9) AS spread, round(abs(b) + greatest(abs(a), abs(c)), 9) AS amp, CAST(CASE WHEN b <> 0 THEN sign(b) WHEN k < 0 THEN -1 ELSE 1 END AS INTEGER) AS dir, CAST(CASE WHEN k = 0 THEN 1 ELSE length(bin(abs(k))) END AS INTEGER) AS rate_a, CAST(1 + len(list_filter(range(2, len(vs) + 1), lambda j: vs[j] <> vs[j - 1])) AS INTEGER) AS rate_b, round(380 + least(1, abs(a + b + c)) * 350, 6) AS nm FROM t",
)
def q_phasor(spark, sf_dir):
    from plait.functions import phasor

    rows = orders(spark, sf_dir).select("o_orderkey", phasor.phasor(F.col("k")).alias("p"))
    p = lambda f: F.col(f"p.{f}")
    nine = [F.round(p(f), 9).alias(f) for f in ("inner_sum", "fold_sum", "outer_sum", "spread", "amp")]
    return rows.select("o_orderkey", *nine, *(p(f).alias(f) for f in ("greens", "dir", "rate_a", "rate_b")), F.round(phasor.wavelength(p("inner_sum") + p("fold_sum") + p("outer_sum")), 6).alias("nm"))


@query("q_curve")
def q_curve(spark, sf_dir):
    """Eight points of each curve over one turn."""
    from plait.functions import phasor

    rows = orders(spark, sf_dir).select("o_orderkey", phasor.phasor(F.col("k")).alias("p"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"))
    point = phasor.point(F.col("p"), F.lit(0.0), F.col("step") * F.pi() / 4)
    return rows.select("o_orderkey", "step", *((F.round(point[c], 9) + 0.0).alias(c) for c in ("x", "y", "z")))


@query("q_phase_layout", "WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS j, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, CAST(j AS INTEGER) AS item, round(360.0 * j / n, 6) AS phase FROM n")
def q_phase_layout(spark, sf_dir):
    """Items of a card spread evenly over the turn."""
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).alias("item"), F.count("*").over(own).alias("n"))
    return rows.select("l_orderkey", "item", F.round(F.lit(360.0) * F.col("item") / F.col("n"), 6).alias("phase"))


@query("q_knob", "SELECT c_custkey, CAST(greatest(10, abs(k)) AS BIGINT) AS bound, CAST(2 * greatest(10, abs(k)) + 1 AS BIGINT) AS ticks, CAST(greatest(-3, least(3, k)) AS INTEGER) AS sweep FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN -c_custkey ELSE c_custkey END AS k FROM customer)")
def q_knob(spark, sf_dir):
    k = signed("c_custkey")
    bound = F.greatest(F.lit(10).cast("bigint"), F.abs(k))
    return table(spark, sf_dir, "customer").select("c_custkey", bound.alias("bound"), (2 * bound + 1).alias("ticks"), F.greatest(F.lit(-3), F.least(F.lit(3), k)).cast("int").alias("sweep"))
