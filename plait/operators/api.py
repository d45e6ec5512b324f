"""What a caller asks of the text engine, as functions that return DataFrames: read, sort, cards, ipa, base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.functions import alphabet, ipa, phonetics
from plait.functions import words as W
from plait.sources import tables

# Bounds of a request.
MOST_TEXT, MOST_LANG, MOST_AXIS, MOST_ITEMS, MOST_PUSH, MOST_POSITIONS = 4000, 64, 8, 48, 64, 24


def _bounded(q: str, lang: str = "", *axes: str) -> None:
    if len(q) > MOST_TEXT or len(lang) > MOST_LANG or any(len(a) > MOST_AXIS for a in axes):
        raise ValueError("the request is too long")


def read(spark: SparkSession, q: str, lang: str = "") -> DataFrame:
    """position, grapheme, branch, reading, ipa, langs, codes: every branch of each grapheme that the request keeps.

    A language here takes its own tag and its bare language, so a bare one takes no regions; what nothing answers is
    kept whole.
    """
    _bounded(q, lang)
    want = {t for x in lang.split() for t in (x, x.split("-")[0])}
    accept = W.tags(want | {phonetics.ANY}) if lang else None
    word = F.col("q")
    rows = spark.createDataFrame([(q,)], "q string").select(W.segments(word).alias("s"), W.branches(word, accept).alias("b"))
    rows = rows.select(F.posexplode(F.arrays_zip("s", "b")).alias("position", "x")).select("position", F.col("x.s").alias("grapheme"), F.col("x.b").alias("b"))
    kept = F.filter("b", lambda b: (b["bad"] == F.col("b")[0]["bad"]) & (b["foreign"] == F.col("b")[0]["foreign"]))
    rows = rows.select("position", "grapheme", F.posexplode(kept).alias("branch", "r"))
    return rows.select("position", "grapheme", "branch", F.col("r.rom").alias("reading"), F.col("r.ipa").alias("ipa"), W.letters(F.col("r.rom")).alias("codes"))


def positions(spark: SparkSession, q: str, lang: str = "") -> DataFrame:
    """n, reading, key: the first positions that a string occupies."""
    _bounded(q, lang)
    rows = spark.createDataFrame([(q,)], "q string").select("q", F.explode(F.array_distinct(F.transform(W.readings(F.col("q"), lang or None), lambda p: F.array_join(p, "")))).alias("reading"))
    rows = rows.withColumn("key", W.key(F.col("q"), F.col("reading"))).orderBy("key").limit(MOST_POSITIONS)
    return rows.select((F.row_number().over(Window.orderBy("key")) - 1).alias("n"), "reading", "key")


def sort(names: DataFrame, column: str, lang: str = "", axis: str = "sound", push: str = "", alphabet_name: str = "base") -> DataFrame:
    """column, reading, key, of, truncated of names, to be ordered by (key, column).

    Unpushed: one row a name. Pushed by sound ("ctx" in context, "all" out of it) or by spelling: a row for each variant,
    at most MOST_PUSH a name, the lowest; of says how many there are. alphabet_name "ipa" orders by sounds first.
    """
    name = F.col(column)
    if push and axis == "spell":
        rows = names.withColumn("reading", F.explode(F.array_distinct(W.spellings(name)))).withColumn("ipa", F.lit(""))
    elif push:
        many = F.transform(W.readings(name, lang or None, push != "all"), lambda p: F.array_join(p, ""))
        rows = names.withColumn("reading", F.explode(F.array_distinct(many))).withColumn("ipa", F.lit(""))
    elif axis == "spell":
        rows = names.withColumn("reading", name).withColumn("ipa", F.lit(""))
    else:
        p = W.primary(name, W.first_accept(lang or None))
        rows = names.withColumn("__p", p).withColumn("reading", F.col("__p.rom")).withColumn("ipa", F.col("__p.ipa")).drop("__p")
    key = W.key(name, F.col("reading"))
    if alphabet_name == "ipa":
        key = F.concat(W.ipa_digits(F.col("ipa")), F.array(F.lit(0)), key)
    rows = rows.withColumn("key", key)
    own = Window.partitionBy(column)
    rows = rows.withColumn("of", F.count("*").over(own)).withColumn("__n", F.row_number().over(own.orderBy("key"))).where(F.col("__n") <= MOST_PUSH)
    return rows.select(column, "reading", "key", "of", (F.col("of") > MOST_PUSH).alias("truncated"))


def cards(spark: SparkSession, q: str) -> DataFrame:
    """card, item, text, neg, is_number, codes, number: lines are cards, commas part items, a leading sign negates.

    number reads a string in base 307 by ranks; sums as coded are sums of it over a card, signs and numerals ignored.
    """
    _bounded(q)
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(q.split("\n"))], "card int, line string").where(F.trim("line") != "")
    rows = lines.select("card", F.posexplode(F.split("line", ",")).alias("item", "raw")).where(F.col("item") < MOST_ITEMS).withColumn("raw", F.trim("raw")).where("raw <> ''")
    body = F.regexp_replace("raw", "^[+-]", "")
    number = F.col("raw").rlike("^[+-]?[0-9]+$")
    ranks = F.create_map(*(F.lit(x) for r in alphabet.table() for x in (r["char"], r["rank"])))
    digits = F.transform(F.split("text", ""), lambda c: F.coalesce(F.element_at(ranks, c), F.lit(0)))
    rows = rows.select("card", "item", body.alias("text"), F.startswith("raw", F.lit("-")).alias("neg"), number.alias("is_number"))
    none = F.array().cast("array<int>")
    return rows.select("*", F.when(F.col("is_number") | (F.col("text") == ""), none).otherwise(W.letters(F.col("text"))).alias("codes"), F.when(~F.col("is_number") & (F.col("text") != ""), W.number(digits, 307)).alias("number"))


def card_sums(items: DataFrame) -> DataFrame:
    """card, sum_as_coded, signed_sum of cards()."""
    coded = F.coalesce("number", F.lit(0))
    return items.groupBy("card").agg(F.sum(coded).alias("sum_as_coded"), F.sum(F.when(F.col("neg"), -coded).otherwise(coded)).alias("signed_sum"))


def ipa_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """text, segment, sym, marks, rank of transcriptions: one row a segment, with the marks that belong to it."""
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.posexplode(W.ipa_segments(F.col("text"))).alias("segment", "s"))
    found = rows.select("text", "segment", "s.sym", "s.marks")
    return found.join(F.broadcast(tables.ipa_table(spark).select("sym", "rank")), "sym").select("text", "segment", "sym", "marks", "rank")


def ipa_items(spark: SparkSession, q: str, lang: str = "") -> DataFrame:
    """text, reading, ipa, digits, number, bits, base_digits, base_bits of each line of a request: its reading in both alphabets."""
    _bounded(q, lang)
    lines = [t for t in (x.strip() for x in q.split("\n")) if t][:MOST_ITEMS]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line int, text string").withColumn("p", W.primary(F.col("text"), W.first_accept(lang or None)))
    rows = rows.select("line", "text", F.col("p.rom").alias("reading"), F.col("p.ipa").alias("ipa")).withColumn("digits", W.ipa_digits(F.col("ipa")))
    base_digits = F.size(W.letters(F.col("reading")))
    return rows.select("line", "text", "reading", "ipa", "digits", W.number(F.col("digits"), ipa.BASE).alias("number"), (F.size("digits") * 8).alias("bits"), base_digits.alias("base_digits"), (base_digits * 16).alias("base_bits"))


def ipa_digits(df: DataFrame, column: str) -> DataFrame:
    """df with the digits of a transcription and their number in base 256 (null over 38 decimal digits)."""
    return df.withColumn("digits", W.ipa_digits(F.col(column))).withColumn("number", W.number(F.col("digits"), ipa.BASE))


def base(spark: SparkSession) -> DataFrame:
    """The alphabet with the block that each character's code lies in."""
    blocks = {k: list(v) for k, v in alphabet.BLOCKS.items()}
    first = F.when(F.col("type") == "digit", blocks["digit"][0]).otherwise(blocks["letter"][0])
    last = F.when(F.col("type") == "digit", blocks["digit"][1]).otherwise(blocks["letter"][1])
    return tables.base_table(spark).withColumn("block_first", first).withColumn("block_last", last)
