"""Readers and writers of the alphabets' files, and generated inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.functions import alphabet, ipa, phonetics

BASE_SCHEMA = "char string, base int, `case` int, accent string, rank int, code int, type string"


def base_table(spark: SparkSession) -> DataFrame:
    """The 306 characters, from their rule."""
    return spark.createDataFrame([tuple(r.values()) for r in alphabet.table()], BASE_SCHEMA)


def write_rows(df: DataFrame, path: str, *order: str) -> None:
    """Tab-separated rows under a comment line, in order, as one file a partition of the order; nulls are empty.

    Serves the alphabet, the certified order of characters and the index: line feeds and tabs in a value become blanks.
    """
    head = df.sparkSession.createDataFrame([("# " + "\t".join(df.columns),)], "value string")
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\n\r\\x00]", " ")
    rows = df.orderBy(*order).select(F.concat_ws("\t", *(cell(c) for c in df.columns)).alias("value"))
    head.coalesce(1).unionByName(rows).write.mode("overwrite").text(path)


def write_base(df: DataFrame, path: str) -> None:
    """The alphabet by rank."""
    write_rows(df, path, "rank")


def read_base(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)


def read_collation_keys(spark: SparkSession, path: str) -> DataFrame:
    """cp, primary, secondary, tertiary of single characters in an allkeys.txt file."""
    line = F.trim(F.regexp_replace("value", "[#%].*$", ""))
    rows = spark.read.text(path).select(line.alias("v")).where((F.col("v") != "") & ~F.startswith("v", F.lit("@")))
    part = lambda i: F.conv(F.regexp_extract("v", r"\[[.*]([0-9A-F]{4})\.([0-9A-F]{4})\.([0-9A-F]{4})\]", i), 16, 10).cast("int")
    single = rows.where(F.col("v").rlike(r"^[0-9A-F]+\s*;")).withColumn("cp", F.conv(F.regexp_extract("v", "^([0-9A-F]+)", 1), 16, 10).cast("int"))
    return single.select("cp", part(1).alias("primary"), part(2).alias("secondary"), part(3).alias("tertiary")).where("primary is not null")


UNIHAN_FIELDS = {"kMandarin": "mandarin", "kCantonese": "cantonese", "kJapaneseOn": "on", "kJapaneseKun": "kun", "kKorean": "korean", "kTotalStrokes": "strokes"}


def read_unihan(spark: SparkSession, *paths: str) -> DataFrame:
    """cp and a column for each of six fields, from tab-separated files of (U+hex, field, value)."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("u string, field string, value string").csv(list(paths))
    rows = rows.where(F.col("field").isin(list(UNIHAN_FIELDS))).withColumn("cp", F.conv(F.substring("u", 3, 10), 16, 10).cast("int"))
    wide = rows.groupBy("cp").pivot("field", list(UNIHAN_FIELDS)).agg(F.first("value"))
    return wide.withColumnsRenamed(UNIHAN_FIELDS)


def read_unihan_json(spark: SparkSession, path: str) -> DataFrame:
    """cp and a column for each of six fields, from a file that is one object: field, then code point in decimals, to value."""
    fields = list(UNIHAN_FIELDS.values())
    schema = "struct<" + ", ".join(f"`{f}`: map<string, string>" for f in fields) + ">"
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("o"))

    def rows_of(field: str):
        held = F.coalesce(F.col(f"o.{field}"), F.create_map().cast("map<string, string>"))
        return F.transform(F.map_entries(held), lambda e: F.struct(e["key"].cast("int").alias("cp"), F.lit(field).alias("field"), e["value"].alias("value")))

    parts = F.flatten(F.array(*map(rows_of, fields)))
    return whole.select(F.explode(parts).alias("e")).select("e.*").groupBy("cp").pivot("field", fields).agg(F.first("value"))


def diacritics(spark: SparkSession) -> DataFrame:
    """mark, name of the marks that belong to the symbol before them."""
    return spark.createDataFrame(ipa.DIACRITICS, "mark string, name string")


def code_points(spark: SparkSession) -> DataFrame:
    """cp, char of every assigned code point but surrogates, as this JVM's Unicode has them."""
    cp = F.col("id").cast("int")
    kind = F.call_function("java_method", F.lit("java.lang.Character"), F.lit("getType"), cp)
    rows = spark.range(0x110000).where("id < 55296 or id > 57343").select(cp.alias("cp"), F.lit(None).cast("string").alias("none"), kind.cast("int").alias("type"))
    utf16 = F.when(F.col("cp") < 0x10000, F.lpad(F.hex(F.col("cp").cast("bigint")), 4, "0")).otherwise(F.concat(F.lpad(F.hex((F.lit(0xD800) + (F.col("cp") - 0x10000) / 1024).cast("bigint")), 4, "0"), F.lpad(F.hex((F.lit(0xDC00) + (F.col("cp") - 0x10000) % 1024).cast("bigint")), 4, "0")))
    return rows.where("type <> 0").select("cp", F.decode(F.unhex(utf16), "UTF-16BE").alias("char"), "type")


def lexicon(spark: SparkSession, path: str, tag: str, limit: int | None = None) -> DataFrame:
    """tag, word of a file with a word a line: blank lines and lines with a space are skipped; the first `limit` words."""
    place = [F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")]
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"), *place).where("word <> '' and instr(word, ' ') = 0")
    words = words.orderBy("p", "b", "i").limit(limit) if limit else words
    return words.select("word").distinct().select(F.lit(tag).alias("tag"), "word")


def sample_words(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n words of df(tag, word) for each tag, the same ones at every run."""
    from pyspark.sql import Window

    order = Window.partitionBy("tag").orderBy(F.xxhash64("word", F.lit(seed)), "word")
    return df.dropDuplicates(["word"]).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def ipa_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r["sym"], r["rom"], r["kind"], r["name"], r["rank"]) for r in ipa.table()], "sym string, rom string, kind string, name string, rank int")


def rules(spark: SparkSession) -> DataFrame:
    """grapheme, ord, ipa, rom, langs of every declared branch."""
    return spark.createDataFrame([(r["grapheme"], r["ord"], r["ipa"], r["rom"], r["langs"]) for r in phonetics.rules()], "grapheme string, ord int, ipa string, rom string, langs array<string>")
