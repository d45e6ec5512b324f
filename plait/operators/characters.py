"""Characters with their readings: layers of sources, the certified order, and the index with every reading of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.functions import alphabet, phonetics
from plait.functions import words as W
from plait.operators import ordering

#: Vowels and nasals with tone marks, by tone from 1 to 4, and what they are without.
TONES = ("āēīōūǖ", "áéíóúǘḿń", "ǎěǐǒǔǚň", "àèìòùǜǹ")
BARE = ("aeiouu", "aeiouumn", "aeiouun", "aeiouun")
#: Bits of a letter in an index entry, and the base in which positions in the index are digits.
ENTRY_WIDTH, INDEX_BASE = 12, (1 << 19) - 1
#: Columns of readings in the order in which they are preferred, with their languages.
LAYERS = {"mandarin": "cmn", "cantonese": "yue", "on": "ja-on", "kun": "ja-kun", "korean": "ko"}


def pinyin(text: Column) -> Column:
    """struct(reading, tone) of a syllable with a tone mark; no mark is tone 5."""
    low = F.lower(text)
    tone = F.lit(5)
    for i, marked in enumerate(TONES, 1):
        tone = F.when(low.rlike(f"[{marked}]"), i).otherwise(tone)
    return F.struct(F.translate(low, "".join(TONES) + "ü", "".join(BARE) + "u").alias("reading"), tone.alias("tone"))


def _token(layer: str, token: Column) -> Column:
    """struct(reading, tone) of one listed reading of a layer."""
    if layer == "mandarin":
        return pinyin(token)
    return F.struct(F.regexp_replace(F.lower(token), "[^a-z]", "").alias("reading"), F.lit(0).alias("tone"))


def readings(chars: DataFrame, han: DataFrame | None = None) -> DataFrame:
    """char, reading, tone, strokes, layer, source of chars(char); han: the table of sources.tables.read_unihan.

    A character of the alphabet reads as itself, a Han character by the first layer that has a reading, others by name.
    """
    known = F.create_map(*(F.lit(x) for kv in alphabet.codes().items() for x in kv))
    c = F.col("char")
    own = F.element_at(known, c).isNotNull()
    kind = F.when(own, "table").when(F.ascii(c).between(0xAC00, 0xD7A3), "hangul").otherwise("named")
    plain = F.struct(F.when(own, c).otherwise(W.named(c)).alias("reading"), F.lit(0).alias("tone"), F.lit(0).alias("strokes"), kind.alias("layer"), F.lit(0).alias("source"))
    if han is None:
        return chars.select("char", plain.alias("r")).select("char", "r.*")
    rows = chars.withColumn("__cp", F.ascii("char")).join(han, F.col("__cp") == F.col("cp"), "left")
    strokes = F.split("strokes", " ")[0].cast("int")
    best = []
    for i, layer in enumerate(LAYERS):
        first = _token(layer, F.split(layer, " ")[0])
        best.append(_whole(first, strokes, i))
    unread = F.struct(W.named(c).alias("reading"), F.lit(0).alias("tone"), strokes.alias("strokes"), F.lit("han-unread").alias("layer"), F.lit(5).alias("source"))
    return rows.select("char", F.when(F.col("strokes").isNull() | own, plain).otherwise(F.coalesce(*best, unread)).alias("r")).select("char", "r.*")


def _whole(token: Column, strokes: Column, source: int) -> Column:
    return F.when(F.coalesce(token["reading"], F.lit("")) != "", F.struct(token["reading"].alias("reading"), token["tone"].alias("tone"), strokes.alias("strokes"), F.lit("han").alias("layer"), F.lit(source).alias("source")))


def certified(read: DataFrame) -> DataFrame:
    """readings() with key and position: letters, end, source, tone, strokes, code point; a total order without ties."""
    unread = F.col("reading") == W.BREAK
    tail = F.array(F.lit(alphabet.TERM), "source", "tone", "strokes", F.ascii("char"))
    rows = read.withColumn("key", F.concat(F.when(unread, F.array(F.lit(alphabet.UNREAD))).otherwise(W.letters(F.col("reading"))), tail))
    return ordering.positions(rows, [F.col("key")])


def key_bits(key: Column, width: int = 24) -> Column:
    """A key as bits, every part `width` wide, so that bits order as keys do whatever their codes."""
    return F.array_join(F.transform(key, lambda x: F.lpad(F.bin(x.cast("bigint")), width, "0")), "")


def han_entries(han: DataFrame) -> DataFrame:
    """cp, reading, langs, ipa, tone, strokes: one row for each distinct reading of each Han character and language."""
    rows = None
    for layer, tag in LAYERS.items():
        listed = han.where(F.col(layer).isNotNull()).select("cp", F.split("strokes", " ")[0].cast("int").alias("strokes"), F.explode(F.array_distinct(F.split(layer, " "))).alias("ipa"))
        part = listed.withColumn("t", _token(layer, F.col("ipa"))).where(F.col("t.reading") != "").select("cp", F.col("t.reading").alias("reading"), F.array(F.lit(tag)).alias("langs"), "ipa", F.col("t.tone").alias("tone"), "strokes")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def multi_listed(entries: DataFrame, key: str = "cp") -> DataFrame:
    """How many characters have how many entries, and the tags they come under."""
    each = entries.groupBy(key).agg(F.count("*").alias("entries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("langs")))).alias("tags"))
    return each.groupBy("entries").agg(F.count("*").alias("characters"))


def entry_bits(letters: Column, lang: Column, tone: Column, strokes: Column, spell: Column) -> Column:
    """An index entry as bits: its letters in ENTRY_WIDTH each, or more if they need them, an end of zeros, then the ties."""
    wide = lambda x, n: F.lpad(F.bin(x.cast("bigint")), n, "0")
    each = F.transform(letters, lambda x: F.when(x >= 1 << ENTRY_WIDTH, F.bin(x.cast("bigint"))).otherwise(wide(x, ENTRY_WIDTH)))
    return F.concat(F.array_join(each, ""), F.lit("0" * ENTRY_WIDTH), wide(lang, 7), wide(tone, 8), wide(strokes, 8), wide(spell, 22))


def first_positions(ordered: DataFrame, position: str = "position") -> DataFrame:
    """char, digit: one above the first place of each character in an ordered index, as 0 is none; a digit in base 2^19 - 1."""
    return ordered.groupBy("char").agg((F.min(position) + 1).alias("digit"))


def flat_codes(ordered: DataFrame, position: str = "position") -> DataFrame:
    """Rows with their positions, and code: all of one width in bits, as they start at the power of two that holds all rows."""
    ring = max(1, (ordered.count() - 1).bit_length())
    return ordered.withColumn("code", F.col(position) + (1 << ring))


def filtered(entries: DataFrame, want: str) -> DataFrame:
    """Entries that answer a request: a part of the index in its order, never another order."""
    asked = want.split()

    def answers(t: Column) -> Column:
        out = t == phonetics.ANY
        for w in asked:
            out = out | (t == w) | F.startswith(t, F.lit(f"{w}-")) | F.startswith(F.lit(w), F.concat(t, F.lit("-")))
        return out

    return entries.where(F.exists("langs", answers))
