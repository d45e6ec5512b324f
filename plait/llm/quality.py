"""Quality rules with thresholds from mergeable quantile sketches per language and source. DataFrame functions only.

The sketch of a measure is a histogram of its values cut to BITS leading bits (relative error under 1/64), so sketches
merge by adding counts, come out alike in any order, and hold at most some hundred rows a group. Quantiles are read
from cumulative counts and drawn towards those of the language by PRIOR / (documents + PRIOR).

A document goes if a measure lies further outside the quartiles of its language and source than REACH times their
distance, for a document of the group's median size; the reach of a smaller one grows with the root of median / size,
as that of any mean does. A group without spread still has the distance that one event makes in its median document,
and a sixteenth of the value. Nothing else is added, so every fence follows its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm import common

PRIOR, WINDOW, REACH, BITS = 30, 5, 6, 7
#: Measure: events counted, what they are counted in, and how many of these the rate is for.
MEASURES = {"symbols": ("n_symbols", "word_chars", 1000), "length": ("word_chars", "n_words", 100), "lines": ("n_dup_lines", "n_words", 1000)}
SIZES = ("n_words", "word_chars")
LOW = {"length"}  # also has a lower fence


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas evaluate what they close over again for each element."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words within windows of WINDOW words that stand twice or more in the text, the first included."""

    def covered(windows: Column) -> Column:
        def of(pairs: Column) -> Column:
            twice = F.filter(pairs, lambda e, i: (F.get(pairs, i - 1)["h"] == e["h"]) | (F.get(pairs, i + 1)["h"] == e["h"]))
            at = F.sort_array(F.transform(twice, lambda e: e["p"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

        pairs = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_bound(pairs, of))

    def windows(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda e, i: F.xxhash64(e, *(F.get(h, i + j) for j in range(1, WINDOW))))

    return _bound(_bound(F.transform(words, lambda w: F.xxhash64(w)), windows), covered).cast("long")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, lang, source and the base counts of docs(doc_id, text, lang, source, ...), with the columns `keep`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD))
    n_lines = _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    words = _bound(F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again")))
    out = docs.select(
        *(F.col(c) for c in dict.fromkeys(["doc_id", "lang", "source", *keep])), words.alias("__w"),
        (F.length(text) - F.regexp_count(text, F.lit(common.BLANK))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), n_lines.cast("long").alias("n_dup_lines"),
    )
    out = out.withColumn("n_words", F.col("__w.n")).withColumn("n_repeat_words", F.col("__w.again")).drop("__w")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _rate(measure: str) -> Column:
    events, size, per = MEASURES[measure]
    return F.floor(per * F.col(events) / F.greatest(F.col(size), F.lit(1))).cast("long")


def fences(table: DataFrame) -> DataFrame:
    """lang, source, and for each measure its quartiles _q1 and _q3, _reach and median _size, from rows that passed the base rules."""
    def cell(v: Column) -> Column:
        cut = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
        return F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut)

    values = {**{k: _rate(k) for k in MEASURES}, **{k: F.col(k) for k in SIZES}}
    parts = F.array(*(F.struct(F.lit(k).alias("measure"), cell(v).alias("value")) for k, v in values.items()))
    sketch = table.where(~F.col("base_failed")).select("lang", "source", F.explode(parts).alias("m")).select("lang", "source", "m.*")
    sketch = sketch.groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))

    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys, "measure")
        upto = s.select(*keys, "measure", "value", F.sum("n").over(by.orderBy("value")).alias("upto"), F.sum("n").over(by).alias("of"))
        at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("of"), F.col("value")))
        return upto.groupBy(*keys, "measure").agg(*(at(q).alias(f"q{q}") for q in (1, 2, 3)), F.max("of").alias("of"))

    own = quartiles(sketch, ["lang", "source"])
    merged = quartiles(sketch.groupBy("lang", "measure", "value").agg(F.sum("n").alias("n")), ["lang"])
    merged = merged.select(F.col("lang").alias("l"), F.col("measure").alias("k"), *(F.col(f"q{q}").alias(f"m{q}") for q in (1, 2, 3)))
    both = own.join(merged, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("k")))
    drawn = [F.expr(f"(of * q{q} + {PRIOR} * m{q}) div (of + {PRIOR})").alias(f"q{q}") for q in (1, 2, 3)]
    at = lambda k, q: F.max(F.when(F.col("measure") == k, F.col(f"q{q}")))
    wide = both.select("lang", "source", "measure", *drawn).groupBy("lang", "source")
    wide = wide.agg(*(at(k, q).alias(f"{k}_q{q}") for k in MEASURES for q in (1, 3)), *(at(k, 2).alias(f"{k}_m") for k in SIZES))
    columns = []
    for k, (_, size, per) in MEASURES.items():
        spread = F.greatest(F.col(f"{k}_q3") - F.col(f"{k}_q1"), F.expr(f"{k}_q3 div 16"), F.expr(f"{per} div greatest({size}_m, 1)"), F.lit(1))
        columns += [F.col(f"{k}_q1"), F.col(f"{k}_q3"), (REACH * spread).alias(f"{k}_reach"), F.col(f"{size}_m").alias(f"{k}_size")]
    return wide.select("lang", "source", *columns)


def _kept(table: DataFrame, limits: DataFrame) -> DataFrame:
    """table with the verdict as kept."""
    joined = common.small_join(table, limits, ["lang", "source"], F.xxhash64("doc_id"), "left")
    inside = F.lit(True)
    for k, (_, size, _) in MEASURES.items():
        v = _rate(k)
        beyond = F.greatest(v - F.col(f"{k}_q3"), *([F.col(f"{k}_q1") - v] if k in LOW else []), F.lit(0)).cast("double")
        reach = F.col(f"{k}_reach").cast("double")
        inside = inside & (beyond * beyond * F.col(size) <= reach * reach * F.greatest(F.col(size), F.col(f"{k}_size")))
    return joined.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of docs(doc_id, text, lang, source, ...), base_failed and kept.

    Null texts count as empty and fail the base rules. Null languages and sources are groups of their own. Every row
    gets a row, equal ones alike; a group all of whose rows failed has no fences. Other columns are ignored. An empty
    table gives no rows.
    """
    table = common.written(measured(docs, []), "quality")
    limits = common.written(fences(table), "quality-fences")
    return _kept(table, limits).select("doc_id", *COUNTS, "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names.

    Texts are measured once: the counts are written beside their rows, and read alone for the fences.
    """
    whole = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("__row"))
    table = common.written(measured(whole, ["__row"]), "quality", "lz4")
    limits = common.written(fences(table), "quality-fences")
    out = _kept(table, limits).where("kept").select("__row.*")
    out._plait_read = [table, limits]  # a caller that has written the result may drop these
    return out
