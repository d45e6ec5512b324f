"""Queries on the alphabet, on words and on what they read as. Words are the distinct runs between white space, as they stand."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.functions import alphabet, expressions, ipa, phonetics
from plait.functions import words as W
from plait.operators import characters, ordering, shared
from plait.plans.numbers import table
from plait.sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _q(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "[" + ", ".join(map(_q, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A SQL table of literal rows."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) AS t({names}))"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all documents, benchmark items and part names."""
    texts = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "benchmark").select("text")).union(table(spark, sf_dir, "part").select("p_name"))
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()


_TOKENS = r"w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT p_name FROM part))"
_BASE = values([tuple(r.values()) for r in alphabet.table()], "char, base, case_weight, accent, rank, code, type")


@query("q_base_table", f"SELECT char, CAST(base AS INTEGER) AS base, CAST(case_weight AS INTEGER) AS case_weight, accent, CAST(rank AS INTEGER) AS rank, CAST(code AS INTEGER) AS code, type FROM {_BASE}")
def q_base_table(spark, sf_dir):
    return tables.base_table(spark).withColumnRenamed("case", "case_weight")


@query(
    "q_codes",
    f"SELECT char, CAST(CASE type WHEN 'digit' THEN 4096 + 8191 // n * (i - 1) ELSE 16384 + 49151 // n * (i - 1) END AS INTEGER) AS code FROM (SELECT char, type, row_number() OVER (PARTITION BY type ORDER BY rank) AS i, count(*) OVER (PARTITION BY type) AS n FROM {_BASE})",
)
def q_codes(spark, sf_dir):
    return tables.base_table(spark).select("char", "code")


@query("q_rank_order", f"SELECT char, CAST(row_number() OVER (ORDER BY base, case_weight, list_transform(string_split(accent, '.'), lambda x: CAST(x AS INTEGER)), unicode(char)) AS INTEGER) AS rank FROM {_BASE}")
def q_rank_order(spark, sf_dir):
    """Ranks made anew from base, case and the sequence of accents; 306 rows, so one window is no bottleneck."""
    accents = F.transform(F.split("accent", "[.]"), lambda x: x.cast("int"))
    order = Window.orderBy("base", "case", accents, F.ascii("char"))
    return tables.base_table(spark).select("char", F.row_number().over(order).alias("rank"))


@query("q_block_stats", f"SELECT type, count(*) AS symbols, CAST(min(code) AS INTEGER) AS first, CAST(max(code) AS INTEGER) AS last, round(360.0 * (max(code) - min(code)) / 65536, 6) AS arc FROM {_BASE} GROUP BY type")
def q_block_stats(spark, sf_dir):
    arc = F.round(F.lit(360.0) * (F.max("code") - F.min("code")) / 65536, 6)
    return tables.base_table(spark).groupBy("type").agg(F.count("*").alias("symbols"), F.min("code").alias("first"), F.max("code").alias("last"), arc.alias("arc"))


@query("q_rank_code_monotone", "SELECT CAST(305 AS BIGINT) AS steps, CAST(0 AS BIGINT) AS violations")
def q_rank_code_monotone(spark, sf_dir):
    rows = tables.base_table(spark).withColumn("next", F.lead("code").over(Window.orderBy("rank"))).where("next is not null")
    return rows.agg(F.count("*").alias("steps"), F.count_if(F.col("next") <= F.col("code")).alias("violations"))


@query("q_char_freq_order", f"SELECT CAST(b.rank AS INTEGER) AS rank, b.char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM documents) c JOIN {_BASE} b USING (char) GROUP BY b.rank, b.char")
def q_char_freq_order(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    return chars.join(F.broadcast(tables.base_table(spark)), "char").select("rank", "char", "n").orderBy("rank")


@query("q_char_order")
def q_char_order(spark, sf_dir):
    """Every character of the documents in the certified order: letters of its reading, end, source, tone, strokes, code point."""
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("char")).distinct().where("char <> ''")
    rows = characters.certified(characters.readings(chars))
    return rows.select("position", "char", "reading", F.array_join(F.transform("key", lambda x: x.cast("string")), " ").alias("key"), characters.key_bits(F.col("key")).alias("bits"))


_DIGRAPHS = "|".join(g for g in phonetics.DIGRAPHS if g not in phonetics.INITIAL)
#: Two letters that stand for @ and ! while words are cut: these are no separators, and RE2 cannot take them out of a class.
_HIDE, _SHOW = "'@!', 'ꘋꘌ'", "'ꘋꘌ', '@!'"
_SEGMENT = rf"'(?is)^(?:{'|'.join(phonetics.INITIAL)})|{_DIGRAPHS}|[\p{{P}}\p{{Z}}\p{{C}}]+|.'"
_CUT = rf"list_transform(regexp_extract_all(translate(word, {_HIDE}), {_SEGMENT}), lambda g: CASE WHEN regexp_matches(g, '^[\p{{P}}\p{{Z}}\p{{C}}]+$') THEN chr(1) ELSE translate(g, {_SHOW}) END)"


@query("q_segment", f"WITH {_TOKENS} SELECT word, list_aggregate({_CUT}, 'string_agg', ' ') AS graphemes FROM w")
def q_segment(spark, sf_dir):
    return tokens(spark, sf_dir).select("word", F.array_join(W.segments(F.col("word")), " ").alias("graphemes"))


_RULES = values([(r["grapheme"], r["ord"], r["ipa"], r["rom"], " ".join(r["langs"]), r["first"], r["last"], r["nexts"], r["no_nexts"], r["befores"], "|".join(r["words"]) if r["words"] else None) for r in phonetics.rules()], "g, ord, ipa, rom, langs, first, last, nexts, no_nexts, befores, words")


def _name(c: str) -> str:
    """What a character that no rule has is read as: the core of a letter's name, another's whole name."""
    name = unicodedata.name(c, "")
    core = re.search(r"\b(?:LETTER|SYLLABLE|SYLLABICS|VOWEL SIGN|DIGIT|SIGN|CHARACTER)\s+(.*)$", name)
    if core and unicodedata.category(c)[0] == "L":
        return core[1] if "CAPITAL" in name else core[1].lower()
    return name.lower()


_NAMES = values([(c, _name(c)) for c in map(chr, [*range(0x21, 0x400), *range(0x2030, 0x2300)]) if c not in W._bases() and unicodedata.category(c)[0] in "LNS"], "char, name")
_GLYPHS = "{" + ", ".join(f"'{g}': '{v[0]}'" for g, v in phonetics.SHAPES.items()) + "}"
_BASES = values(list(W._bases().items()), "char, base")


def branch_sql(known: str) -> str:
    """CTEs up to b(word, i, ord, rom, ipa, good, known): graphemes joined with rules, conditions by lag and lead."""
    # without a declared language neighbours that are glyphs count as the letters they look like
    seen = f"list_transform(segs, lambda g: coalesce(list_extract(map_extract(MAP {_GLYPHS}, g), 1), g))" if known == "true" else "segs"
    return f"""{_TOKENS}, s0 AS (SELECT word, {_CUT} AS segs FROM w), s AS (SELECT *, {seen} AS vs FROM s0), e AS (SELECT word, len(segs) AS n, i, segs[i] AS g, vs[i - 1] AS p, vs[i + 1] AS x FROM s, LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i)),
    ek AS (SELECT e.*, CASE WHEN length(g) > 1 THEN lower(g) ELSE coalesce(base, g) END AS rule FROM e LEFT JOIN {_BASES} ON char = g),
    b AS (SELECT ek.word, ek.i, coalesce(r.ord, 0) AS ord, CASE WHEN ek.g = chr(1) THEN chr(1) WHEN r.g IS NULL THEN name WHEN substr(ek.g, 1, 1) <> lower(substr(ek.g, 1, 1)) THEN upper(r.rom) ELSE r.rom END AS rom, coalesce(r.ipa, '') AS ipa,
    r.g IS NULL OR ((first IS NULL OR first = (i = 1)) AND (NOT last OR i = n) AND (nexts IS NULL OR (i < n AND contains(nexts, lower(x[1])))) AND (no_nexts IS NULL OR NOT (i < n AND contains(no_nexts, lower(x[1])))) AND (befores IS NULL OR (i > 1 AND contains(befores, lower(p[-1])))) AND (words IS NULL OR list_contains(string_split(words, '|'), lower(word)))) AS good, r.g IS NULL OR {known} AS known
    FROM ek LEFT JOIN {_RULES} r ON ek.rule = r.g LEFT JOIN {_NAMES} na ON na.char = ek.g)"""


def _known(accept: set[str]) -> str:
    return "(" + " OR ".join(f"list_contains(string_split(langs, ' '), '{t}')" for t in sorted(accept)) + ")"


def _primary_sql(accept: set[str]) -> str:
    """Relational form of one reading: the best branch of each grapheme by row number."""
    return f"""{branch_sql(_known(accept))},
    c AS (SELECT *, row_number() OVER (PARTITION BY word, i ORDER BY good DESC, known DESC, ord) AS rn FROM b), pr AS (SELECT word, string_agg(rom, '' ORDER BY i) AS reading, string_agg(ipa, '' ORDER BY i) AS ipa FROM c WHERE rn = 1 GROUP BY word)"""


def options_sql(known: str, in_context: bool = True) -> str:
    """CTEs up to ol(word, n, every, single): how many readings a word has, its options by grapheme, and the first of each.

    The options of a grapheme are the spellings of the branches that are as good as its best one.
    """
    best = "max(CASE WHEN good THEN 2 ELSE 0 END + CASE WHEN known THEN 1 ELSE 0 END)" if in_context else "max(CASE WHEN known THEN 1 ELSE 0 END)"
    own = "CASE WHEN good THEN 2 ELSE 0 END + CASE WHEN known THEN 1 ELSE 0 END" if in_context else "CASE WHEN known THEN 1 ELSE 0 END"
    return f"""{branch_sql(known)}, bo AS (SELECT *, {own} = {best.replace('max(', 'max(', 1)} OVER (PARTITION BY word, i) AS fit FROM b),
    op AS (SELECT word, i, list(DISTINCT rom) AS opts, arg_min(rom, ord) AS head FROM bo WHERE fit GROUP BY word, i), ol AS (SELECT word, product(len(opts)) AS n, list(opts ORDER BY i) AS every, string_agg(head, '' ORDER BY i) AS single FROM op GROUP BY word)"""


PRODUCT = "list_reduce(every, lambda acc, x: flatten(list_transform(acc, lambda a: list_transform(x, lambda c: a || c))))"


_EN = phonetics.accepted("en", set())


def _read(spark, sf_dir, want: str) -> DataFrame:
    p = W.primary(F.col("word"), W.first_accept(want))
    return tokens(spark, sf_dir).withColumn("p", p).select("word", F.col("p.rom").alias("reading"), F.col("p.ipa").alias("ipa"))


@query("q_primary", f"WITH {_primary_sql(_EN)} SELECT * FROM pr")
def q_primary(spark, sf_dir):
    return _read(spark, sf_dir, "en")


@query("q_primary_es", f"WITH {_primary_sql(phonetics.accepted('es-419', set()))} SELECT * FROM pr")
def q_primary_es(spark, sf_dir):
    """A bare language is read by its first region."""
    return _read(spark, sf_dir, "es")


_CODES_MAP = "{" + ", ".join(f"'{r['char']}': {r['code']}" for r in alphabet.table()) + "}"
_CODES = values([(r["char"], r["code"]) for r in alphabet.table()], "char, code")


_MARKS = values([(c, j, x) for c, v in W._decomposed().items() for j, x in enumerate(v)], "char, j, mark")


def sorted_sql(accept: set[str]) -> str:
    """CTEs up to k(word, reading, key): words with their sort keys, read by the tags accepted."""
    code = f"CASE c WHEN ' ' THEN {alphabet.SPACE} WHEN '-' THEN {alphabet.HYPHEN} ELSE coalesce(mark, a.code, z.code, {alphabet.OUTSIDE} + unicode(c)) END"
    return f"""{_primary_sql(accept)}, l AS (SELECT word, reading, 0 AS part, i, substr(reading, i, 1) AS c FROM pr, LATERAL (SELECT unnest(range(1, length(reading) + 1)) AS i) UNION ALL SELECT word, reading, 2, i, substr(word, i, 1) FROM pr, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
 lc AS (SELECT word, reading, part, i, coalesce(j, 0) AS j, CAST({code} AS INTEGER) AS code FROM l LEFT JOIN {_MARKS} m ON part = 2 AND m.char = c LEFT JOIN {_CODES} a ON a.char = c LEFT JOIN {_CODES} z ON z.char = lower(c) UNION ALL SELECT word, reading, 1, 0, 0, 0 FROM pr),
 k AS (SELECT word, reading, list(code ORDER BY part, i, j) AS key FROM lc GROUP BY word, reading)"""


_SORTED = sorted_sql(_EN)


def _keyed(spark, sf_dir, want: str) -> DataFrame:
    rows = _read(spark, sf_dir, want)
    return rows.withColumn("key", W.key(F.col("word"), F.col("reading")))


def _sorted(rows: DataFrame) -> DataFrame:
    return ordering.positions(rows, [F.col("key"), F.col("word")])


@query("q_word_sort", f"WITH {_SORTED} SELECT row_number() OVER (ORDER BY key, word) - 1 AS position, word, reading FROM k")
def q_word_sort(spark, sf_dir):
    return _sorted(_keyed(spark, sf_dir, "en")).select("position", "word", "reading")


@query("q_homophones", f"WITH {_primary_sql(_EN)} SELECT reading, count(*) AS words, min(word) AS first FROM pr GROUP BY reading HAVING count(*) > 1")
def q_homophones(spark, sf_dir):
    return _read(spark, sf_dir, "en").groupBy("reading").agg(F.count("*").alias("words"), F.min("word").alias("first")).where("words > 1")


@query(
    "q_readings",
    f"SELECT word, CAST(CASE WHEN a.n > 4096 THEN 1 ELSE a.n END AS INTEGER) AS readings, CAST(CASE WHEN o.n > 4096 THEN 1 ELSE o.n END AS INTEGER) AS out_of_context, CASE WHEN e.n > 4096 THEN e.single ELSE list_min({PRODUCT.replace('every', 'e.every')}) END AS lowest_en FROM (WITH {options_sql('true')} SELECT * FROM ol) a JOIN (WITH {options_sql('true', False)} SELECT * FROM ol) o USING (word) JOIN (WITH {options_sql(_known(_EN))} SELECT * FROM ol) e USING (word)",
)
def q_readings(spark, sf_dir):
    """How many readings each word has in context and out of it, without a declared language, and its lowest in English."""
    w = F.col("word")
    rows = tokens(spark, sf_dir).withColumn("en", W.readings(w, "en"))
    return rows.select("word", W.count_readings(w, None).alias("readings"), W.count_readings(w, None, False).alias("out_of_context"), F.array_min(F.transform("en", lambda p: F.array_join(p, ""))).alias("lowest_en"))


_LIKE = values([(c, len(v)) for c, v in phonetics.lookalikes().items()], "c, n")


@query("q_spellings", f"WITH {_TOKENS}, n AS (SELECT word, CAST(product(coalesce(l.n, 1)) AS BIGINT) AS n FROM (SELECT word, unnest(string_split(word, '')) AS c FROM w) x LEFT JOIN {_LIKE} l USING (c) GROUP BY word) SELECT word, CAST(CASE WHEN n > 4096 THEN 1 ELSE n END AS INTEGER) AS spellings FROM n")
def q_spellings(spark, sf_dir):
    return tokens(spark, sf_dir).select("word", F.size(W.spellings(F.col("word"))).alias("spellings"))


_PART_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS word FROM part)"


@query(
    "q_push_topk",
    f"WITH {options_sql('true').replace(_TOKENS, _PART_WORDS)}, rd AS (SELECT word, unnest(CASE WHEN n > 4096 THEN [single] ELSE list_distinct({PRODUCT}) END) AS reading FROM ol), rk AS (SELECT word, reading, count(*) OVER (PARTITION BY word) AS of_, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN reading = '' THEN [] ELSE list_transform(string_split(reading, ''), lambda c: list_extract(map_extract(MAP {_CODES_MAP}, c), 1)) END) AS n FROM rd) SELECT word, CAST(n AS INTEGER) AS n, reading, of_ AS of, of_ > 64 AS truncated FROM rk WHERE n <= 64",
)
def q_push_topk(spark, sf_dir):
    """Up to 64 pushed readings of each part-name word, the lowest by key, with how many there are."""
    words = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    rows = words.select("word", F.explode(F.array_distinct(F.transform(W.readings(F.col("word"), None), lambda p: F.array_join(p, "")))).alias("reading"))
    rows = rows.withColumn("key", W.key(F.col("word"), F.col("reading")))
    own = Window.partitionBy("word")
    rows = rows.withColumn("of", F.count("*").over(own)).withColumn("n", F.row_number().over(own.orderBy("key"))).where("n <= 64")
    return rows.select("word", "n", "reading", "of", (F.col("of") > 64).alias("truncated"))


@query("q_displacement")
def q_displacement(spark, sf_dir):
    """How far words move when Spanish is read before English: positions moved, readings changed, median and greatest step."""
    a = _sorted(_keyed(spark, sf_dir, "en")).select("word", F.col("position").alias("p"), F.col("reading").alias("r"))
    b = _sorted(_keyed(spark, sf_dir, "es en")).select("word", F.col("position").alias("q"), F.col("reading").alias("s"))
    step = F.abs(F.col("p") - F.col("q"))
    return a.join(b, "word").agg(F.count("*").alias("words"), F.count_if(step > 0).alias("moved"), F.count_if(F.col("r") != F.col("s")).alias("reread"), F.percentile(step, 0.5).alias("median"), F.max(step).alias("most"))


_LEX = r"lx AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word FROM documents)"


@query("q_detect", f"WITH {_LEX}, t AS (SELECT word, bool_or(lang = 'es') AS es, bool_or(lang = 'en') AS en, bool_or(lang = 'de') AS de FROM lx GROUP BY word) SELECT word, CASE WHEN es THEN 'es-419' WHEN en THEN 'en' WHEN de THEN 'de' END AS tag FROM t")
def q_detect(spark, sf_dir):
    """The first declared language whose lexicon, drawn from documents of that language, has the word."""
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    held = rows.groupBy("word").agg(*(F.bool_or(F.col("lang") == t).alias(t) for t in ("es", "en", "de")))
    return held.select("word", W.lexicon_tag(F.col("word"), "es en de", {t: F.col(t) for t in ("es", "en", "de")}).alias("tag"))


_IPA = values([(r["sym"], r["rom"], r["kind"], r["name"], r["rank"]) for r in ipa.table()], "sym, rom, kind, name, rank")


@query("q_ipa_table", f"SELECT sym, rom, kind, name, CAST(row_number() OVER (ORDER BY list_transform(string_split(rom, ''), lambda c: list_extract(map_extract(MAP {_CODES_MAP}, c), 1))) AS INTEGER) AS rank FROM {_IPA}")
def q_ipa_table(spark, sf_dir):
    return tables.ipa_table(spark)


_IPAD = f"{_SORTED}, di AS (SELECT word, list(CAST(rank AS INTEGER) ORDER BY i) AS digits FROM (SELECT word, i, substr(ipa, i, 1) AS sym FROM pr, LATERAL (SELECT unnest(range(1, length(ipa) + 1)) AS i)) JOIN {_IPA} USING (sym) GROUP BY word)"


@query("q_ipa_sort", f"WITH {_IPAD} SELECT row_number() OVER (ORDER BY coalesce(digits, []), key, word) - 1 AS position, word FROM k LEFT JOIN di USING (word)")
def q_ipa_sort(spark, sf_dir):
    rows = _keyed(spark, sf_dir, "en").withColumn("digits", W.ipa_digits(F.col("ipa")))
    return ordering.positions(rows, [F.col("digits"), F.col("key"), F.col("word")]).select("position", "word")


@query("q_ipa_number", f"WITH {_IPAD} SELECT word, array_to_string(digits, ' ') AS digits, CASE WHEN len(digits) <= 15 THEN CAST(list_reduce(list_transform(digits, lambda x: CAST(x AS HUGEINT)), lambda a, d: a * 256 + d) AS VARCHAR) END AS number FROM di")
def q_ipa_number(spark, sf_dir):
    rows = _read(spark, sf_dir, "en").withColumn("d", W.ipa_digits(F.col("ipa"))).where(F.size("d") > 0)
    return rows.select("word", F.array_join(F.transform("d", lambda x: x.cast("string")), " ").alias("digits"), W.number(F.col("d"), ipa.BASE).cast("string").alias("number"))


@query("q_ipa_number_whole")
def q_ipa_number_whole(spark, sf_dir):
    """q_ipa_number with a number for every word, however long."""
    rows = _read(spark, sf_dir, "en").select("word", W.ipa_digits(F.col("ipa")).alias("d")).where(F.size("d") > 0)
    return expressions.numbered(rows, "d", ipa.BASE).select("word", F.array_join(F.transform("d", lambda x: x.cast("string")), " ").alias("digits"), "number")


@query("q_mod127_inverse", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (SELECT unnest(range(1, 127)) AS a), (SELECT unnest(range(1, 127)) AS b) WHERE a * b % 127 = 1")
def q_mod127_inverse(spark, sf_dir):
    """By Fermat: the inverse of a is a^125."""
    power = F.aggregate(F.sequence(F.lit(1), F.lit(125)), F.lit(1).cast("bigint"), lambda x, _: x * F.col("id") % ipa.MODULUS)
    return spark.range(1, ipa.MODULUS).select(F.col("id").alias("a"), power.alias("b"))


_RANK = values([(r["char"], r["rank"]) for r in alphabet.table()], "char, rank")
_ITEMS = "it AS (SELECT item_id, i - 1 AS item, trim(p[i]) AS raw FROM (SELECT item_id, string_split(text, ',') AS p FROM benchmark), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i))"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with is_number, neg, the body without its sign, and its ranks as digits d in base 307."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", ",")).alias("item", "raw")).withColumn("raw", F.trim("raw"))
    ranks = F.create_map(*(F.lit(x) for r in alphabet.table() for x in (r["char"], r["rank"])))
    rows = rows.withColumn("is_number", F.col("raw").rlike("^[+-]?[0-9]+$")).withColumn("neg", F.startswith("raw", F.lit("-"))).withColumn("body", F.regexp_replace("raw", "^[+-]", ""))
    rows = rows.withColumn("d", F.transform(F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", "")), lambda c: F.coalesce(F.element_at(ranks, c), F.lit(0))))
    return rows


@query(
    "q_cards",
    f"WITH {_ITEMS}, b AS (SELECT item_id, item, raw, regexp_matches(raw, '^[+-]?[0-9]+$') AS is_number, starts_with(raw, '-') AS neg, regexp_replace(raw, '^[+-]', '') AS body FROM it), ch AS (SELECT item_id, item, i, substr(body, i, 1) AS char FROM b, LATERAL (SELECT unnest(range(1, least(length(body), 15) + 1)) AS i) WHERE NOT is_number), n AS (SELECT item_id, item, list_reduce(list(CAST(coalesce(rank, 0) AS HUGEINT) ORDER BY i), lambda x, y: x * 307 + y) AS n FROM ch LEFT JOIN {_RANK} USING (char) GROUP BY item_id, item) SELECT b.item_id, CAST(b.item AS INTEGER) AS item, is_number, neg, CASE WHEN NOT is_number AND length(body) <= 15 THEN CAST(coalesce(n, 0) AS VARCHAR) END AS number FROM b LEFT JOIN n USING (item_id, item)",
)
def q_cards(spark, sf_dir):
    """Lines as cards, commas between items: signs, numerals, and strings as numbers in base 307 up to 15 characters."""
    number = F.when(~F.col("is_number") & (F.length("body") <= 15), W.number(F.col("d"), 307).cast("string"))
    return _cards(spark, sf_dir).select("item_id", "item", "is_number", "neg", number.alias("number"))


@query("q_cards_whole")
def q_cards_whole(spark, sf_dir):
    """q_cards with a number for every string, however long."""
    rows = _cards(spark, sf_dir).withColumn("d", F.when(~F.col("is_number"), F.col("d")))
    return expressions.numbered(rows.select("item_id", "item", "is_number", "neg", "d"), "d", 307).drop("d")


@query("q_card_totals", f"WITH {_ITEMS} SELECT item_id, count(*) AS items, count(*) FILTER (regexp_matches(raw, '^[+-]?[0-9]+$')) AS numerals, count(*) FILTER (starts_with(raw, '-')) AS negative FROM it GROUP BY item_id")
def q_card_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", ",")).alias("raw")).withColumn("raw", F.trim("raw"))
    return rows.groupBy("item_id").agg(F.count("*").alias("items"), F.count_if(F.col("raw").rlike("^[+-]?[0-9]+$")).alias("numerals"), F.count_if(F.startswith("raw", F.lit("-"))).alias("negative"))


_EXPRESSIONS = [("3", "3"), ("47*127", "5969"), ("(13*3*127/2^4)", "4953/16"), ("(3/93)", "1/31"), ("1/2+1/4", "3/4"), ("2^10", "1024"), ("-3", "-3"), ("(1+1/2)*4", "6"), ("2^-3", "1/8"), ("-2^2", "4"), ("7-9", "-2"), ("3 4", "34"), ("1/3+1/3+1/3", "1"), ("1/10+2/10", "3/10"), ("", None), ("(3", None), ("3)", None), ("3//2", None), ("1/0", None), ("2^(1/2)", None), ("*3", None), ("3 4 five", None)]


@query("q_expr", f"SELECT src, CAST(value AS VARCHAR) AS value, value IS NULL AS failed FROM {values(_EXPRESSIONS, 'src, value')}")
def q_expr(spark, sf_dir):
    rows = expressions.evaluated(spark.createDataFrame([(s,) for s, _ in _EXPRESSIONS], "src string"), "src")
    return rows.select("src", "value", F.col("error").isNotNull().alias("failed"))


_RACKS = {1: (["a = 3", "b = a*4", "b, b+1"], ["3", "12", "12", "13"]), 2: (["x = y", "y = 2"], [None, "2"]), 3: (["a = 3, 5, 7", "1, a, 100"], ["3", "5", "7", "1", "3", "5", "7", "100"]), 4: (["oops, 1/0, 3", "3 + 2, 4 * 9"], [None, None, "3", "5", "36"])}


def _rack_rows() -> list[tuple]:
    out = []
    for k, (cards, found) in _RACKS.items():
        i = iter(found)
        for at, n in enumerate(len(x) for x in expressions.rack(cards)):
            out += [(k, at, item, next(i)) for item in range(n)]
    return out


@query("q_vars", f"SELECT CAST(rack AS INTEGER) AS rack, CAST(card AS INTEGER) AS card, CAST(item AS INTEGER) AS item, CAST(value AS VARCHAR) AS value FROM {values(_rack_rows(), 'rack, card, item, value')}")
def q_vars(spark, sf_dir):
    rows = spark.createDataFrame([(k, i, c) for k, (cards, _) in _RACKS.items() for i, c in enumerate(cards)], "rack int, card int, src string")
    return expressions.racks(rows, "rack", "card", "src").select("rack", "card", "item", "value")


@query("q_order_expr", "SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN NULL WHEN o_orderkey % o_custkey = 0 THEN CAST(o_orderkey // o_custkey AS VARCHAR) ELSE CAST(o_orderkey // gcd(o_orderkey, o_custkey) AS VARCHAR) || '/' || CAST(o_custkey // gcd(o_orderkey, o_custkey) AS VARCHAR) END AS value FROM orders")
def q_order_expr(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", "o_orderkey", "o_custkey").alias("src"))
    return expressions.evaluated(rows, "src").select("o_orderkey", "value")


def index_entries(spark: SparkSession) -> DataFrame:
    """reading, langs, ipa, char, tone, strokes: one row for each branch of each character of the alphabet."""
    bases = F.create_map(*(F.lit(x) for kv in W._bases().items() for x in kv))
    rows = tables.base_table(spark).withColumn("g", F.coalesce(F.element_at(bases, F.col("char")), F.col("char")))
    # a glyph stands for letters in words only: in the index a digit is itself
    rules = tables.rules(spark).where(~F.col("grapheme").isin(list(phonetics.SHAPES)))
    out = rows.join(F.broadcast(rules), F.col("g") == F.col("grapheme"), "left")
    upper = (F.col("char") != F.lower("char")) & F.col("rom").isNotNull()
    reading = F.coalesce(F.when(upper, F.upper("rom")).otherwise(F.col("rom")), F.col("char"))
    return out.select(F.when(reading == "", "\u0000").otherwise(reading).alias("reading"), F.coalesce("langs", F.array(F.lit(phonetics.ANY))).alias("langs"), F.coalesce("ipa", F.lit("")).alias("ipa"), "char", (F.col("rank") - 1).alias("spell"), F.lit(0).alias("tone"), F.lit(0).alias("strokes"))


_ENTRIES = f"en AS (SELECT b.char, b.rank, CASE WHEN r.rom IS NULL THEN b.char WHEN lower(b.char) <> b.char THEN upper(r.rom) ELSE r.rom END AS reading, coalesce(r.langs, 'und') AS langs, coalesce(r.ipa, '') AS ipa FROM {values([(r['char'], r['rank'], W._bases().get(r['char'], '')) for r in alphabet.table()], 'char, rank, g')} b LEFT JOIN (SELECT * FROM {_RULES} WHERE regexp_matches(g, '[a-z]')) r ON b.g = r.g)"


@query("q_latin_index", f"WITH {_ENTRIES} SELECT char, CASE WHEN reading = '' THEN 'silent' ELSE reading END AS reading, langs, ipa FROM en")
def q_latin_index(spark, sf_dir):
    rows = index_entries(spark)
    return rows.select("char", F.when(F.col("reading") == "\u0000", "silent").otherwise(F.col("reading")).alias("reading"), F.array_join("langs", " ").alias("langs"), "ipa")


@query("q_multi_listed", f"WITH {_ENTRIES}, c AS (SELECT char, count(*) AS entries FROM en GROUP BY char) SELECT entries, count(*) AS characters FROM c GROUP BY entries")
def q_multi_listed(spark, sf_dir):
    return index_entries(spark).groupBy("char").agg(F.count("*").alias("entries")).groupBy("entries").agg(F.count("*").alias("characters"))


@query("q_lang_filter", f"WITH {_ENTRIES} SELECT want, count(*) AS entries FROM (SELECT unnest(['es', 'es-ES', 'en']) AS want), en WHERE len(list_filter(string_split(langs, ' '), lambda t: t = 'und' OR t = want OR starts_with(t, want || '-') OR starts_with(want, t || '-'))) > 0 GROUP BY want")
def q_lang_filter(spark, sf_dir):
    rows = index_entries(spark)
    kept = [characters.filtered(rows, w).agg(F.lit(w).alias("want"), F.count("*").alias("entries")) for w in ("es", "es-ES", "en")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("q_index_order")
def q_index_order(spark, sf_dir):
    """The index in order, with its flat codes: positions above the next power of two."""
    rows = index_entries(spark).withColumn("letters", W.letters(F.col("reading")))
    lang = F.lit(99)
    for i, t in enumerate([*phonetics.HAN_TAGS, phonetics.ANY]):
        lang = F.when(F.array_join("langs", "|") == t, i).otherwise(lang)
    rows = rows.withColumn("key", F.concat("letters", F.array(F.lit(alphabet.TERM), lang, "tone", "strokes", "spell")))
    out = characters.flat_codes(ordering.positions(rows, [F.col("key"), F.col("ipa")]))
    return out.select("position", "code", "char", F.array_join("langs", "|").alias("langs"), "ipa")


@query("q_base_round_trip", "SELECT CAST(306 AS BIGINT) AS written, CAST(306 AS BIGINT) AS read, CAST(0 AS BIGINT) AS lost")
def q_base_round_trip(spark, sf_dir):
    """The alphabet written as a file of tab-separated rows and read again."""
    path = shared.place(spark, "base")
    rows = tables.base_table(spark)
    tables.write_base(rows, path)
    back = tables.read_base(spark, path)
    counts = rows.agg(F.count("*").alias("written")).crossJoin(back.agg(F.count("*").alias("read"))).crossJoin(rows.exceptAll(back).agg(F.count("*").alias("lost")))
    return counts


@query("q_code_points")
def q_code_points(spark, sf_dir):
    """Assigned code points by general category, as this JVM's Unicode has them."""
    return tables.code_points(spark).groupBy("type").agg(F.count("*").alias("n"), F.min("cp").alias("first"))
