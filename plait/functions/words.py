"""Words as graphemes, readings and sort keys, row by row without a shuffle.

The declared tables are literal maps; a word's graphemes look their branches up, test them against their neighbours and
keep the best by (condition holds, language accepted, declared order). Nothing leaves the JVM.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions import alphabet, ipa, phonetics
from plait.functions.digits import let

BREAK = alphabet.SEPARATOR
CAP = 4096
_SEPARATORS = r"^[\p{P}\p{Z}\p{C}&&[^@!]]+$"
#: Romanised parts of Hangul syllables.
HANGUL_LEADS = ("g", "gg", "n", "d", "dd", "r", "m", "b", "bb", "s", "ss", "", "j", "jj", "c", "k", "t", "p", "h")
HANGUL_VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "weo", "we", "wi", "yu", "eu", "yi", "i")
HANGUL_TAILS = ("", "g", "gg", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "c", "k", "t", "p", "h")


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _array(items) -> Column:
    return F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")


@cache
def _rules_sql() -> str:
    """map<grapheme, array<struct<...>>> as SQL, which is folded into one literal."""
    quote = lambda x: "cast(null as string)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    held: dict[str, list[str]] = {}
    for r in phonetics.rules():
        langs = ", ".join(quote(t) for t in r["langs"])
        words = "cast(null as array<string>)" if r["words"] is None else f"array({', '.join(quote(w) for w in r['words'])})"
        first = "cast(null as boolean)" if r["first"] is None else str(r["first"]).lower()
        held.setdefault(r["grapheme"], []).append(f"named_struct('ord', {r['ord']}, 'ipa', {quote(r['ipa'])}, 'rom', {quote(r['rom'])}, 'langs', array({langs}), 'first', {first}, 'last', {str(r['last']).lower()}, 'nexts', {quote(r['nexts'])}, 'no_nexts', {quote(r['no_nexts'])}, 'befores', {quote(r['befores'])}, 'words', {words})")
    return "map(" + ", ".join(f"{quote(g)}, array({', '.join(rs)})" for g, rs in held.items()) + ")"


def segments(word: Column) -> Column:
    """Graphemes by longest match; runs of separators are one break."""
    return F.transform(F.regexp_extract_all(word, F.lit(phonetics.SEGMENT), F.lit(0)), lambda s: F.when(s.rlike(_SEPARATORS), BREAK).otherwise(s))


def named(char: Column) -> Column:
    """What a character outside the alphabet is read as: syllable, core of its letter's name, or whole name."""
    cp = F.ascii(char)
    s = cp - 0xAC00
    hangul = F.concat(F.element_at(_array(HANGUL_LEADS), (s / 588).cast("int") + 1), F.element_at(_array(HANGUL_VOWELS), (s % 588 / 28).cast("int") + 1), F.element_at(_array(HANGUL_TAILS), (s % 28).cast("int") + 1))
    han = F.concat(F.lit("cjk unified ideograph-"), F.lower(F.hex(cp.cast("bigint"))))
    name = F.call_function("java_method", F.lit("java.lang.Character"), F.lit("getName"), cp)
    core = F.regexp_extract(name, r"\b(?:LETTER|SYLLABLE|SYLLABICS|VOWEL SIGN|DIGIT|SIGN|CHARACTER)\s+(.*)$", 1)
    script = F.when(F.contains(name, F.lit("CAPITAL")), core).otherwise(F.lower(core))
    return F.when(cp.between(0xAC00, 0xD7A3), hangul).when(cp.between(0x4E00, 0x9FFF) | cp.between(0x3400, 0x4DBF) | cp.between(0x20000, 0x323AF), han).when((core != "") & char.rlike(r"^\p{L}"), script).otherwise(F.coalesce(F.lower(name), F.lit(BREAK)))


@cache
def _bases() -> dict[str, str]:
    return {r["char"]: alphabet.base_letter(r["char"]) for r in alphabet.table() if r["type"] == "letter"}


def branches(word: Column, accept: Column | None, in_context: bool = True) -> Column:
    """For each grapheme, structs bad, foreign, ord, rom, ipa of every branch, the best first.

    accept: the tags of one candidate, null or None for all. Branches that fail their condition are bad, those of other
    languages foreign; where all are, they still stand, so that no grapheme is lost. Out of context none is bad.
    """
    every = F.lit(True) if accept is None else accept.isNull()
    held = F.array().cast("array<string>") if accept is None else F.coalesce(accept, F.array().cast("array<string>"))
    table, bases = F.expr(_rules_sql()), _map(_bases())
    glyphs = _map({g: s[0] for g, s in phonetics.SHAPES.items()})

    def of(p: Column) -> Column:
        segs, view = p["s"], p["v"]

        def one(seg: Column, i: Column) -> Column:
            first = F.substring(seg, 1, 1)
            upper = first != F.lower(first)
            key = F.when(F.length(seg) > 1, F.lower(seg)).otherwise(F.coalesce(F.element_at(bases, seg), seg))
            after, before = F.lower(F.substring(F.get(view, i + 1), 1, 1)), F.lower(F.right(F.get(view, i - 1), F.lit(1)))
            within = lambda c, s: F.coalesce(F.contains(s, c), F.lit(False))

            def branch(r: Column) -> Column:
                good = (
                    (r["first"].isNull() | (r["first"] == (i == 0))) & (~r["last"] | (i == F.size(segs) - 1))
                    & (r["nexts"].isNull() | within(after, r["nexts"])) & (r["no_nexts"].isNull() | ~within(after, r["no_nexts"]))
                    & (r["befores"].isNull() | within(before, r["befores"])) & (r["words"].isNull() | F.array_contains(r["words"], F.lower(word)))
                )
                known = every | F.array_contains(r["langs"], phonetics.ANY) | F.arrays_overlap(r["langs"], held)
                return F.struct((~good if in_context else F.lit(False)).alias("bad"), (~known).alias("foreign"), r["ord"].alias("ord"), F.when(upper, F.upper(r["rom"])).otherwise(r["rom"]).alias("rom"), r["ipa"].alias("ipa"))

            def plain(rom: Column, sound: str) -> Column:
                return F.array(F.struct(F.lit(False).alias("bad"), F.lit(False).alias("foreign"), F.lit(0).alias("ord"), rom.alias("rom"), F.lit(sound).alias("ipa")))

            found = F.element_at(table, key)
            return F.when(seg == BREAK, plain(F.lit(BREAK), "·")).when(found.isNull(), plain(named(seg), "")).otherwise(F.sort_array(F.transform(found, branch)))

        return F.transform(segs, one)

    reads_glyphs = every | F.array_contains(held, phonetics.SHAPE_TAG)
    return let(segments(word), lambda s: let(F.struct(s.alias("s"), F.when(reads_glyphs, F.transform(s, lambda g: F.coalesce(F.element_at(glyphs, g), g))).otherwise(s).alias("v")), of))


def tags(accept: set[str] | None) -> Column | None:
    return None if accept is None else _array(sorted(accept))


def first_accept(want: str | None) -> Column | None:
    return tags(phonetics.accepted(phonetics.candidates(want)[0], phonetics.shapes(want)))


def primary(word: Column, accept: Column | None) -> Column:
    """struct(rom, ipa) of the one reading a word sorts at: the first branch of each grapheme."""
    best = F.transform(branches(word, accept), lambda bs: bs[0])
    joined = lambda p: F.struct(F.array_join(F.transform(p, lambda b: b["rom"]), "").alias("rom"), F.array_join(F.transform(F.filter(p, lambda b: b["ipa"] != "·"), lambda b: b["ipa"]), "").alias("ipa"))
    return let(best, joined)


def product(options: Column) -> Column:
    """Every choice of one option from each list, the last varying fastest; over CAP of them, only the first of each."""
    many = F.aggregate(options, F.lit(1).cast("bigint"), lambda n, o: F.least(n * F.size(o), F.lit(CAP + 1).cast("bigint"))) > CAP
    one = F.array(F.transform(options, lambda o: o[0]))
    empty = F.array(F.array().cast("array<string>"))
    every = F.aggregate(options, empty, lambda made, o: F.flatten(F.transform(made, lambda m: F.transform(o, lambda x: F.concat(m, F.array(x))))))
    return F.when(many, one).otherwise(every)


def _options(word: Column, want: str | None, tag: str | None, in_context: bool) -> Column:
    """The distinct spellings of each grapheme that one candidate language admits."""
    accept = tags(phonetics.accepted(tag, phonetics.shapes(want)))
    fit = lambda bs: F.filter(bs, lambda b: (b["bad"] == bs[0]["bad"]) & (b["foreign"] == bs[0]["foreign"]))
    return F.transform(branches(word, accept, in_context), lambda bs: F.array_distinct(F.transform(fit(bs), lambda b: b["rom"])))


def readings(word: Column, want: str | None, in_context: bool = True) -> Column:
    """Every reading, as lists of spellings of its graphemes: of one candidate language after another, each once."""
    each = [let(_options(word, want, t, in_context), product) for t in phonetics.candidates(want)]
    return each[0] if len(each) == 1 else F.array_distinct(F.concat(*each))  # distinct options have distinct choices


def count_readings(word: Column, want: str | None, in_context: bool = True) -> Column:
    """The size of readings(), without making them where there is one candidate language."""
    found = phonetics.candidates(want)
    if len(found) > 1:
        return F.size(readings(word, want, in_context))
    n = F.aggregate(_options(word, want, found[0], in_context), F.lit(1), lambda n, o: F.least(n * F.size(o), F.lit(CAP + 1)))
    return let(n, lambda n: F.when(n > CAP, 1).otherwise(n))


def spellings(word: Column) -> Column:
    """Every spelling of look-alike characters, the typed one first; over CAP of them, only that."""
    like = phonetics.lookalikes()
    table = F.create_map(*(x for c, v in like.items() for x in (F.lit(c), _array(v))))
    options = F.transform(F.split(word, ""), lambda c: F.coalesce(F.element_at(table, c), F.array(c)))
    return F.when(word == "", F.array(F.lit(""))).otherwise(F.transform(let(options, product), lambda p: F.array_join(p, "")))


def letters(text: Column) -> Column:
    """The code of each character of a spelling."""
    table = _map({**alphabet.codes(), " ": alphabet.SPACE, "-": alphabet.HYPHEN})
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.transform(chars, lambda c: F.coalesce(F.element_at(table, c), F.element_at(table, F.lower(c)), alphabet.OUTSIDE + F.ascii(c)))


@cache
def _decomposed() -> dict[str, list[int]]:
    import unicodedata

    return {r["char"]: alphabet.letters(unicodedata.normalize("NFD", r["char"])) for r in alphabet.table() if len(unicodedata.normalize("NFD", r["char"])) > 1}


def key(word: Column, rom: Column) -> Column:
    """The sort key: letters of the reading, the end, letters of the decomposed spelling. Arrays compare as they should."""
    marks = F.create_map(*(x for c, v in _decomposed().items() for x in (F.lit(c), F.array(*map(F.lit, v)))))
    chars = F.when(word == "", F.array().cast("array<string>")).otherwise(F.split(word, ""))
    return F.concat(letters(rom), F.array(F.lit(alphabet.TERM)), F.flatten(F.transform(chars, lambda c: F.coalesce(F.element_at(marks, c), letters(c)))))


def ipa_digits(sounds: Column) -> Column:
    """The rank of each symbol of a transcription; marks belong to the symbol before, anything else is skipped."""
    table = _map({r["sym"]: r["rank"] for r in ipa.table()})
    return F.transform(F.filter(F.split(sounds, ""), lambda c: F.element_at(table, c).isNotNull()), lambda c: F.element_at(table, c))


def ipa_segments(sounds: Column) -> Column:
    """Structs sym, marks of a transcription: marks belong to the symbol before them, anything else is skipped."""
    known, marks = [r["sym"] for r in ipa.table()], [m for m, _ in ipa.DIACRITICS]
    none = F.array().cast("array<struct<sym:string,marks:array<string>>>")

    def step(made: Column, c: Column) -> Column:
        last = F.element_at(made, -1)
        marked = F.concat(F.slice(made, F.lit(1), F.size(made) - 1), F.array(F.struct(last["sym"].alias("sym"), F.concat(last["marks"], F.array(c)).alias("marks"))))
        fresh = F.concat(made, F.array(F.struct(c.alias("sym"), F.array().cast("array<string>").alias("marks"))))
        return F.when(c.isin(known), fresh).when(c.isin(marks) & (F.size(made) > 0), marked).otherwise(made)

    return F.aggregate(F.when(sounds == "", F.array().cast("array<string>")).otherwise(F.split(sounds, "")), none, step)


def ranks(text: Column) -> Column:
    """The rank of each character of a spelling, 0 for those outside the alphabet."""
    table = _map({r["char"]: r["rank"] for r in alphabet.table()})
    return F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), lambda c: F.coalesce(F.element_at(table, c), F.lit(0)))


def code_regions(code: Column) -> Column:
    """struct(inner, fold, outer, lit): the lit bits of a 16-bit code laid into a square of four, by region."""
    cells = F.transform(F.split(F.lpad(F.bin(code.cast("bigint")), 16, "0"), ""), lambda c: c.cast("int"))
    where = lambda i: (i / 4).cast("int") + i % 4
    part = lambda keep: F.size(F.filter(cells, lambda c, i: (c == 1) & keep(where(i))))
    return F.struct(part(lambda d: d < 3).alias("inner"), part(lambda d: d == 3).alias("fold"), part(lambda d: d > 3).alias("outer"), part(lambda d: d >= 0).alias("lit"))


def fraction(digits: Column, base: int) -> Column:
    """Digits behind the point of a base, as a double: a prefix is smaller, whatever follows."""
    return F.aggregate(F.reverse(digits), F.lit(0.0), lambda a, d: (a + d) / base)


def number(digits: Column, base: int) -> Column:
    """Digits as coefficients of powers of the base: exact, or null where the result has over 38 decimal digits."""
    most = int(38 / len(str(base - 1))) if base < 10 else max(n for n in range(1, 60) if base**n < 10**38)
    total = F.aggregate(digits, F.lit("0").cast("decimal(38,0)"), lambda a, d: (a * base + d).cast("decimal(38,0)"))
    return F.when(F.size(digits) <= most, total)


def lexicon_tag(word: Column, want: str, member: dict[str, Column]) -> Column:
    """The first candidate whose lexicon (its own or its bare language's) has the word; member: tag to a boolean column."""
    hits = [F.when(reduce(lambda a, b: a | b, (member[x] for x in {t, t.split("-")[0]} if x in member)), t) for t in phonetics.candidates(want) if t and ({t, t.split("-")[0]} & member.keys())]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")
