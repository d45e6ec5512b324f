"""Goldens of the alphabet, word readings, orders and expressions."""

import itertools
import math
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plait.functions import alphabet, expressions, ipa, phonetics
from plait.functions import words as W
from plait.sources import tables

READS = "cat kat city siti gem jem game game knight nit night nit enough enouf ghost gost xylophone zilofone box boks psalm salm who wo what wat rose roze this dhis thin thin mother modher month month with widh width width breathe breadhe breath breath dips dips lapse lapse apse apse wright rit whom wom".split()
SEGMENTS = {"shit": "sh i t", "this": "th i s", "psalm": "ps a l m", "dips": "d i p s", "ghost": "gh o s t", "enough": "e n o u gh", "wright": "wr i gh t", "whom": "wh o m"}


def frame(spark, words):
    return spark.createDataFrame([(w,) for w in words], "w string")


def ordered(spark, words, want, by_sound=False):
    p = W.primary(F.col("w"), W.first_accept(want))
    rows = frame(spark, words).select("w", p.alias("p")).select("w", W.key(F.col("w"), F.col("p.rom")).alias("k"), W.ipa_digits(F.col("p.ipa")).alias("d"))
    return [r.w for r in rows.orderBy(*(["d", "k"] if by_sound else ["k"])).collect()]


def test_alphabet():
    rows = alphabet.table()
    assert len(rows) == 306 and [r["rank"] for r in rows] == list(range(1, 307))
    assert "".join(r["char"] for r in rows).startswith("0123456789aáàăâǎåǻäǟãȧǡąāȁȃAÁ")
    codes = [r["code"] for r in rows]
    assert codes == sorted(codes) and (codes[0], codes[9], codes[10], codes[-1]) == (4096, 11467, 16384, 65354)
    assert alphabet.letters("hello") == [31988, 25016, 38960, 38960, 42612]
    assert len(ipa.table()) == 126 and [r["sym"] for r in ipa.table()[:5]] == list("⦾⦿↑○ε")


def test_english_readings(spark):
    rows = frame(spark, READS[::2]).select("w", W.primary(F.col("w"), W.first_accept("en"))["rom"].alias("r")).collect()
    assert {r.w: r.r for r in rows} == dict(zip(READS[::2], READS[1::2]))


def test_segments(spark):
    rows = frame(spark, SEGMENTS).select("w", F.array_join(W.segments(F.col("w")), " ").alias("s")).collect()
    assert {r.w: r.s for r in rows} == SEGMENTS
    odd = frame(spark, ["a - b", "x.y", "-wh", ""]).select(W.segments(F.col("w")).alias("s")).collect()
    assert [r.s for r in odd] == [["a", "\x01", "b"], ["x", "\x01", "y"], ["\x01", "w", "h"], []]


@pytest.mark.parametrize(("word", "want", "reads"), [("c3rv3zas", "en leet", "servezas"), ("c3rv3zas", "en", "k3rv3zas"), ("cerveza", "es-ES", "therbetha"), ("cerveza", "en", "serveza"), ("box", None, "boks"), ("한국", None, "hangug"), ("🎩", None, "top hat"), ("α", "en", "alpha")])
def test_readings_by_language(spark, word, want, reads):
    assert frame(spark, [word]).select(W.primary(F.col("w"), W.first_accept(want))["rom"].alias("r")).first().r == reads


def test_orders(spark):
    assert ordered(spark, "canvas clear cervezas dox knicks kicks".split(), "en") == "dox canvas kicks clear knicks cervezas".split()
    assert ordered(spark, "church cat shoe sun top".split(), "en") == "church cat shoe sun top".split()
    assert ordered(spark, "church cat shoe sun top".split(), "en", True) == "cat sun shoe top church".split()


def test_all_readings(spark):
    w = F.col("w")
    got = frame(spark, ["cervezas"]).select(W.readings(w, None).alias("a"), W.readings(w, None, False).alias("b")).first()
    a, b = {"".join(p) for p in got.a}, {"".join(p) for p in got.b}
    assert len(got.a) == 32 and len(got.b) == 120 and a < b and "kervezas" in b - a
    lowest = frame(spark, ["box"]).select(F.array_min(F.transform(W.readings(w, None), lambda p: F.array_join(p, ""))).alias("x")).first().x
    assert lowest == "bokh"
    long = frame(spark, ["ccccccccccccccc"]).select(F.size(W.readings(w, None, False)).alias("n")).first().n
    assert long == 1  # over the cap: one reading, not a part of them


def test_spellings(spark):
    got = frame(spark, ["cervezas", ""]).select(W.spellings(F.col("w")).alias("s")).collect()
    assert {"c3rv3zas", "cervezas"} <= set(got[0].s) and got[1].s == [""]


def test_language_rules():
    assert phonetics.candidates("es en") == ["es-419", "es-ES", "en"] and phonetics.candidates("leet") == [None]
    assert phonetics.accepted("es-ES", set()) == {"es-ES", "es", "und"} and phonetics.accepted(None, set()) is None
    assert phonetics.answers(["es-ES"], ["es"]) and phonetics.answers(["es"], ["es-419"]) and not phonetics.answers(["es-ES"], ["es-419"])


EXPRESSIONS = {"3": 3, "47*127": 5969, "(13*3*127/2^4)": Fraction(4953, 16), "(3/93)": Fraction(1, 31), "1/2+1/4": Fraction(3, 4), "2^10": 1024, "-3": -3, "(1+1/2)*4": 6, "2^-3": Fraction(1, 8), "7-9": -2, "-2^2": 4, "2^3^2": 512, "3 4": 34, "10-2-3": 5, "8/2/2": 2}


def test_expressions():
    for text, want in EXPRESSIONS.items():
        assert expressions.evaluate(text)[0] == want, text
    for bad in ("", "(3", "3)", "3//2", "1/0", "2^(1/2)", "3 4 five", "*3", "2^99999", "0^-1"):
        with pytest.raises(expressions.Unreadable):
            expressions.evaluate(bad)
    assert expressions.evaluate("-6 + 2*(3-1)")[1] == [-6, 2, 3, 1]


def test_racks():
    values = lambda cards: [[v for v, _, _ in items] for items in expressions.rack(cards)]
    assert values(["a = 3", "b = a*4", "b, b+1"]) == [[3], [12], [12, 13]]
    assert values(["x = y", "y = 2"]) == [[None], [2]]
    assert values(["a = 3, 5, 7", "1, a, 100", "a+1", "b = "]) == [[3, 5, 7], [1, 3, 5, 7, 100], [None], []]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "base")
    tables.write_base(tables.base_table(spark), path)
    assert tables.read_base(spark, path).exceptAll(tables.base_table(spark)).count() == 0
    from plait.plans.texts import QUERIES

    index = str(tmp_path / "index")
    tables.write_rows(QUERIES["q_index_order"](spark, ""), index, "position")
    lines = [x for f in sorted((tmp_path / "index").glob("part-*")) for x in f.read_text(encoding="utf8").splitlines()]
    assert lines[0].startswith("# position") and [x.split("\t")[0] for x in lines[1:]] == [str(i) for i in range(525)]
    keys = tmp_path / "keys.txt"
    keys.write_text("@version 1\n0061  ; [.23EC.0020.0002] # a\n0061 0062 ; [.23EC.0020.0002][.1.2.3]\n00E1 ; [.23EC.0020.0002][.0000.0024.0002]\n")
    assert sorted(map(tuple, tables.read_collation_keys(spark, str(keys)).collect())) == [(0x61, 0x23EC, 0x20, 2), (0xE1, 0x23EC, 0x20, 2)]
    han = tmp_path / "han.txt"
    han.write_text("# c\nU+4E2D\tkMandarin\tzhōng\nU+4E2D\tkTotalStrokes\t4\nU+4E2D\tkOther\tx\n", encoding="utf8")
    r = tables.read_unihan(spark, str(han)).first()
    assert (r.cp, r.mandarin, r.strokes, r.korean) == (0x4E2D, "zhōng", "4", None)
    lex = tmp_path / "lex.txt"
    lex.write_text("Alpha\n\ntwo words\nbeta\nALPHA\n")
    assert sorted(r.word for r in tables.lexicon(spark, str(lex), "en").collect()) == ["alpha", "beta"]
    points = tables.code_points(spark)
    assert points.where("cp = 97").first().char == "a" and points.where("cp = 128000").first().char == "🐀" and points.where("cp between 55296 and 57343").count() == 0
    words = spark.createDataFrame([("en", f"w{i}") for i in range(50)] + [("es", f"v{i}") for i in range(3)], "tag string, word string")
    a, b = (sorted(map(tuple, tables.sample_words(words.repartition(n), 10).collect())) for n in (2, 7))
    assert a == b and len(a) == 13


def test_requests(spark):
    from plait.operators import api

    items = {(r.card, r.item): r for r in api.cards(spark, "hello, 3, 45\ncerveza\na, -a\na-b").collect()}
    assert len([k for k in items if k[0] == 0]) == 3 and not items[0, 2].codes and items[0, 2].is_number
    assert items[2, 0].codes == items[2, 1].codes and items[2, 1].neg and not items[2, 0].neg and not items[3, 0].neg
    assert "".join(r.reading for r in api.read(spark, "cerveza", "es-ES").where("branch = 0").orderBy("position").collect()) == "therbetha"
    assert api.positions(spark, "cervezas").count() == api.MOST_POSITIONS
    names = spark.createDataFrame([("he",), ("hell",), ("hello",), ("helllo",), ("helo",)], "name string")
    plain = [r.name for r in api.sort(names, "name").orderBy("key", "name").collect()]
    assert sorted(plain) == sorted(["he", "hell", "hello", "helllo", "helo"])
    top = api.sort(names.limit(1).selectExpr("'cervezas' as name"), "name", push="all").collect()
    assert len(top) == api.MOST_PUSH and all(r.truncated and r.of == 120 for r in top)
    assert api.base(spark).where("code < block_first or code > block_last").count() == 0
    with pytest.raises(ValueError):
        api.read(spark, "x" * 4001)

    d = api.ipa_digits(spark.createDataFrame([("tʃa",), ("",)], "ipa string"), "ipa").collect()
    assert len(d[0].digits) == 3 and d[0].number == (d[0].digits[0] * 256 + d[0].digits[1]) * 256 + d[0].digits[2]
    rows = sorted(api.ipa_texts(spark, ["tʃaʰ", "b"]).collect(), key=lambda r: (r.text, r.segment))
    assert [(r.text, r.segment, r.sym, r.marks) for r in rows] == [("b", 0, "b", []), ("tʃaʰ", 0, "t", []), ("tʃaʰ", 1, "ʃ", []), ("tʃaʰ", 2, "a", ["ʰ"])]


def test_racks_of_numbers(spark):
    from plait.operators import racks

    rows = spark.createDataFrame([(1, 1, 3, None), (1, 2, 10, "*"), (2, 1, 15, "+"), (2, 2, 15, "+"), (3, 1, 5, None), (3, 2, 7, None), (3, 3, 2, "-"), (4, 1, 0, None)], "g int, i int, k long, op string")
    got = {r.g: r for r in racks.evaluate(rows, "g", "i", "k", "op").collect()}
    assert (got[1].value, got[2].value, got[3].value, got[4].value) == ("15/128", "15/8", "5/16", "0")
    assert got[2].e == 1 and got[2].cells == "++++"


def test_characters_with_han(spark):
    from plait.operators import characters

    han = spark.createDataFrame([(0x4E2D, "zhōng zhòng", "zung1", "CHUU", "naka ATARU naka", "CWUNG", "4"), (0x4E00, None, None, "ICHI ITSU", None, None, "1"), (0x4E8D, None, None, None, None, None, "3")], "cp int, mandarin string, cantonese string, `on` string, kun string, korean string, strokes string")
    chars = spark.createDataFrame([(c,) for c in "中一亍aé한"], "char string")
    got = {r.char: r for r in characters.certified(characters.readings(chars, han)).collect()}
    assert (got["中"].reading, got["中"].tone, got["中"].strokes, got["中"].source) == ("zhong", 1, 4, 0)
    assert (got["一"].reading, got["一"].source, got["亍"].layer, got["한"].reading) == ("ichi", 2, "han-unread", "han")
    order = [r.char for r in sorted(got.values(), key=lambda r: r.position)]
    assert order.index("a") < order.index("é") < order.index("中")
    bits = spark.createDataFrame([(r.char, list(r.key)) for r in got.values()], "char string, key array<int>").select("char", characters.key_bits(F.col("key")).alias("b")).collect()
    assert [r.char for r in sorted(bits, key=lambda r: r.b)] == order
    entries = characters.han_entries(han)
    assert entries.where("cp = 20013").count() == 7  # one reading is listed twice
    assert {r.tone for r in entries.where("cp = 20013 and langs[0] = 'cmn'").collect()} == {1, 4}
    assert characters.filtered(entries, "ja-on").count() == 3
    assert sum(r.entries * r.characters for r in characters.multi_listed(entries).collect()) == entries.count()


def choices(word, tag, in_context=True):
    """For each grapheme of a lower-case word the spellings one candidate language admits, in plain Python."""
    accept = phonetics.accepted(tag, set())
    within = "|".join(g for g in phonetics.DIGRAPHS if g not in phonetics.INITIAL)
    segs = re.findall(f"^(?:{'|'.join(phonetics.INITIAL)})|{within}|.", word)
    out = []
    for i, g in enumerate(segs):
        found = []
        for r in (r for r in phonetics.rules() if r["grapheme"] == g):
            after, before = (segs[i + 1][0] if i + 1 < len(segs) else None), (segs[i - 1][-1] if i else None)
            good = r["first"] in (None, i == 0) and (not r["last"] or i == len(segs) - 1) and (r["nexts"] is None or (after or "-") in r["nexts"])
            good = good and not (r["no_nexts"] and after and after in r["no_nexts"]) and (r["befores"] is None or (before or "-") in r["befores"]) and (r["words"] is None or word in r["words"])
            known = accept is None or bool(accept & set(r["langs"]))
            found.append((in_context and not good, not known, r["ord"], r["rom"]))
        best = min(found)[:2]
        out.append(list(dict.fromkeys(x[3] for x in sorted(found) if x[:2] == best)))
    return out


def expanded(options):
    return [tuple(o[0] for o in options)] if math.prod(map(len, options)) > W.CAP else list(itertools.product(*options))


def test_readings_of_long_words(spark, tmp_path):
    long = ["responsibility", "characteristics", "internationalization", "misunderstandings", "thermodynamically", "cccccccccccccccc", "mmmmmmmmmmmmmmmmmmmmmmmm", "counterrevolutionaries", "bbbbbbbbbbbbb"]
    words = [*long, "cat", "box", "cervezas", "abcdefghijkl"]
    assert {13, 24} <= {len(w) for w in long} and min(map(len, long)) == 13
    for name, column, held in (("documents", "text", words[:5]), ("benchmark", "text", words[5:9]), ("part", "p_name", words[9:])):
        spark.createDataFrame([(" ".join(held),)], f"{column} string").write.parquet(str(tmp_path / f"{name}.parquet"))
    from plait.plans.texts import QUERIES

    want = {w: (len(expanded(choices(w, None))), len(expanded(choices(w, None, False))), min("".join(p) for t in phonetics.candidates("en") for p in expanded(choices(w, t)))) for w in words}
    assert {r.word: (r.readings, r.out_of_context, r.lowest_en) for r in QUERIES["q_readings"](spark, str(tmp_path)).collect()} == want
    assert any(n > 1 for w, (n, *_) in want.items() if len(w) > 12) and any(n == 1 for w, (n, *_) in want.items() if len(w) > 12)


def test_whole_numbers(spark, tmp_path):
    from plait.plans.texts import QUERIES

    items = ["a" * 15, "hello, ", "-" + "zebra" * 5, "+12", "naïve 中 " + "q" * 300, "é" * 2000, "-"]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = ["cat", "characteristics" * 3, "internationalization"]
    spark.createDataFrame([(" ".join(words),)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("naïve",)], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    ranks = {r["char"]: r["rank"] for r in alphabet.table()}

    def same(number, digits, base):
        """Held in pieces of nine decimal digits, as Python's own text of long integers is limited."""
        n = sum(d * base**i for i, d in enumerate(reversed(digits)))
        held = []
        while n:
            n, x = divmod(n, 10**9)
            held.append(f"{x:09d}")
        return number == ("".join(reversed(held)).lstrip("0") or "0")

    got = {(r.item_id, r.item): r for r in QUERIES["q_cards_whole"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(items):
        for j, raw in enumerate(x.strip() for x in text.split(",")):
            r = got.pop((i, j))
            assert r.neg == raw.startswith("-") and r.is_number == bool(re.fullmatch("[+-]?[0-9]+", raw))
            assert r.number is None if r.is_number else same(r.number, [ranks.get(c, 0) for c in re.sub("^[+-]", "", raw)], 307)
    assert not got
    rows = QUERIES["q_ipa_number_whole"](spark, str(tmp_path)).collect()
    assert all(same(r.number, [int(x) for x in r.digits.split()], ipa.BASE) for r in rows) and {w for w in words} <= {r.word for r in rows}
    assert max(len(r.digits.split()) for r in rows) > 15
