"""Cases that once failed: sums of many narrow numbers, hostile expressions, names that clash, codes of one width."""

from plait.functions import expressions
from plait.operators import alignment, characters
from plait.plans import texts
from plait.sources import tables


def test_align_sums_of_many_narrow_rows(spark):
    rows = spark.createDataFrame([(1, [1] * 54, 0)] * 600 + [(2, [1, 0, -1], 0)], "g int, d array<int>, e int")
    out = {r.g: r for r in alignment.align(rows, ["g"]).collect()}
    num, den = map(int, out[1].total.split("/"))
    assert (num << 54) == den * 600 * ((1 << 54) - 1) and out[2].total == "3/8"


HOSTILE = {"²": None, "1/²": None, "٣": None, "9" * 5000 + "+1": "large", "(" * 3000 + "7" + ")" * 3000: "7", "-" * 3001 + "7": "-7", "(" * 3000: None, "1__2": "12", "": None}


def test_expressions_bear_anything(spark):
    import sys

    rows = [(k,) for k in HOSTILE] + [(None,)]
    out = {r.src: r for r in expressions.evaluated(spark.createDataFrame(rows, "src string"), "src").collect()}
    sys.set_int_max_str_digits(0)
    for text, want in HOSTILE.items():
        if text.startswith("9"):
            assert out[text].value == str(10**5000) and out[text].error is None
        else:
            assert out[text].value == want and (out[text].error is None) == (want is not None), text[:20]
    assert out[None].value is None and out[None].error


def test_expressions_with_clashing_names(spark):
    df = spark.createDataFrame([("1/2", "kept", "x", 3)], "src string, other string, value string, error int")
    out = expressions.evaluated(df, "src")
    assert out.columns == ["src", "other", "value", "error", "operands"] and tuple(out.first())[:4] == ("1/2", "kept", "1/2", None)
    same = expressions.evaluated(df.selectExpr("src as value"), "value")
    assert same.columns == ["value", "error", "operands"] and same.first().value == "1/2"


def test_flat_codes_have_one_width(spark, sf):
    codes = [r.code for r in texts.q_index_order(spark, sf).collect()]
    assert min(codes) == 1024 and len({x.bit_length() for x in codes}) == 1 and len(codes) == len(set(codes)) == 525
    assert [r.code for r in characters.flat_codes(spark.range(1).withColumnRenamed("id", "position")).collect()] == [2]


def test_lexicon_takes_the_first_words(spark, tmp_path):
    path = tmp_path / "words"
    path.write_text("\n".join(["Beta", "two words", "", "alpha", "gamma", "delta"]))
    assert sorted(r.word for r in tables.lexicon(spark, str(path), "en", 3).collect()) == ["alpha", "beta", "gamma"]


def test_alphabet_as_given(spark):
    """The table's rows by rank, tab-separated, against the checksum of the published values."""
    import hashlib

    rows = ["\t".join(str(x) for x in r) for r in tables.base_table(spark).orderBy("rank").collect()]
    assert len(rows) == 306 and hashlib.sha256("\n".join(rows).encode()).hexdigest() == "49bba9f756d3331b74ad759f71cb1a1b704ef6653d27d62393ef92cdd809d4e3"


def against_sql(spark, tmp_path, name, **tables_):
    """The rows of a query and of its SQL over tables given as (DuckDB select)."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t, select in tables_.items():
        con.sql(f"COPY ({select}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str)
    assert sorted(got.columns) == sorted(want.columns) and rows == sorted(want.fetchall(), key=str)
    return [dict(zip(want.columns, r)) for r in rows]


def test_facts_round_the_shown_wavelength(spark, tmp_path):
    """Keys whose wavelength has a half in its fourth decimal once it is cut to six."""
    rows = against_sql(spark, tmp_path, "q_facts", orders="SELECT CAST(unnest([10378, 12357, 6282, 4165, 14474, 8261, 1, 0]) AS BIGINT) AS o_orderkey")
    assert {r["o_orderkey"]: r["nm"] for r in rows}[10378] == 435.425


def test_ratios_of_over_32_digits(spark):
    """Numerators of 33 to 37 digits, odd and even, both signs, against fractions."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    from plait.functions import digits

    wide = [(s * n, p) for n in (10**32 + 1, 2**119 - 1, 2**119, 3 * 2**61, 3 * 2**62, 3 * 2**63, 2**124 - 2**70, 10**36, 12345678901234567890 << 40) for s in (1, -1) for p in (0, 1, 61, 62, 63, 112, 120, 124)]
    rows = spark.createDataFrame([(str(n), p) for n, p in wide], "n string, p int")
    got = {(int(r.n), r.p): r.v for r in rows.withColumn("v", digits.ratio(F.col("n").cast(digits.EXACT), F.col("p"))).collect()}
    assert got == {(n, p): str(Fraction(n, 1 << p)) for n, p in wide}


def test_chains_of_large_many_and_null_operands(spark, tmp_path):
    """Orders of seven operands of 16 bits, of 300, and with a null."""
    import math
    from fractions import Fraction

    import duckdb

    import __spark_entry__ as entry

    keys = {1: [59999, 65535, 65533, 61001, 59001, 65521, 65519], 2: [4095] * 300, 3: [7, None, 5], 4: [0, 4], 5: [6]}
    lines = ", ".join(f"({o}, {i}, {'NULL' if k is None else k})" for o, ks in keys.items() for i, k in enumerate(ks))
    duckdb.sql(f"COPY (SELECT CAST(o AS BIGINT) AS l_orderkey, CAST(i AS INTEGER) AS l_linenumber, CAST(k AS BIGINT) AS l_suppkey FROM (VALUES {lines}) t(o, i, k)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = {r.l_orderkey: (r.operands, r.value) for r in entry.queries()["q_mul_chain"](spark, str(tmp_path)).collect()}
    places = lambda k: 4 * -(-max(1, k.bit_length()) // 4) if k else 1
    want = {o: (len(ks), None if None in ks else str(Fraction(math.prod(ks), 1 << sum(map(places, ks))))) for o, ks in keys.items()}
    assert got == want
    assert int(got[1][1].split("/")[0]) > 10**32


def test_product_grids_make_no_rows_of_cells(spark, tmp_path):
    """Operands of 1 to 64 cells, zeros and nulls: counts as in SQL and in the grid's cells, grouped once."""
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from plait.functions import arithmetic, digits

    keys = "[0, 1, 15, 16, 255, 999, 20000, 65535, 65536, 1199999, 4294967297, 9007199254740991, 9223372036854775806, NULL]"
    rows = against_sql(spark, tmp_path, "q_product_grid", lineitem=f"SELECT CAST(a AS BIGINT) AS l_partkey, CAST(b AS BIGINT) AS l_suppkey FROM (SELECT unnest({keys}) AS a), (SELECT unnest({keys}) AS b)")
    assert len(rows) == 13 * 13 * 3 - (13 + 12) * 1 - 1  # a single row or column has no inner cell, a single cell no outer one
    plan = entry.queries()["q_product_grid"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    few = spark.createDataFrame([(a, b) for a in (0, -5, 300, -70000) for b in (0, 7, 999)], "a long, b long")
    cells = few.select("a", "b", F.inline(arithmetic.grid(digits.hex_cells(F.col("a")), digits.hex_cells(F.col("b"))))).groupBy("a", "b", "region").agg(F.count("*"), F.count_if(F.col("v") != 0), F.min("w"))
    counts = few.select("a", "b", F.inline(arithmetic.grid_regions(F.col("a"), F.col("b"))))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, cells.collect()))


def test_knobs_of_any_width(spark, tmp_path):
    """Bounds whose ticks fill no memory, the least bounds, and a null; few ticks as made and counted."""
    rows = against_sql(spark, tmp_path, "q_knob_ticks", customer="SELECT CAST(unnest([0, 1, 9, 10, 11, 19, 20, 900000, 3000000000, 1000000000000000007, NULL]) AS BIGINT) AS c_custkey")
    for r in rows:
        if r["last"] < 10**6:
            ticks = range(r["first"], r["last"] + 1)
            assert (r["ticks"], r["tens"]) == (len(ticks), sum(t % 10 == 0 for t in ticks))
    assert {r["c_custkey"]: r["tens"] for r in rows}[1000000000000000007] == 200000000000000001


def test_op8_encoder_looks_by_steps(monkeypatch):
    """Blocks have the bytes that they had when every row of lanes was looked up by itself, which took the time."""
    import hashlib

    import numpy as np

    from plait.llm import rangecoder

    def ids(n):
        i = np.arange(n, dtype=np.uint64)
        h = (i * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        return np.where(h % 3 == 0, h % 65536, np.where(i % 7 < 4, i % 7, (i // 50) % 90)).astype(np.uint32)

    digests = {1: "31bb28dec9489b7e", 5000: "f0b12ba8f438a8fe", 300001: "ea6d65e526d4a2b7"}
    with monkeypatch.context() as m:
        m.delattr(rangecoder._Models, "look")  # what the decoder needs row by row
        blocks = {n: rangecoder.encode(ids(n)) for n in digests}
    assert {n: hashlib.sha256(b).hexdigest()[:16] for n, b in blocks.items()} == digests
    for n, b in blocks.items():
        assert np.array_equal(rangecoder.decode(b), ids(n))


def test_op1_memory_of_a_batch(monkeypatch):
    """The largest batch, of words of one letter, takes a few times its bytes (about forty before); parts of any size give the same ids."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from plait.llm import tokens

    encoder = tokens.Encoder("word_bpe_49k.json", keeps_blanks=False)
    texts = pa.array(["a b " * (1 << 18)] * 16)
    encoder.arrow(texts[:1])
    tracemalloc.start()
    ids, n = encoder.arrow(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [1 << 19] * 16 and len(ids) == 1 << 23
    assert peak < 12 * texts.nbytes

    odd = [None, "", "one two", "", "x" * 300, "a\tb " * 50, "é, " * 40, None, " ", "", "end.", ""]
    for column in (pa.array(odd), pa.array(["skipped", *odd])[1:], pa.array([None, ""], pa.string())):
        own = [encoder.arrow(column[i : i + 1]) for i in range(len(column))]
        for size in (1, 7, 100, 1 << 21):
            monkeypatch.setattr(tokens, "_TEXTS", size)
            ids, n = encoder.arrow(column)
            assert n.tolist() == [int(c[0]) for _, c in own] and np.array_equal(ids, np.concatenate([i for i, _ in own]))


def test_op6_memory_of_a_task(monkeypatch):
    """What a million words, their candidates and one bucket of these take, in MB (91, 106 and 77 before); long rows go in batches of their own."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from plait.llm import substrings

    monkeypatch.setattr(substrings, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{(i // 2 * 7 + j * j) % 997}" for j in range(4096)) for i in range(256)]
    ids, every = pa.array(range(256), pa.int64()), substrings.steps(np.arange(0, 4090))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts), pa.array([every] * 256, pa.binary())], ["doc_id", "th", "text", "hits"])

    def peak(made):
        rows, sizes = [], []
        tracemalloc.start()
        for b in made:
            sizes.append(b.nbytes)
            rows += [] if rows else [b]  # the first is kept, others only counted
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / (1 << 20), rows, max(sizes)

    substrings.word_hashes([w for t in texts for w in t.encode().split()])
    probe, _, _ = peak(substrings._probe_chunks(200)(iter([batch])))
    candidates, rows, largest = peak(substrings._candidate_chunks(1)(iter([batch])))
    repeats, _, _ = peak(substrings._find_repeats(iter(rows), 8))
    assert (probe < 60, candidates < 70, repeats < 55) == (True, True, True), (probe, candidates, repeats)
    several = [b.num_rows for b in substrings._candidate_chunks(4)(iter([batch]))]
    assert several == [1] * 4 and largest > 4 << 20


def test_op6_small_tables_are_few_files(spark, monkeypatch):
    """What op6 keeps of documents, repeats and cuts is written in fewer files than a shuffle has parts (one a part before)."""
    from pathlib import Path
    from urllib.parse import urlparse

    from plait.llm import common, substrings

    files, write = {}, common.written

    def written(df, name, *a):
        out = write(df, name, *a)
        files[name] = len(list(Path(urlparse(out._plait_path).path).glob("part-*")))
        return out

    monkeypatch.setattr(common, "written", written)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = [(i, " ".join(f"w{(i // 2 * 31 + j) % 9973}" for j in range(40))) for i in range(400)]
        got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.n_removed > 0 for r in got) >= 200 and len(got) == 400
    small = {k: n for k, n in files.items() if k != "substring-texts"}
    assert len(small) >= 3 and max(small.values()) < 12, files
