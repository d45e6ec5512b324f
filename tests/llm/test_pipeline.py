import collections

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from plait.llm import common, oracle
from tests.llm import data
from tests.llm.test_operators import brute_classes, crc, encoded, later_lines


def test_stages_in_order(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "packed"]


def test_run_equals_stages_and_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, sf), f"test-{i}")
        if i < 4:
            assert docs.columns == columns
            assert 0 < docs.count() <= (3 * n if i == 3 else n)
            n = docs.count()
        if i == 2:
            held = [tuple(r) for r in docs.collect()]
            assert all(links == 0 for _, _, links in brute_classes([(r[0], r[1]) for r in held])[0])
    want = collections.Counter(tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == want


def test_stages_bear_edges(spark):
    docs = data.table(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, ""), f"edge-{i}")
        assert docs.count() > 0
    none = data.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        none = stage(spark, none, "")
        assert none.count() == 0 and none.columns == data.empty(spark).columns


def by_sql(sql, rows):
    """What DuckDB finds for one of the operators' queries over rows (doc_id, text, lang, source)."""
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("text", "lang", "source"), 1)}})
    con = duckdb.connect()
    con.register("documents", documents)
    found = con.sql(sql)
    return [dict(zip(found.columns, r)) for r in found.fetchall()]


def without(text, gone):
    i, kept = -1, []
    for x in text.split("\n"):
        i += bool(data.words(x))
        if not (data.words(x) and i in gone):
            kept.append(x)
    return "\n".join(kept)


def test_run_against_brute_force(spark, tmp_path):
    """The five stages in plain Python and SQL, one after another, against what run() makes of the same documents."""
    rows = [r[:4] for seed in (1, 2) for r in data.unique_rows(seed) if seed == 1 or r[0] % 2]
    rows = [(doc + 1000 * (k >= len(data.unique_rows(1))), *rest) for k, (doc, *rest) in enumerate(rows)]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("text", "lang", "source"), 1)}, "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    kept = {r["doc_id"] for r in by_sql(oracle.QUALITY, rows) if r["kept"]}
    left = [r for r in rows if r[0] in kept]
    assert 20 < len(left) < len(rows)
    gone = later_lines(left)[1]
    assert any(gone.values())
    left = [(doc, without(text, gone[doc]), *rest) for doc, text, *rest in left]
    left = [r for r in left if not gone[r[0]] or data.words(r[1])]
    heads = {doc for doc, least, _ in brute_classes(left)[0] if doc == least}
    assert len(heads) < len(left)
    left = [r for r in left if r[0] in heads]
    copies = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in by_sql(oracle.MIX, left)}
    want = collections.Counter()
    for (doc, *_), ids in zip(left, encoded("word_bpe_49k.json", [r[1] for r in left])):
        ids = [*ids, 1]
        for i in range(0, len(ids), 4096):
            want[doc, i // 4096, i, len(ids[i : i + 4096]), crc(ids[i : i + 4096])] += copies[doc]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == +want
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 4096 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] for parts in held.values())
