"""Substring deduplication by fixed-block anchors.

Any WINDOW = 13 words hold a whole block of BLOCK = 7 words that starts at a multiple of 7 in their document. So:

1. Index the non-overlapping blocks of all documents and probe them with every rolling window of 7 words.
2. Extend the hits: every window of 13 words that holds a hit is a candidate, in either document.
3. A candidate whose words also start in a document with a smaller doc_id is a repeat; overlapping repeats are maximal ones.

Both lookups are exchanges of packed hashes: a task's rolling windows are split by hash into buckets, and a row carries
one bucket's share of some million words as bytes (32 or 64 further bits of the hash, steps between positions, and marks
for indexed places or lengths of documents). So a word costs about five bytes in the first exchange; the second has
candidates only. A passage that a third of all documents hold is counted where its hash lands, never paired.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import common

WINDOW, BLOCK = 13, 7
CHUNK = 1 << 20  # words in a task's share of one exchange row set
BUCKET = 1 << 25  # characters of all texts for each bucket that a task holds at once
PASSED = 1 << 20  # bytes of rows made before they are passed on
REMEMBERED = 150_000
MULTIPLIER, SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_DOCUMENT = "<?qqI32s"  # without a doc_id, doc_id, hash of the text, words, SHA-256 of them
_KEY = np.dtype([("null", "?"), ("doc", "<i8"), ("th", "<i8")])
_memo: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word; frequent words are remembered."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out = list(map(_memo.get, words))
    if None in out:
        room = len(_memo) < REMEMBERED
        for i, h in enumerate(out):
            if h is None:
                out[i] = h = digest(words[i])
                if room and len(words[i]) <= 32:
                    _memo[words[i]] = h
    return np.array(out, np.uint64)


def rolling(h: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """The polynomial of every n hashes in a row."""
    m = len(h) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(n if m > 0 else 0):
        out *= np.uint64(multiplier)
        out += h[i : i + m]
    out ^= out >> np.uint64(29)
    return out


def steps(positions: np.ndarray) -> bytes:
    """Ascending positions as their differences, in bytes; a byte 255 says that four bytes follow at the end."""
    d = np.diff(positions, prepend=0)
    far = d >= 255
    return struct.pack("<I", len(d)) + np.where(far, 255, d).astype(np.uint8).tobytes() + d[far].astype("<u4").tobytes()


def steps_end(data: bytes, at: int) -> tuple[int, int]:
    """How many positions steps() put there, and where they end."""
    n = struct.unpack_from("<I", data, at)[0]
    return n, at + 4 + n + 4 * data.count(b"\xff", at + 4, at + 4 + n)


def unsteps(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n = struct.unpack_from("<I", data, at)[0]
    d = np.frombuffer(data, np.uint8, n, at + 4).astype(np.int64)
    far = np.flatnonzero(d == 255)
    d[far] = np.frombuffer(data, "<u4", len(far), at + 4 + n)
    return np.cumsum(d), at + 4 + n + 4 * len(far)


_PACKED = "bucket int, chunk long, kind int, payload binary"
_NAMES = ["bucket", "chunk", "kind", "payload"]


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], _NAMES)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.uint32) % np.uint32(buckets)


def _batches(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 64 rows, and of little more than PASSED bytes unless one row has them; none is held once passed on."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if len(held) == 64 or size >= PASSED:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _probe_chunks(buckets: int):
    """Packs every rolling window of BLOCK words, marking indexed blocks, and passes on each chunk's table of documents."""

    def pack(chunk: int, docs: list[tuple], hashes: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
        lengths = np.array([len(h) for h in hashes], np.int64)
        h, first = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(lengths) - lengths
        hashes.clear()
        bucket = _bucket(rolling(h, BLOCK, SECOND), buckets).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        low = rolling(h, BLOCK, MULTIPLIER).astype("<u4")
        del h
        inside = np.arange(len(low), dtype=np.int32)
        inside -= np.repeat(first.astype(np.int32), lengths)[: len(low)]
        use = np.flatnonzero(inside <= np.repeat((lengths - BLOCK).astype(np.int32), lengths)[: len(low)]).astype(np.int32)
        marked = inside % BLOCK == 0
        del inside
        bucket = bucket[use]
        counts = np.bincount(bucket, minlength=buckets)
        order = use[np.argsort(bucket, kind="stable")]
        del use, bucket
        at = 0
        for b in np.flatnonzero(counts):
            part = order[at : at + int(counts[b])]
            yield int(b), chunk, 0, steps(part) + low[part].tobytes() + np.packbits(marked[part]).tobytes()
            at += int(counts[b])
        yield chunk % buckets, chunk, 1, b"".join(struct.pack(_DOCUMENT, d is None, d or 0, th, n, sha) for d, th, n, sha in docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, docs, hashes, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                docs.append((doc, th, len(words), hashlib.sha256(b" ".join(words)).digest()))
                hashes.append(word_hashes(words))
                size += len(words)
                if size >= CHUNK:
                    yield from _batches(pack(part << 32 | number, docs, hashes))
                    number, docs, hashes, size = number + 1, [], [], 0
        if docs:
            yield from _batches(pack(part << 32 | number, docs, hashes))
        common.released()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """Rows of one key after another, from partitions sorted by it."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
            k = row[_NAMES.index(key)]
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(row)
    if held:
        yield now, held


def _find_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each bucket: the places of every hash that stands twice or more and at an indexed block at least once."""

    def hits(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        yield from (r for r in rows if r[2] == 1)
        rows = [r for r in rows if r[2] == 0]
        if rows:
            ends = [steps_end(data, 0) for _, _, _, data in rows]
            h = np.concatenate([np.frombuffer(data, "<u4", n, i) for (_, _, _, data), (n, i) in zip(rows, ends)])
            marked = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8, -1, i + 4 * n), count=n) for (_, _, _, data), (n, i) in zip(rows, ends)]).astype(bool)
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.append(new, len(h)))
            hit = np.zeros(len(h), bool)
            hit[order] = np.repeat((times >= 2) & np.logical_or.reduceat(marked[order], new), times)
            del h, marked, order, new, times
            start = 0
            for (_, chunk, _, data), (n, _) in zip(rows, ends):
                own = np.flatnonzero(hit[start : start + n])
                start += n
                if len(own):
                    yield 0, chunk, 0, steps(unsteps(data, 0)[0][own])

    for _, rows in _grouped(batches, "bucket"):
        yield from _batches(hits(rows))
    common.released()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each chunk's hits to its documents: doc_id, th, n_words, sha256, hits."""
    for _, rows in _grouped(batches, "chunk"):
        docs = [d for _, _, kind, data in rows if kind == 1 for d in struct.iter_unpack(_DOCUMENT, data)]
        hits = [unsteps(data, 0)[0] for _, _, kind, data in rows if kind == 0]
        every = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        ends = np.cumsum([d[3] for d in docs])
        cut = np.searchsorted(every, np.concatenate([[0], ends]))
        own = [steps(every[a:b] - (e - d[3])) if b > a else None for d, e, a, b in zip(docs, ends, cut[:-1], cut[1:])]
        for i in range(0, len(docs), 512):
            part = docs[i : i + 512]
            columns = [pa.array([None if d[0] else d[1] for d in part], pa.int64()), pa.array([d[2] for d in part], pa.int64()), pa.array([d[3] for d in part], pa.int64()), pa.array([d[4].hex() for d in part]), pa.array(own[i : i + 512], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_words", "sha", "hits"])
    common.released()


def _candidates(hits: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold a hit whole."""
    reach = WINDOW - BLOCK
    mark = np.zeros(n_words + reach + 2, np.int32)
    np.add.at(mark, np.maximum(hits - reach, 0), 1)
    np.add.at(mark, hits + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(n_words - WINDOW + 1, 0)] > 0)


def _candidate_chunks(buckets: int):
    """Packs the candidates of documents with hits: hash, and runs of (doc_id, th, how many, their starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, size = TaskContext.get().partitionId(), [], 0

        def flush() -> Iterator[tuple[int, int, int, bytes]]:
            heads = np.array([(d[0] is None, d[0] or 0, d[1]) for d in docs], _KEY)
            number = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[2]) for d in docs])
            at, h, bucket = (np.concatenate([d[k] for d in docs]) for k in (2, 3, 4))
            docs.clear()
            order = np.argsort(bucket, kind="stable").astype(np.int32)
            cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            del bucket
            for b in np.flatnonzero(np.diff(cut)):
                o = order[cut[b] : cut[b + 1]]
                who, n = np.unique(number[o], return_counts=True)  # ascending, as they stand
                starts = at[o]
                yield int(b), part, 0, struct.pack("<II", len(o), len(who)) + heads[who].tobytes() + n.astype("<u4").tobytes() + h[o].astype("<u8").tobytes() + starts.astype("<u4" if starts.max() >> 16 else "<u2").tobytes()

        for batch in batches:
            for doc, th, text, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = (text or b"").split()
                at = _candidates(unsteps(hits, 0)[0], len(words))
                if len(at):
                    h = word_hashes(words)
                    docs.append((doc, th, at.astype(np.int32), rolling(h, WINDOW, MULTIPLIER)[at], _bucket(rolling(h, WINDOW, SECOND)[at], buckets).astype(np.uint16 if buckets < 1 << 16 else np.uint32)))
                    size += len(at)
                    if size >= CHUNK:
                        yield from _batches(flush())
                        size = 0
        if docs:
            yield from _batches(flush())
        common.released()

    return run


def _find_repeats(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """In each bucket: candidates whose hash also belongs to a smaller doc_id, packed for one of `parts` gatherers."""

    def read(rows: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, counts, hashes, starts = [], [], [], []
        for _, _, _, data in rows:
            n, k = struct.unpack_from("<II", data)
            i = 8
            keys.append(np.frombuffer(data, _KEY, k, i))
            i += _KEY.itemsize * k
            counts.append(np.frombuffer(data, "<u4", k, i).astype(np.int64))
            hashes.append(np.frombuffer(data, "<u8", n, i + 4 * k))
            starts.append(np.frombuffer(data, "<u2" if len(data) == i + 4 * k + 10 * n else "<u4", n, i + 4 * k + 8 * n).astype(np.uint32))
        return np.concatenate(keys), np.concatenate(counts), np.concatenate(hashes), np.concatenate(starts)

    def repeats(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        key, n, h, at = read(rows)
        rows.clear()
        rank = np.unique(key["doc"], return_inverse=True)[1].astype(np.int32) + np.int32(1)
        rank[key["null"]] = 0  # no doc_id comes before all
        rank = np.repeat(rank, n)
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(new, len(h)))
        del h
        rank = rank[order]
        repeat = np.zeros(len(rank), bool)
        repeat[order] = rank > np.repeat(np.minimum.reduceat(rank, new), times)
        del rank, order, new, times
        own = np.flatnonzero(repeat)
        cut = np.searchsorted(own, np.concatenate([[0], np.cumsum(n)]))
        out: dict[int, list[bytes]] = {}
        for i in np.flatnonzero(np.diff(cut)).tolist():
            a, b = int(cut[i]), int(cut[i + 1])
            x = key[i].tobytes() + struct.pack("<I", b - a) + at[own[a:b]].tobytes()
            out.setdefault((int(key[i]["doc"]) * 31 + int(key[i]["th"])) % parts, []).append(x)
        for to in list(out):
            yield to, 0, 0, b"".join(out.pop(to))

    for _, rows in _grouped(batches, "bucket"):
        yield from _batches(repeats(rows))
    common.released()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's repeats in one row: doc_id, th, starts. Documents without a doc_id have none."""
    head = _KEY.itemsize
    for _, rows in _grouped(batches, "bucket"):
        found: dict[bytes, list[bytes]] = {}
        for _, _, _, data in rows:
            i = 0
            while i < len(data):
                n = struct.unpack_from("<I", data, i + head)[0]
                at = i + head + 4
                found.setdefault(data[i : i + head], []).append(data[at : at + 4 * n])
                i = at + 4 * n
        items = list(found.items())
        for i in range(0, len(items), 1024):
            part = items[i : i + 1024]
            keys = np.frombuffer(b"".join(k for k, _ in part), _KEY)
            columns = [pa.array(keys["doc"].copy()), pa.array(keys["th"].copy()), pa.array([b"".join(x) for _, x in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "starts"])
    common.released()


def covered(starts: np.ndarray, n_words: int) -> np.ndarray:
    mark = np.zeros(n_words + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + WINDOW, -1)
    return np.cumsum(mark)[:n_words] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, n_removed, sha, kept of documents with repeats."""
    for batch in batches:
        rows = []
        for doc, th, text, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
            words = (text or b"").split()
            gone = covered(np.unique(np.frombuffer(starts, "<u4").astype(np.int64)), len(words))
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            rows.append((doc, th, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "th", "n_removed", "sha", "kept"])
    common.released()


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Which words of docs(doc_id, text, ...) lie in 13 consecutive words that also start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), and with_text the kept words of
    documents that lost some (else null). Rows with equal doc_id are one document's: they do not make each other repeats;
    null doc_ids are smaller than all. Null and empty texts have no words. Repeats within one document alone stay. Every
    row gets a row; other columns are ignored. An empty table gives no rows. Words are compared by 64 bits of a hash and
    the bucket they fall in by another. Hits are named by their place in a task's input, so that a task run again must
    read the same rows in the same order: docs should be a table as read from files, as written() gives.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    n = common.spread(spark)
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(4 * n, chars // BUCKET)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    probes = rows.select("doc_id", "th", "text").mapInArrow(_probe_chunks(buckets), _PACKED)
    hits = probes.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_find_hits, _PACKED)
    schema = "doc_id long, th long, n_words long, sha string, hits binary"
    table = common.written(hits.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_by_document, schema), "substring-documents")
    common.settle(spark)
    marked = table.where("hits is not null").dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "hits")
    texts = rows.alias("a").join(marked.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")))
    texts = common.written(texts.select("a.doc_id", "a.th", "a.text", "b.hits"), "substring-texts")
    common.settle(spark)
    candidates = texts.select("doc_id", "th", "text", "hits").mapInArrow(_candidate_chunks(max(1, n // 2, buckets // 8)), _PACKED)
    repeats = candidates.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _find_repeats(b, n), _PACKED)
    starts = repeats.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gather, "doc_id long, th long, starts binary")
    starts = common.written(starts, "substring-starts")
    common.settle(spark)
    cut = texts.alias("a").join(starts.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")))
    cut = cut.select("a.doc_id", "a.th", "a.text", "b.starts").mapInArrow(_cut, "doc_id long, th long, n_removed long, sha string, kept string")
    cut = common.written((cut if with_text else cut.drop("kept")).dropDuplicates(["doc_id", "th"]), "substring-cut")
    common.dropped(texts, starts)
    common.settle(spark)
    out = table.alias("a").join(cut.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left")
    columns = ["a.doc_id", "a.n_words", F.coalesce("b.n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("b.sha", "a.sha").alias("kept_sha256")]
    return out.select(*columns, *(["b.kept"] if with_text else []))
