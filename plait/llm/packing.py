"""Best-fit packing of documents into sequences by linear grouping.

Lengths are integers up to the capacity, so the whole plan is made on the driver from a histogram of at most
`capacity` rows, whatever the size of the corpus:

1. Large lengths are sorted and cut into groups of equal cardinality; within a group all round up to the longest.
2. Configurations of the few rounded sizes are optimised by column generation (a knapsack for each new one).
3. Whole multiples of configurations get the groups' actual documents, but for the shortest place of each: rounding
   up left room that depends on the documents, so that place goes to what fits it best.
4. What is left, large or small, goes by best fit, longest first, into the space left over, then new sequences.

The plan is run-length coded: sequences of equal content form a class, so its size is bounded by the number of
lengths and configurations. Each piece finds its place by its rank among pieces of its length; ranks come from
counts of (length, bucket) and a window within each, so a length that a third of all pieces share is split.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm import common, tokens

GROUPS, LARGE = 32, 8  # groups of equal cardinality; lengths over capacity / LARGE are large
REPACK = (0.99, 0.98, 0.995)  # shares of the capacity under which a sequence is packed anew
Class = tuple[int, list[tuple[int, int]]]  # how many sequences; (length, copies) in order


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: which sizes are worth most within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    layers = []
    for _ in range(capacity // int(sizes.min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (s, y) in enumerate(zip(sizes, worth)):
            if y > 1e-12:
                gain = best[: capacity + 1 - s] + y
                at = gain > new[s:] + 1e-12
                new[s:][at] = gain[at]
                pick[s:][at] = g
        layers.append(pick)
        if np.array_equal(new, best):
            break
        best = new
    counts, c = np.zeros(len(sizes), dtype=np.int64), int(np.argmax(best))
    for pick in reversed(layers):
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(worth @ counts), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with how often each is used, whole times: the linear relaxation by column generation, rounded down."""
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(40 * len(s)):
        worth = np.linalg.solve(basis.T, np.ones(len(s)))
        value, new = _best_configuration(s, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        x, step = np.linalg.solve(basis, d), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = new
    x = np.linalg.solve(basis, d)
    return [(basis[:, i].astype(np.int64), int(x[i] + 1e-6)) for i in range(len(s)) if x[i] >= 1 - 1e-6]


def best_fit(classes: list[Class], items: list[tuple[int, int]], capacity: int) -> list[Class]:
    """Puts (length, count) items, longest first, each into the fullest sequence that has room, else a new one."""
    room: dict[int, list[Class]] = {}
    for n, held in classes:
        room.setdefault(capacity - sum(a * k for a, k in held), []).append((n, held))
    keys = sorted(room)

    def put(r: int, c: Class) -> None:
        if r not in room:
            room[r] = []
            insort(keys, r)
        room[r].append(c)

    for size, left in sorted(items, reverse=True):
        while left:
            i = bisect_left(keys, size)
            if i == len(keys):
                put(capacity, (-(-left // (capacity // size)), []))
                continue
            r = keys[i]
            n, held = room[r].pop()
            if not room[r]:
                del room[r], keys[i]
            k = r // size
            full = min(n, left // k)
            if full:
                put(r - k * size, (full, [*held, (size, k)]))
                left -= full * k
                n -= full
            if n and left:  # fewer than k: one sequence takes them all
                put(r - left * size, (1, [*held, (size, left)]))
                left, n = 0, n - 1
            if n:
                put(r, (n, held))
    return [c for cs in room.values() for c in cs]


def plan(histogram: dict[int, int], capacity: int) -> list[Class]:
    """Classes of sequences that hold every piece of the histogram (length: count)."""
    full = [(histogram[capacity], [(capacity, 1)])] if histogram.get(capacity) else []
    large = sorted(((a, n) for a, n in histogram.items() if capacity // LARGE < a < capacity and n), reverse=True)
    small = [(a, n) for a, n in histogram.items() if 0 < a <= capacity // LARGE and n]
    total = sum(n for _, n in large)
    if not total:
        return full + best_fit([], small, capacity)
    groups: list[list[list[int]]] = []
    k = min(GROUPS, total)
    taken = 0
    for a, n in large:
        while n:
            end = total * len(groups) // k if groups else 0
            if taken == end and len(groups) < k:
                groups.append([])
                continue
            end = total * len(groups) // k
            m = min(n, end - taken)
            groups[-1].append([a, m])
            n, taken = n - m, taken + m
    sizes, demand = [g[0][0] for g in groups], [sum(n for _, n in g) for g in groups]
    merged: dict[int, int] = {}
    for s, n in zip(sizes, demand):
        merged[s] = merged.get(s, 0) + n
    queues: dict[int, list[list[int]]] = {s: [] for s in merged}
    for s, g in zip(sizes, groups):
        queues[s] += g
    distinct = sorted(merged, reverse=True)
    classes: list[Class] = []
    for use, times in configurations(distinct, [merged[s] for s in distinct], capacity):
        slots = [s for s, c in zip(distinct, use) for _ in range(c)]
        slots = slots[:-1] if len(slots) > 1 else slots  # the shortest is chosen below, by what the real lengths leave
        while times:
            step, held = times, {}
            for s in set(slots):  # as many sequences as the heads of the queues serve alike
                c = slots.count(s)
                queues[s] = [q for q in queues[s] if q[1]]
                head = queues[s][0]
                step = min(step, head[1] // c) if head[1] >= c else 0
                if not step:
                    break
            if step:
                for s in set(slots):
                    c = slots.count(s)
                    held[queues[s][0][0]] = held.get(queues[s][0][0], 0) + c
                    queues[s][0][1] -= c * step
            else:
                step = 1
                for s in slots:  # one sequence across a boundary between two lengths
                    queues[s] = [q for q in queues[s] if q[1]]
                    held[queues[s][0][0]] = held.get(queues[s][0][0], 0) + 1
                    queues[s][0][1] -= 1
            classes.append((step, sorted(held.items(), reverse=True)))
            times -= step
    rest: dict[int, int] = dict(small)
    for q in queues.values():
        for a, n in q:
            if n:
                rest[a] = rest.get(a, 0) + n
    made = best_fit(classes, list(rest.items()), capacity)
    for share in REPACK:  # sequences that stayed emptier are packed anew; the better plan stands
        again: dict[int, int] = {}
        good = []
        for n, held in made:
            if sum(a * k for a, k in held) >= share * capacity:
                good.append((n, held))
            else:
                for a, k in held:
                    again[a] = again.get(a, 0) + n * k
        new = best_fit(good, list(again.items()), capacity)
        if sum(n for n, _ in new) < sum(n for n, _ in made):
            made = new
    return full + made


def places(classes: list[Class]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each sequence, offset), by length and rank."""
    rows, ranks, base = [], {}, 0
    for n, held in classes:
        at = 0
        for a, k in held:
            first = ranks.get(a, 0)
            rows.append((a, first, base, k, at))
            ranks[a] = first + n * k
            at += a * k
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """The pieces of each document: longer ones cut every `capacity` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, keeps_blanks=False)
        for batch in batches:
            ids, n = encoder.arrow(batch.column(1))
            raw = memoryview(np.insert(ids, np.cumsum(n), end_id).astype("<u4", copy=False)).cast("B")
            n = n + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = (np.cumsum(n) - n)[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        common.released()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Packs docs(doc_id, text, ...) into sequences of at most `capacity` tokens, as few as it can.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. Each document's ids
    are the tokenizer's, then end_id. Null and empty texts hold end_id alone and are packed like others. Equal rows,
    a null doc_id and repeated ones keep one row for each piece; ties in rank are between interchangeable rows.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    pieces = common.written(tokenized_pieces(docs, capacity, tokenizer, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = places(plan(histogram, capacity))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * common.spread(spark))).cast("int"))
    before = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(own) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = at[:, 0] << 44 | at[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            j = rank - at[i, 1]
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at[i, 2] + j // at[i, 3]), pa.array(at[i, 4] + j % at[i, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, _PIECES + ", sequence_id long, offset long")
