"""A Jaccard join on word n-grams by a MinHash LSH forest with exact verification.

1. Documents with one set of n-grams are one class; a class is one node of all that follows, weighted by its documents.
2. Each tree of the forest is a trie of labels, DEPTH minhashes long, sorted. The shortest prefix that is matched at all
   is the longest at which pairs at the threshold meet in some tree with the target probability; nodes under one such
   prefix are a subtrie and candidates of each other.
3. In a subtrie of up to NEAR nodes all candidates are estimated, by four bits of each minhash. In a larger one matched
   prefixes are shortened from DEPTH on: a node hangs on the leader under its longest prefix that has one like it, and
   only nodes that found none go on to shorter prefixes; the leaders that are left are compared with each other. Only a
   spanning forest leaves the task: members with their leader, and leaders if members of theirs could be similar at all.
4. Components of candidates hold every pair that met. Exact similarities are computed inside them, between blocks of
   bounded size; a component over one block is compared block by block. Links are counted there, not emitted; again only
   spanning edges leave, whose components are the classes of the result.

Estimates have a standard error of at most 0.045. A pair at 0.8 is kept at 0.6 (five errors). A member is at least 0.9
like its leader by estimate, so 0.79 in truth (four errors); a linked pair's leaders are then at least 0.38 alike by the
triangle inequality of the Jaccard distance, and are kept at 0.2 (four errors).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import common, graph
from plait.llm.substrings import MULTIPLIER, rolling, word_hashes

TREES, DEPTH, TARGET = 16, 8, 0.9995
SKETCH = TREES * DEPTH  # minhashes of which four bits are compared within a prefix
NEAR, MARGIN, ALIKE, LOOSE = 512, 0.2, 0.9, 0.2  # nodes compared one with another; below the threshold; a member's and another leader's least estimate
BLOCK_NODES, BLOCK_GRAMS = 512, 1 << 20
_ODD = (np.random.RandomState(20).randint(0, 1 << 62, TREES * DEPTH, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def prefix_depth(threshold: float, target: float = TARGET) -> int:
    """How far prefixes are shortened: the longest with which pairs at the threshold meet in some tree with the target probability."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < target:
        depth -= 1
    return depth


def grams(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; a text of fewer words is one run."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(rolling(h, min(n, len(h)), MULTIPLIER) + np.uint64(n - min(n, len(h))))


def signature(g: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhashes of 32 bits."""
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(g), 4096):
        out = np.minimum(out, ((g[i : i + 4096, None] * _ODD) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sizes, labels, sketches = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                g = grams(text, n)
                s = signature(g)
                keys.append(xxhash.xxh3_128_digest(g.tobytes()))
                sizes.append(len(g))
                labels.append(s.astype(">u4").tobytes())
                low = (s[:SKETCH] & 15).astype(np.uint8)
                sketches.append((low[::2] << 4 | low[1::2]).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "n_grams", "label", "sketch"])

    return run


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of rows of a with rows of b, corrected for equal bits by chance."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 18) // max(1, len(b)))  # 16 MB at once
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] == b[None, :, :]).sum(axis=2)
    return (out / SKETCH - 1 / 16) / (15 / 16)


def _forest(linked: np.ndarray) -> np.ndarray:
    """Each row's first row of its component in a symmetric matrix of links."""
    root, n = np.full(len(linked), -1), len(linked)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            queue = [i]
            while queue:
                new = np.flatnonzero(linked[queue.pop()] & (root < 0))
                root[new] = i
                queue += new.tolist()
    return root


def _descend(sketch: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hangs rows on leaders under the longest prefix they share with one like them. Returns the rest, and the edges.

    deep: the minhashes of each row beyond the subtrie's prefix; rows are sorted by them. A row that leads others stays.
    """
    n, edges = len(sketch), []
    leads, free = np.zeros(n, bool), np.arange(n)
    for depth in range(deep.shape[1], 0, -1):
        prefix = deep[free, :depth]
        start = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)]))
        size = np.diff(np.append(start, len(free)))
        first = np.minimum.reduceat(np.where(leads[free], free, free + n), start) % n  # a leader, else the first row
        leader = np.repeat(first, size)
        asked = np.flatnonzero((leader != free) & ~leads[free])
        like = np.empty(len(asked))
        for i in range(0, len(asked), 1 << 14):
            part = asked[i : i + (1 << 14)]
            like[i : i + (1 << 14)] = (sketch[free[part]] == sketch[leader[part]]).mean(axis=1)
        found = asked[(like - 1 / 16) / (15 / 16) >= ALIKE]
        edges += zip(free[found].tolist(), leader[found].tolist())
        leads[leader[found]] = True
        free = np.delete(free, found)
    return free, edges


def _spanning(sketch: np.ndarray, deep: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that connect every pair of rows whose similarity may reach the threshold."""
    if len(sketch) == 2:
        return [(0, 1)] if _estimates(sketch[:1], sketch[1:])[0, 0] >= threshold - MARGIN else []
    if len(sketch) <= NEAR:
        root = _forest(_estimates(sketch, sketch) >= threshold - MARGIN)
        return [(i, int(r)) for i, r in enumerate(root) if i != r]
    rest, edges = _descend(sketch, deep)
    joined = {i: i for i in rest.tolist()}

    def top(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    for at in range(0, len(rest), NEAR):
        rows = rest[at : at + NEAR]
        for i, own in zip(rows.tolist(), _estimates(sketch[rows], sketch[rest[: at + NEAR]])):
            for j in rest[: at + NEAR][own >= LOOSE].tolist():
                a, b = top(i), top(j)
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    edges.append((i, j))
    return edges


def _candidates(threshold: float):
    """Spanning edges of each prefix's nodes, from rows sorted by prefix and label."""

    def edges(rows: list[pa.RecordBatch], first: int, last: int) -> list[tuple[bytes, bytes]]:
        t = pa.Table.from_batches(rows).slice(first, last - first)
        nodes = t.column("node").to_pylist()
        packed = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), SKETCH // 2)
        deep = np.frombuffer(b"".join(t.column("deep").to_pylist()), ">u4").reshape(len(nodes), -1)
        return [(nodes[i], nodes[j]) for i, j in _spanning(np.concatenate([packed >> 4, packed & 15], axis=1), deep, threshold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the prefix that is not over yet

        def out(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column("prefix").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(prefix)]
            found = []
            if held and held[-1].column("prefix")[-1].as_py() != prefix[0]:
                n = sum(b.num_rows for b in held)
                found += edges(held, 0, n) if n > 1 else []
                held = []
            if len(cut) > 2:
                if held:
                    held.append(batch.slice(0, cut[1]))
                    found += edges(held, 0, sum(b.num_rows for b in held))
                    held = []
                    cut = cut[1:]
                for a, b in zip(cut[:-2], cut[1:-1]):
                    if b - a > 1:
                        found += edges([batch], a, b)
            held.append(batch.slice(cut[-2], cut[-1] - cut[-2]))
            if found:
                yield out(found)
        n = sum(b.num_rows for b in held)
        if n > 1:
            yield out(edges(held, 0, n))

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    n = len(sets)
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, group, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.int64)
    often = count > max(8, n // 16)
    number = np.cumsum(often) - 1
    use = np.flatnonzero(often[group])
    column, row = number[group[use]], who[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for at in range(0, int(often.sum()), 1024):  # elements of many sets: matrix products
        a, b = np.searchsorted(column, (at, at + 1024))
        m = np.zeros((n, 1024), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += (m @ m.T).astype(np.int64)
    use = np.flatnonzero(~often[group] & (count[group] > 1))
    order = use[np.argsort(group[use], kind="stable")]
    sizes = count[group[order]]
    for c in np.unique(sizes):  # elements of few sets: their pairs
        sets_of = who[order[sizes == c]].reshape(-1, int(c))
        for part in range(0, len(sets_of), max(1, (1 << 20) // int(c) ** 2)):
            p = sets_of[part : part + max(1, (1 << 20) // int(c) ** 2)]
            out += np.bincount((p[:, :, None] * n + p[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _verify(threshold: float):
    """Links and spanning edges of each pair of blocks, from rows sorted by (root, i, j)."""
    names = ["u", "v", "links"]

    def compare(rows: list[tuple]) -> list[tuple[bytes, bytes | None, int]]:
        rows = [r for r, before in zip(rows, [None, *rows]) if before is None or r[4] != before[4]]
        if len(rows) < 2:
            return []
        _, i, j, _, _, _, _ = rows[0]
        block = np.array([r[3] for r in rows])
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        weight = np.array([r[5] for r in rows])
        size = np.array([len(s) for s in sets])
        shared = common_counts(sets)
        linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        root = _forest(linked)
        nodes = [r[4] for r in rows]
        links = linked @ weight
        return [(nodes[k], nodes[root[k]] if root[k] != k else None, int(links[k])) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[bytes, bytes | None, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.binary(), pa.binary(), pa.int64()))], names)

        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    found += compare(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            if found:
                yield out(found)
        if len(held) > 1:
            found = compare(held)
            if found:
                yield out(found)
        common.released()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # repeated rows of a node's document lie side by side after the join: one is enough
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            batch = batch.filter(pa.array([a != b for a, b in zip(nodes, [last, *nodes])]))
            last = nodes[-1] if nodes else last
            sets = pa.array([grams(t, n).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "block", "blocks", "node", "weight")), sets], ["root", "block", "blocks", "node", "weight", "grams"])

    return run


def classes(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, th, root, class_id, n_links of docs(doc_id, text, ...), th being the hash of the text, root the class as bytes.

    Documents link if the Jaccard similarity of their sets of n-word runs is at least the threshold; a text of 1 to n - 1
    words is one run, and texts without words, null ones included, equal each other alone. n_links counts a document's
    links to others, copies included; class_id is the smallest doc_id (null if all are null) of those that links lead to,
    and its own for a document without links. Every row gets a row; repeated rows are copies. Other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    parts = common.spread(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    described = common.written(rows.mapInArrow(_describe(n), "doc_id long, th long, node binary, n_grams long, label binary, sketch binary"), "jaccard-described")
    nodes = described.groupBy("node").agg(F.count("*").alias("weight"), F.max("n_grams").alias("n_grams"), F.min(F.struct("doc_id", "th")).alias("head"), F.min("doc_id").alias("least"), F.first("label").alias("label"), F.first("sketch").alias("sketch"))
    nodes = common.written(nodes, "jaccard-nodes")
    common.settle(spark)
    depth = prefix_depth(threshold)
    label = lambda t, k: F.substring("label", t * DEPTH * 4 + 1, k * 4)
    rest = lambda t: F.substring("label", (t * DEPTH + depth) * 4 + 1, (DEPTH - depth) * 4)
    trees = F.explode(F.array(*(F.struct(F.xxhash64(F.lit(t), label(t, depth)).alias("prefix"), rest(t).alias("deep")) for t in range(TREES))))
    forest = nodes.where("n_grams > 0").select("node", "sketch", trees.alias("t")).select("node", "sketch", "t.prefix", "t.deep")
    forest = forest.repartition(parts, "prefix").sortWithinPartitions("prefix", "deep").select("node", "sketch", "prefix", "deep")
    candidates = common.written(forest.mapInArrow(_candidates(threshold), "u binary, v binary"), "jaccard-candidates")
    common.settle(spark)
    roots = graph.components(candidates, "jaccard-roots")
    common.dropped(candidates)
    member = common.written(nodes.select("node", "weight", "n_grams", "head").join(roots, "node"), "jaccard-members")
    size = member.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    size = common.written(size.select(F.col("root").alias("r"), blocks.alias("blocks")), "jaccard-sizes")
    placed = member.join(size, F.col("root") == F.col("r")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    heads = placed.select("root", "block", "blocks", "node", "weight", F.col("head.doc_id").alias("d"), F.col("head.th").alias("h"))
    texts = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    sets = texts.select("root", "block", "blocks", "node", "weight", "text").mapInArrow(_sets(n), "root binary, block int, blocks int, node binary, weight long, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    pairs = sets.select("*", other).select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "weight", "grams")
    pairs = pairs.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    links = common.written(pairs.mapInArrow(_verify(threshold), "u binary, v binary, links long"), "jaccard-links")
    common.settle(spark)
    roots = graph.components(links.where("v is not null").select("u", "v"), "jaccard-classes")
    found = links.groupBy("u").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "weight", "least").join(roots, "node", "left").join(found, F.col("node") == F.col("u"), "left")
    known = common.written(known.select("node", "weight", "least", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "jaccard-known")
    least = common.written(known.groupBy("root").agg(F.min("least").alias("class_id")).select(F.col("root").alias("r"), "class_id"), "jaccard-least")
    known = known.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "root", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = common.written(described.select("doc_id", "th", "node").join(known, F.col("node") == F.col("k")).select("doc_id", "th", "root", "class_id", "n_links"), "jaccard-result")
    common.dropped(described, nodes, member, size, links, least)
    return out


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class of near duplicates: the one with the smallest (doc_id, hash of the text).

    All columns are kept; of rows equal in doc_id and text one stays.
    """
    found = classes(docs, n, threshold)
    heads = found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("h")).select(F.col("h.doc_id").alias("__doc"), F.col("h.th").alias("__hash"))
    heads = common.written(heads, "jaccard-heads")
    common.dropped(found)
    common.settle(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    rows = rows.join(heads, rows.doc_id.eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__hash")))
    return rows.dropDuplicates(["doc_id", "th"]).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
