"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > j | x) = 1 / (1 + exp(t_j - w.x)), with one weight vector for all ordered thresholds t_0 < t_1. The result
is the expected grade. Features are the distinct lower-case words of a text and their beginnings, those that stand out
in the toxic rows of a sample. They are counted on the cluster; the driver gets the sample's telling features only, as
a sparse matrix, which bounds it by SAMPLE rows whatever the length of their texts.

Where labels have a column grade (0 to 2) that is the grade. Binary labels only say 0 or more: among toxic rows those with
at least the median number of telling features, and more than one, get 2, others 1, and what is telling for a row is found
in the other half of the sample, so that no row's grade comes from features that it helped to select.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import common

#: Labelled rows for training, the one bound: half toxic, half not, those with the smallest hashes of their ids. Rows are
#: weighted so that both halves count as they do among all labels.
SAMPLE = 8000
GRADES, RARE, TELLING, STEPS, PENALTY = 3, 6, 6.0, 400, 1e-4
BEGINNINGS = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+").findall


def features(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings, as languages that inflect or compound vary the rest."""
    found = set(_WORD(text.lower()))
    return found.union(*({f"{w[:n]}-" for w in found if len(w) > n} for n in BEGINNINGS))


class Sparse:
    """A matrix of zeros and ones by the row and column of each one."""

    def __init__(self, held: list[list[int]], width: int):
        self.shape = (len(held), width)
        self.row = np.repeat(np.arange(len(held)), [len(r) for r in held])
        self.column = np.array([c for r in held for c in r], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def transposed_times(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, z[self.row], self.shape[1])


def thresholds(gaps: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first of them and the logarithms of the steps between them."""
    return np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def likelihood(p: np.ndarray, x: Sparse, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The penalised mean log likelihood of weights and threshold parameters, and its gradient."""
    d, n, k = x.shape[1], x.shape[0], GRADES - 1
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    t, z, every = thresholds(p[d:]), x.times(p[:d]), np.arange(n)
    above = np.concatenate([np.ones((n, 1)), sig(z[:, None] - t), np.zeros((n, 1))], axis=1)  # P(grade >= j)
    like = np.maximum(above[every, grade] - above[every, grade + 1], 1e-12)
    slope = above * (1 - above)
    dz = weight * (slope[every, grade] - slope[every, grade + 1]) / like
    dt = np.array([((grade == j).astype(float) - (grade == j + 1)) * slope[:, j + 1] @ (weight / like) for j in range(k)])
    steps = [np.exp(p[d + 1 + j]) * dt[j + 1 :].sum() for j in range(k - 1)]
    total = weight.sum()
    gradient = np.concatenate([x.transposed_times(dz) / total - PENALTY * p[:d], [dt.sum() / total], np.array(steps) / total])
    return float((weight * np.log(like)).sum() / total - PENALTY / 2 * (p[:d] ** 2).sum()), gradient


def fit(x: Sparse, grade: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the likelihood."""
    weight = np.ones(len(grade)) if weight is None else weight
    d, share = x.shape[1], min(max(float(weight[grade > 0].sum() / weight.sum()), 1e-4), 1 - 1e-4)
    p = np.concatenate([np.zeros(d), [-np.log(share / (1 - share))], np.full(GRADES - 2, 0.5)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        g = likelihood(p, x, grade, weight)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:d], thresholds(p[d:])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, given, weight, half of at most SAMPLE labelled rows, one for each doc_id; its ids are bounded, so they are broadcast."""
    given = F.max("grade") if "grade" in labels.columns else F.lit(None)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.max(F.col("toxic").cast("int")) > 0).alias("toxic"), given.cast("int").alias("given"))
    inside = F.when(F.col("given").isNotNull(), F.greatest(F.least("given", F.lit(GRADES - 1)), F.lit(0)))
    known = known.select("doc_id", F.coalesce(F.col("given") > 0, "toxic").alias("toxic"), inside.alias("given"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    each = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 2).withColumn("weight", F.lit(count.get(t, 0) / max(1, min(SAMPLE // 2, count.get(t, 0))))) for t in (True, False)]
    chosen = common.written(each[0].unionByName(each[1]), "toxicity-labels")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "given", "weight").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    return common.written(texts.select("doc_id", "text", "toxic", "given", "weight", half.alias("half")), "toxicity-sample")


def telling(rows: DataFrame) -> list[str]:
    """Features found in toxic rows more often than chance allows, by the normal score of their count."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = pa.array(features(text), pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array([int(toxic)] * len(found), pa.int32())], ["feature", "toxic"])

    n, bad = rows.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not bad or bad == n:
        return []
    share = bad / n
    counts = rows.select("text", "toxic").mapInArrow(each, "feature string, toxic int").groupBy("feature").agg(F.count("*").alias("held"), F.sum("toxic").alias("bad"))
    score = (F.col("bad") - F.col("held") * share) / F.sqrt(F.col("held") * (share * (1 - share)))
    return sorted(r["feature"] for r in counts.where((F.col("held") >= RARE) & (score >= TELLING)).select("feature").collect())


def grades(toxic: np.ndarray, given: list[int | None], half: np.ndarray, telling_features: np.ndarray) -> np.ndarray:
    """The grade of each row: as given, else by its number of features that the other half finds telling."""
    n, out = telling_features, toxic.astype(int)
    for h in (0, 1):
        own = toxic & (half == h)
        if own.any():
            out[own & (n >= np.median(n[own])) & (n > 1)] = 2
    return np.array([o if g is None else g for o, g in zip(out.tolist(), given)], int)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Weights by feature, and thresholds. Without labels of both kinds nothing is toxic."""
    rows = sample(docs, labels)
    names = telling(rows)
    if not names:
        return {}, np.full(GRADES - 1, 20.0)
    at, other = {w: i for i, w in enumerate(names)}, [set(telling(rows.where(F.col("half") == 1 - h))) for h in (0, 1)]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            found = pa.array([sorted(at[w] for w in f & at.keys()) for f in made], pa.list_(pa.int32()))
            n = pa.array([len(f & other[h]) for f, h in zip(made, batch.column(5).to_pylist())], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, n, *(batch.column(i) for i in (2, 3, 4, 5))], ["doc_id", "held", "n", "toxic", "given", "weight", "half"])

    found = sorted(rows.mapInArrow(held, "doc_id long, held array<int>, n int, toxic boolean, given int, weight double, half int").collect(), key=lambda r: r["doc_id"])
    common.dropped(rows)
    column = lambda c: np.array([r[c] for r in found])
    grade = grades(column("toxic"), [r["given"] for r in found], column("half"), column("n"))
    w, t = fit(Sparse([r["held"] for r in found], len(names)), grade, column("weight"))
    return dict(zip(names, w.tolist())), t


def score(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2), p_toxic, grade (the likeliest), toxic (p_toxic >= limit).

    Trains on a sample of labels(doc_id, toxic[, grade]) joined with docs(doc_id, text, ...) of at most SAMPLE
    rows, then scores every whole text. Null and empty texts have no features and get the severity that the thresholds
    alone give. Labels with null ids or labels are left out; repeated ones count once, as toxic if one is. Every row gets
    a row, equal texts alike; other columns are ignored. An empty table gives no rows.
    """
    common.arrow_batches(docs.sparkSession)
    weights, t = train(docs, labels)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for b in batches:
            z = np.array([sum(weights[w] for w in sorted(known & features(x or ""))) for x in b.column(1).to_pylist()], dtype=float)
            above = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -40, 40)))
            p = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
            columns = [b.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(one, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
