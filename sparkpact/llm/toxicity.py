"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and their beginnings of 4 to 8 bytes, as log(1 + count). A bounded, hash-chosen sample of
labelled documents (``sample_rows``, half toxic and half not, weighted back to their true shares) selects the features by
their document counts and fits the model: P(grade > k) = sigmoid(w.x - t_k), with one weight vector for all ordered
thresholds t_0 < t_1 < ... . All documents are then scored; ``severity`` is the expected grade.

The labels table tells only toxic or not. Grades are 0 (not toxic), 1 (toxic) and 2 (toxic, with at least the median
weight of telling features among the sample's toxic documents).

Null and empty texts have no features and get the model's base severity; texts of any length are read whole; repeated rows
are scored alike; labels that are null, repeated or of unknown documents do no harm; without labels of both kinds all
severities are 0. Documents that share an id are one in the sample, by their smallest text. Empty tables give empty results;
further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts, texts_of
from .license_scan import words_of

BEGINNINGS = range(4, 9)


def features_of(word: bytes) -> list[bytes]:
    return [word, *(b"<" + word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass(frozen=True)
class OrdinalModel:
    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None, :])))


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, penalty: float = 2e-4, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the penalised negative log-likelihood. The thresholds are a first one
    plus positive steps, so they stay ordered."""
    n, d = x.shape
    weight = weight / weight.sum()
    share = np.clip([(weight * (grade > k)).sum() for k in range(grades - 1)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    p = np.concatenate((np.zeros(d), free))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, raw = p[:d], p[d:]
        t = np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))
        s = 1 / (1 + np.exp(-(np.asarray(x @ w.astype(x.dtype), float)[:, None] - t)))
        up = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)  # P(grade > k - 1)
        q = np.maximum(up[np.arange(n), grade] - up[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate((np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))), axis=1)
        by_score = -weight * (slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / q
        by_t = np.zeros((n, grades + 1))
        by_t[np.arange(n), grade] += weight / q * slope[np.arange(n), grade]
        by_t[np.arange(n), grade + 1] -= weight / q * slope[np.arange(n), grade + 1]
        gt = by_t[:, 1:-1].sum(0)
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate((np.asarray(by_score.astype(x.dtype) @ x, float) + penalty * w, [tail[0]], tail[1:] * np.exp(raw[1:])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = p[d:]
    return p[:d], np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))


def labelled_sample(labels: DataFrame, docs: DataFrame, id_col: str, label_col: str, rows: int) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """Up to rows/2 toxic and rows/2 other labelled documents as (id, text, y), the weight of either kind and its count."""
    y = (F.max(f"`{label_col}`") > 0).cast("int").alias("y")
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(y)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(rows // 2) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    weights = {k: max(1.0, n / (rows // 2)) for k, n in counts.items()}
    # at most ``rows`` pairs of two numbers; of rows that share an id the smallest text stands for all
    sample = docs.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return durable(sample.select("id", "text", "y")), weights, counts


def _counted(batches, features: dict[bytes, int] | None):
    for batch in batches:
        ids, ys = batch.column("id").to_pylist(), batch.column("y").to_pylist()
        texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
        if features is None:
            n: dict[bytes, list[int]] = {}
            for text, y in zip(texts, ys, strict=True):
                for f in {f for w in {*words_of(text)} for f in features_of(w)}:
                    n.setdefault(f, [0, 0])[y] += 1
            if n:
                yield pa.RecordBatch.from_pydict({"feature": pa.array([*n], pa.binary()), "n0": pa.array([v[0] for v in n.values()], pa.int64()), "n1": pa.array([v[1] for v in n.values()], pa.int64())})
        else:
            out = [_vector(Counter(words_of(t)), features) for t in texts]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "y": pa.array(ys, pa.int32()), "at": pa.array([[*v] for v in out], pa.list_(pa.int32())), "n": pa.array([[*v.values()] for v in out], pa.list_(pa.int32()))})


def _vector(words: Counter, features: dict[bytes, int]) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        for f in features_of(w):
            if (k := features.get(f)) is not None:
                out[k] += n
    return out


def fit(labels: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 6000, max_features: int = 1500, min_documents: int = 5) -> OrdinalModel:
    docs, nothing = texts_of(df, id_col, text_col), OrdinalModel({}, np.zeros(0), np.array([50.0, 51.0]))
    sample, weights, counts = labelled_sample(labels, docs, id_col, label_col, sample_rows)
    if len(weights) < 2:
        return nothing
    counted = sample.mapInArrow(lambda b: _counted(b, None), "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = (min(counts[k], sample_rows // 2) for k in (0, 1))
    odds = F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5)) - F.lit(float(np.log((n1 + 1) / (n0 + 1))))
    # log-odds against the sample's split, over its standard error; what could well be chance is no feature
    best = counted.where(F.col("n0") + F.col("n1") >= min_documents).withColumn("z", odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))
    rows = best.where(F.abs("z") >= 2).orderBy(F.abs("z").desc(), "feature").limit(max_features).select("feature", "z").collect()
    features = {bytes(r["feature"]): k for k, r in enumerate(rows)}
    if not features:
        return nothing
    vectors = sample.mapInArrow(lambda b: _counted(b, features), "id long, y int, at array<int>, n array<int>").collect()  # at most sample_rows
    vectors.sort(key=lambda r: r["id"])
    if len({r["y"] for r in vectors}) < 2:
        return nothing
    x = np.zeros((len(vectors), len(features)), np.float32)
    for i, r in enumerate(vectors):
        x[i, r["at"]] = np.log1p(r["n"])
    y = np.array([r["y"] for r in vectors])
    telling = x @ np.maximum([r["z"] for r in rows], 0).astype(np.float32)
    grade = y + (y & (telling >= np.median(telling[y == 1])))
    w, t = fit_cumulative_link(x, grade, np.array([weights[k] for k in y]), 3)
    return OrdinalModel(features, w, t)


def score_toxicity(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, toxic): the expected grade, the likeliest grade, and whether toxic is likelier than not."""
    features, weights = model.features, model.weights

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        own = [words_of(t) for t in texts]
        vocabulary = {w for words in own for w in words}
        known = {w: at for w in vocabulary if (at := [features[f] for f in features_of(w) if f in features])}
        score = np.zeros(len(texts))
        for i, words in enumerate(own):
            hits: Counter = Counter()
            for w in words:
                if w in known:
                    hits.update(known[w])
            if hits:
                score[i] = np.log1p([*hits.values()]) @ weights[[*hits]]
        above = model.above(score)
        each_grade = np.diff(np.concatenate((np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))), axis=1) * -1, axis=1)
        return {id_col: ids, "severity": pa.array(above.sum(1)), "grade": pa.array(each_grade.argmax(1).astype(np.int32)), "toxic": pa.array(above[:, 0] >= 0.5)}

    return map_texts(texts_of(df, id_col, text_col), f"`{id_col}` long, severity double, grade int, toxic boolean", each)
