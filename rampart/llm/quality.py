"""Quality score: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of other signs. Features are the hashes of single words and of pairs of
neighbours, once as written and once by shape (case, digits, length), so that words never seen still count. A feature's
value is its share of the document's words; the score is the logistic function of a sparse dot product.

Training takes a sample of the labelled rows: at most ``SAMPLE`` of them, those with the smallest hash of their id.
With no labelled row, or labels of one value only, all weights stay at zero but for the bias.

Null and empty texts are scored by the bias alone; very long texts are scored whole; rows that repeat a doc_id are
scored each by its own text, and one of them trains; of labels that repeat a doc_id, the smallest counts, and null labels
or ids don't. A score of exactly one half counts as label 1. An empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm import kernels as K

BITS, SAMPLE, SCALE = 18, 8000, 40.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.05, 0.1, 3

_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 other signs
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[128:] = 1
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one class, and each row's first run."""
    c = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = c[1:] != c[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    s, e = edges[:-1], edges[1:]
    some = c[s] != 0 if len(s) else np.empty(0, bool)
    s, e = s[some], e[some]
    return s, e, np.searchsorted(s, at)


def features(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of feature its index at every word (-1: none), and each row's first word."""
    s, e, first = tokens(data, at)
    if not len(s):
        return [], first
    raw = K.word_hashes(data, s, e)
    upper, digit = (np.concatenate([[0], np.cumsum((data >= a) & (data <= b))]) for a, b in ((65, 90), (48, 57)))
    n = e - s
    ups, digits = upper[e] - upper[s], digit[e] - digit[s]
    kind = _CLASS[data[s]].astype(np.int64)
    case = np.where(ups == 0, 0, np.where((ups == 1) & (upper[s + 1] > upper[s]), 1, 2))
    shape = np.where(kind == 1, 1 + case + 3 * (digits > 0) + 6 * np.minimum(n, 12), 0)
    shape = np.where(kind == 1, K.mix(shape.astype(K.U) + K.U(77)), raw)
    low = K.U((1 << BITS) - 1)
    out = []
    for k, h in enumerate((raw, shape)):
        out.append((K.mix(h + K.U(2 * k + 1)) & low).astype(np.int64))
        pair = np.full(len(h), -1, np.int64)
        pair[:-1] = (K.mix(h[:-1] * K.U(0x9FB21C651E98DF25) + h[1:] + K.U(2 * k + 2)) & low).astype(np.int64)
        if k:  # neighbours that are the same word have a shape of their own
            pair[:-1] = np.where(raw[1:] == raw[:-1], (1 << BITS) - 1, pair[:-1])
        last = first[1:][np.diff(first) > 0] - 1
        pair[last] = -1
        out.append(pair)
    return out, first


def _sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """order, label, features and values of each row."""
    for batch in batches:
        for r0, r1, data, at in K.chunks(batch.column(2)):
            found, first = features(data, at)
            rows = []
            for r in range(r1 - r0):
                a, b = first[r], first[r + 1]
                own = np.concatenate([f[a:b] for f in found]) if b > a else np.empty(0, np.int64)
                index, count = np.unique(own[own >= 0], return_counts=True)
                rows.append((index.astype(np.int32), (count * (SCALE / max(1, b - a))).astype(np.float32)))
            part = batch.slice(r0, r1 - r0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([y.tobytes() for _, y in rows], pa.binary())], names=["nth", "label", "index", "value"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights, the bias last, from (label, features, values) in the order given."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([size - 1])
    rows = [(y, np.concatenate([i, bias]), np.concatenate([x.astype(np.float64), [1.0]])) for y, i, x in rows]

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, i, x in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def _trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        for y, i, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            rows.append((y, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32)))
    yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows).tobytes()], pa.binary())], names=["weights"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); at most ``sample`` labels are used."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers are broadcast, and as many sparse rows train in one task.
    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("nth"), "label", "text")
    sparse = rows.mapInArrow(K.lean(_sparse), "nth bigint, label int, index binary, value binary")
    # Of rows that repeat an id, one trains: the smallest by its features.
    sparse = sparse.groupBy("nth").agg(F.min(F.struct("label", "index", "value")).alias("row")).select("nth", "row.*")
    one = sparse.repartition(1).sortWithinPartitions("nth", "index").mapInArrow(K.lean(_trained), "weights binary")
    made = one.collect()  # one row, or none without labels
    return np.frombuffer(made[0]["weights"], np.float32) if made else np.zeros((1 << BITS) + 1, np.float32)


def logits(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    found, first = features(data, at)
    n = np.diff(first)
    total = np.zeros(len(n))
    padded = np.append(weights[:-1], np.float32(0)).astype(np.float64)
    if found:
        each = sum(padded[f] for f in found)
        some = np.flatnonzero(n)
        total[some] = np.add.reduceat(each, first[some]) * (SCALE / n[some])  # each row by itself, whatever stands beside it
    return total + float(weights[-1])


def _scored(weights: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for r0, r1, data, at in K.chunks(batch.column(1)):
                scores[r0:r1] = 1 / (1 + np.exp(-np.clip(logits(data, at, weights), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return run


def score(df: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row. The weights have a fixed size of a megabyte."""
    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(K.lean(_scored(weights)), f"doc_id {kind}, score double")


def held_out() -> F.Column:
    """Whether a row is kept for testing: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labels of rows that are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    weights = fit(docs.select("doc_id", "text"), known, sample)
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
