"""Removal of word passages that an earlier document has, by seed and extend.

A passage is ``length`` consecutive words. Words are maximal runs of signs other than ASCII white space.

1. Seeds: the smallest hash of ``seed`` consecutive words in each passage (winnowing). Equal passages choose equal
   seeds, so documents are joined on seeds and nothing else, some 2 in 36 words.
2. Extend: around a seed, the run of passages that chose it is extended both ways to the run's full stretch of words,
   its *context*. Members of a seed with equal contexts have equal passages: only the smallest doc_id of each context
   matters, the others lose the whole stretch. A seed with one context is settled by that.
3. Maximal repeats: where a seed has several contexts, the passages of one document for each context are compared
   by 128-bit hashes with those of the others; adjacent hits merge into the longest repeats.

No step forms pairs of documents; a passage in thousands of documents costs one row for each of them.

Judged on the input: a passage that an earlier document has is removed even where that document loses it itself.
Documents that are null, empty or shorter than ``length`` lose nothing, nor do those with a null doc_id, which also
remove nothing from others. Rows that repeat a doc_id are judged each by itself and never by one another. Very long
texts are handled whole. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm import kernels as K
from rampart.llm import storage

LENGTH, SEED = 50, 16


def _argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each window of ``width``, by doubling."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


def _passages(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> tuple | None:
    """Of the rows of a chunk: first words, the starts of all passages, and the place of the seed that each chose."""
    s, e, first = K.words(data, at)
    if len(s) < length:
        return None
    a, b = (K.prefix_hash(K.word_hashes(data, s, e, w), w) for w in (0, 1))
    place = np.arange(len(s) - seed + 1)
    seeds = K.span_hash(a, place, place + seed)
    chosen = _argmin(seeds, length - seed + 1)  # by start of passage
    row = K.row_of(first)
    start = np.arange(len(chosen))
    start = start[first[row[start] + 1] - start >= length]
    return a, b, seeds, chosen, row, first, start


def _runs(chosen: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last passage of each run that chose one seed in one row, and the seed's place."""
    c = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (c[1:] != c[:-1]) | (row[start][1:] != row[start][:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(start)) - 1
    return start[lo], start[hi], c[lo]


_SEEDS = "seed bigint, c1 bigint, c2 bigint, doc_id bigint, row bigint, lo int, hi int"


def _seed(length: int, seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for r0, _, data, at in K.chunks(batch.column(1)):
                if not (found := _passages(data, at, length, seed)):
                    continue
                a, b, seeds, chosen, row, first, start = found
                if not len(start):
                    continue
                lo, hi, place = _runs(chosen, row, start)
                base = first[row[lo]]
                shape = K.mix((place - lo).astype(K.U) * K.U(1 << 32) + (hi - lo).astype(K.U))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(K.signed(seeds[place])),
                        pa.array(K.signed(K.span_hash(a, lo, hi + length) ^ shape)),
                        pa.array(K.signed(K.span_hash(b, lo, hi + length, 1) + shape)),
                        pa.array(doc[r0 + row[lo]].astype(np.int64)),
                        pa.array(key[r0 + row[lo]].astype(np.int64)),
                        pa.array((lo - base).astype(np.int32)),
                        pa.array((hi - base).astype(np.int32)),
                    ],
                    names=["seed", "c1", "c2", "doc_id", "row", "lo", "hi"],
                )

    return run


_PASSAGES = "w1 bigint, w2 bigint, doc_id bigint, row bigint, at int"


def _extend(length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the passages that need comparison, for the rows that have any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            doc, key, open_ = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for r0, r1, data, at in K.chunks(batch.column(1)):
                s, e, first = K.words(data, at)
                a, b = (K.prefix_hash(K.word_hashes(data, s, e, w), w) for w in (0, 1))
                places = [np.unique(np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in open_[r]])) for r in range(r0, r1)]
                n = [len(p) for p in places]
                own = np.concatenate(places) if places else np.empty(0, np.int64)
                p = own + np.repeat(first[:-1], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(K.signed(K.span_hash(a, p, p + length))),
                        pa.array(K.signed(K.span_hash(b, p, p + length, 1))),
                        pa.array(np.repeat(np.array(doc[r0:r1], np.int64), n)),
                        pa.array(np.repeat(np.array(key[r0:r1], np.int64), n)),
                        pa.array(own.astype(np.int32)),
                    ],
                    names=["w1", "w2", "doc_id", "row", "at"],
                )

    return run


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Runs of passages to remove: ``doc_id, row, gone`` (array of first and last passage start, in words)."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    seeds = storage.materialize(known.mapInArrow(K.lean(_seed(length, seed)), _SEEDS), "seeds")
    shared = (
        seeds.groupBy("seed")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), ((F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))).alias("settled"))
        .where("first < last")
        .select("seed", "first", "settled")
    )
    # Read back from files, both sides of the joins below are plain shuffles, whose large partitions Spark splits.
    shared = storage.materialize(shared, "shared")
    members = storage.materialize(seeds.join(shared, "seed"), "members")
    one = members.where("settled AND doc_id > first").select("doc_id", "row", "lo", "hi")
    several = members.where("NOT settled")
    contexts = storage.materialize(several.groupBy("seed", "c1", "c2").agg(F.min("doc_id").alias("own")), "contexts")
    several = several.join(contexts, ["seed", "c1", "c2"])
    copies = several.where("doc_id > own").select("doc_id", "row", "lo", "hi")
    open_ = several.where("doc_id = own").groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
    passages = storage.materialize(keyed(docs).join(open_, ["doc_id", "row"], "left").select("doc_id", "text", "row", "open").mapInArrow(K.lean(_extend(length)), _PASSAGES), "passages")
    earliest = passages.groupBy("w1", "w2").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last")).where("own < last").select("w1", "w2", "own")
    earliest = storage.materialize(earliest, "earliest")
    hits = passages.join(earliest, ["w1", "w2"]).where("doc_id > own").select("doc_id", "row", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return one.unionByName(copies).unionByName(hits).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "row")


def _cut(length: int, with_text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if gone:
                    change = np.zeros(n + 1, np.int32)
                    np.add.at(change, [x["lo"] for x in gone], 1)
                    np.add.at(change, [x["hi"] + length for x in gone], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:n] == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, ``kept``: the kept words joined by one space."""
    if not 0 < seed <= length:
        raise ValueError("a seed has between 1 and length words")
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = repeats(docs, length, seed)
    both = keyed(docs).join(gone, ["doc_id", "row"], "left").select("doc_id", "text", "gone")
    out = both.mapInArrow(K.lean(_cut(length, with_text)), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
