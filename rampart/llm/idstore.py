"""Token ids in a content-addressed store.

``write`` encodes documents, cuts each document's id stream into chunks where a rolling hash of its last ids says so,
stores every distinct chunk once under its digest, and keeps for each document a recipe: the digests of its chunks in
order. Recipes stand in ascending doc_id order with the number of ids before each; a manifest holds one Merkle root
for each part of the recipes and one above them. ``read`` gives the ids back and fails on any damaged chunk or recipe.

Layout below a folder, all Parquet:

- ``store``: rows of kind 0 (``digest``, ``payload``: little-endian ids, 16 bits where the vocabulary allows, else 32)
  and of kind 1 (a document's recipe, as written by the encoding tasks);
- ``recipes``: ``part, pos, doc_id, start, n_tokens, digests``, sorted by part and pos; ``start`` counts from the part's;
- ``manifest``: ``part, n_docs, n_tokens, start, root`` and a row of part -1 with the root of roots.

Null and empty texts have the end id only; very long texts are encoded in full; repeated rows and repeated ids keep a
recipe each (ties in doc_id are ordered by their digests, a null doc_id comes first); other columns are not looked at.
An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.llm import kernels as K
from rampart.llm import storage

#: Ids in a chunk: at least, about, at most. The rolling hash sees the last ROLL ids.
SMALLEST, USUAL, LARGEST, ROLL = 128, 512, 4096, 16
DIGEST = 16
#: Bytes of texts encoded together: the more, the more of their parts are looked up once.
GROUP = 2 << 20


def _digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


class Encoder:
    """Ids of texts by a tokenizers file.

    Texts are cut before spaces, around newlines and between a word and the punctuation after it, where byte-level
    pre-tokenization cuts them anyhow. Each distinct part of a group of texts is looked up once; the ids of parts are kept
    in bounded caches of two generations.
    """

    CACHED = 450_000
    #: Words in one call of the model: its work on a stretch grows a little faster than the stretch.
    AT_ONCE = 128
    #: Words whose encodings are held at once.
    HELD = 1 << 14
    #: Signs that the pre-tokenizer may take together with others, so that texts with them are encoded in one piece: white
    #: space but for single spaces and newlines, and the signs used as marks here.
    _ODD = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00\x01\t\r\x0b\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    _AFTER = ",.!?;:|%&#$*"
    _IS_AFTER = np.isin(np.arange(256), np.frombuffer(_AFTER.encode(), np.uint8))
    #: Letters and digits of one byte; first bytes of the two of the letters U+00C0 to U+017F (but for two signs) and
    #: U+0400 to U+047F. After other letters punctuation stays in the word's part.
    _IS_WORD = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
    _LEADS = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])

    def __init__(self, path: str, end_id: int | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs at once
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.added = tuple(x.content for x in self.t.get_added_tokens_decoder().values())  # found in texts before any cut
        self.end = end_id
        self.type = np.dtype("<u2") if self.t.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cuttable = self._cuttable()
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that are their own sign
        other = [b for b in range(256) if b not in plain]
        sign = {b: chr(256 + k) for k, b in enumerate(other)} | {b: chr(b) for b in plain}
        self.sign = np.array([ord(sign[b]) for b in range(256)], np.dtype("<u4"))
        # A word of letters, or punctuation alone, is one unit of the pre-tokenizer: the model takes it as it is, and many
        # at once if a sign stands between them that it merges with nothing.
        self.bare = Tokenizer(self.t.model)
        vocabulary = self.t.get_vocab(with_added_tokens=False)
        self.between = vocabulary.get(sign[0], -1)
        tried = [" the", "naïve", " Größe", "日本", "%%%", ",", " qzxw", "", " ", " the"]
        apart = self.cuttable and self.between >= 0 and not any(sign[0] in v and v != sign[0] for v in vocabulary)
        self.direct = apart and [np.frombuffer(x, self.type).tolist() for x in self._units(tried)] == [self.t.encode(w, add_special_tokens=False).ids for w in tried]

    def _units(self, words: list[str]) -> list[bytes]:
        """Ids of each of some words that are one unit of the pre-tokenizer and hold no zero byte."""
        if not words:
            return []
        signs = [self.sign[np.frombuffer(("\0".join(words[k : k + self.AT_ONCE]) + "\0").encode(), np.uint8)].tobytes().decode("utf-32-le") for k in range(0, len(words), self.AT_ONCE)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.bare.encode_batch_fast(signs, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.between) * self.type.itemsize
        data = ids.astype(self.type).tobytes()
        return [data[a:b] for a, b in zip([0, *(ends[:-1] + self.type.itemsize).tolist()], ends.tolist(), strict=True)]

    def _cuttable(self) -> bool:
        """Whether this file's own pre-tokenizer cuts at these places."""
        pre = self.t.pre_tokenizer
        if pre is None or self.t.normalizer is not None:
            return False
        return [x for x, _ in pre.pre_tokenize_str("ab, cd\nef 1.\ng%%%")] == ["ab", ",", "Ġcd", "Ċ", "ef", "Ġ1", ".", "Ċ", "g", "%%%"]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, which joined are the texts, and the number of each text's."""
        data, at = K.raw(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        row = np.zeros(len(data) + 1, dtype=bool)
        row[at] = True
        starts = row.copy()
        starts[:-1] |= data == 32
        newline = np.flatnonzero(data == 10)
        starts[newline] = starts[newline + 1] = True
        # Runs of punctuation that a part ends with, after a letter or digit.
        stop = np.flatnonzero(self._IS_AFTER[data])
        if len(stop):
            new = np.append(True, np.diff(stop) > 1) | row[stop]
            run, end = stop[new], stop[np.append(new[1:], True)] + 1
            one, two = data[np.maximum(run - 1, 0)], data[np.maximum(run - 2, 0)]
            own = self._IS_WORD[one] | (one >= 128) & (one < 192) & self._LEADS[two] & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7)))
            starts[run[own & starts[end] & ~row[run]]] = True
        cuts = np.flatnonzero(starts)
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        return parts, np.diff(np.searchsorted(cuts, at))

    def _learned(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, in their order."""
        young, old, after, direct = self.young, self.old, self._AFTER, self.direct
        known = list(map(young.get, parts))
        missing = [k for k, ids in enumerate(known) if ids is None]
        units, whole = [], []
        for k in missing:
            p = parts[k]
            ids = old.get(p)
            if ids is not None:
                young[p] = ids
            elif direct and (p.lstrip(" ").isalpha() or not p.strip(after)):  # a part has one space at most
                units.append(p)
            else:
                whole.append(p)
        for k in range(0, len(units), self.HELD):
            young.update(zip(units[k : k + self.HELD], self._units(units[k : k + self.HELD]), strict=True))
        for k in range(0, len(whole), 4096):
            for p, e in zip(whole[k : k + 4096], self.t.encode_batch_fast(whole[k : k + 4096], add_special_tokens=False), strict=True):
                young[p] = np.array(e.ids, self.type).tobytes()
        for k in missing:
            known[k] = young[parts[k]]
        return known

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the end id; where each begins (one more entry than texts)."""
        texts = K.strings(texts)
        odd = pc.match_substring_regex(texts, self._ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        if not self.cuttable:
            odd = pc.or_(odd, pc.is_valid(texts))
        parts, counts = self._cut(pc.if_else(odd, "", texts))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        parts = parts.dictionary_encode()
        known = self._learned(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array(list(map(len, known)), np.int64) // self.type.itemsize
        lists_ = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(np.frombuffer(b"".join(known), self.type)))
        taken = lists_.take(parts.indices)
        ids, ends = taken.flatten().to_numpy(), np.cumsum(size[parts.indices.to_numpy(zero_copy_only=False)])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if len(odd) or self.end is not None:
            out, own = [], np.zeros(len(texts) + 1, np.int64)
            whole = {r: np.array(e.ids, self.type) for k in range(0, len(odd), 64) for r, e in zip(odd[k : k + 64].tolist(), self.t.encode_batch_fast([texts[r].as_py() for r in odd[k : k + 64].tolist()], add_special_tokens=False), strict=True)}
            tail = np.array([] if self.end is None else [self.end], self.type)
            for r in range(len(texts)):
                one = whole.get(r)
                out += [ids[bounds[r] : bounds[r + 1]] if one is None else one, tail]
                own[r + 1] = own[r] + len(out[-2]) + len(tail)
            ids, bounds = np.concatenate(out) if out else ids, own
        if len(self.young) > self.CACHED:
            self.young, self.old = {}, self.young
        return ids, bounds


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def cut(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream ids[first[r]:first[r + 1]]: where the hash of the last ROLL ids ends in zeros,
    within the size bounds."""
    marks = np.empty(0, np.int64)
    if first[-1] >= ROLL:
        hashed = K.prefix_hash(ids.astype(K.U) + K.U(1))
        end = np.arange(ROLL, first[-1] + 1)
        marks = end[K.span_hash(hashed, end - ROLL, end) % K.U(USUAL - SMALLEST) == 0]
    lo, hi = np.searchsorted(marks, first[:-1] + SMALLEST), np.searchsorted(marks, first[1:])
    out = []
    for r, n in enumerate(np.diff(first).tolist()):
        ends, last = [], 0
        for m in [*(marks[lo[r] : hi[r]] - first[r]).tolist(), n]:
            while m - last > LARGEST:
                last += LARGEST
                ends.append(last)
            if m > last and (m - last >= SMALLEST or m == n):
                ends.append(m)
                last = m
        out.append(ends)
    return out


_STAGED = "kind int, key binary, doc_id bigint, n_tokens bigint, digests array<binary>, payload binary"
_STAGED_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("payload", pa.binary())])


def _stage(path: str, end_id: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, task, nth = encoder(path, end_id), set(), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi in K.slices(b.column(1), GROUP):
                part = b.slice(lo, hi - lo)
                rows: list[tuple] = []
                ids, first = e.encode_many(part.column(1))
                at = first.tolist()
                for r, (doc, ends) in enumerate(zip(part.column(0).to_pylist(), cut(ids, first), strict=True)):
                    digests, last, base = [], 0, at[r]
                    for end in ends:
                        payload = ids[base + last : base + end].tobytes()
                        digests.append(d := _digest(payload))
                        if d not in seen:
                            if len(seen) > 500_000:  # forgetting costs a second copy in the shuffle, never in the store
                                seen.clear()
                            seen.add(d)
                            rows.append((0, d, None, None, None, payload))
                        last = end
                    rows.append((1, _digest(b"%d %d" % (task, nth)), doc, at[r + 1] - base, digests, None))
                    nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STAGED_ARROW, strict=True)], schema=_STAGED_ARROW)

    return run


def _leaf(doc: int | None, n: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(repr((doc, n)).encode() + b"".join(digests)).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves; an odd one moves up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


class Merkle:
    """The same root from leaves one at a time, in memory of the tree's height."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for k in range(len(self.levels)):
            if self.levels[k] is None:
                self.levels[k] = leaf
                return
            leaf, self.levels[k] = hashlib.sha256(self.levels[k] + leaf).digest(), None
        self.levels.append(leaf)

    def root(self) -> bytes:
        root = None
        for x in self.levels:
            if x is not None:
                root = x if root is None else hashlib.sha256(x + root).digest()
        return root or hashlib.sha256(b"").digest()


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number, the row's number in it, and the ids before it in it."""
    part, pos, before = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = np.array(b.column(1).to_pylist(), np.int64)
        starts = before + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(pos + np.arange(len(n))), b.column(0), pa.array(starts, pa.int64()), b.column(1), b.column(2)], names=["part", "pos", "doc_id", "start", "n_tokens", "digests"])
        pos, before = pos + len(n), before + int(n.sum())


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One manifest row for each part; a part's rows are in one file, in order."""
    trees: dict[int, list] = {}
    for b in batches:
        for part, doc, n, digests in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            t = trees.setdefault(part, [Merkle(), 0, 0])
            t[0].add(_leaf(doc, n, digests))
            t[1] += 1
            t[2] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(trees), pa.int64()), pa.array([t[1] for t in trees.values()], pa.int64()), pa.array([t[2] for t in trees.values()], pa.int64()), pa.array([t[0].root() for t in trees.values()], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``text`` and write the store, the recipes and the manifest below ``folder``."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    staged = docs.mapInArrow(K.lean(_stage(tokenizer, end_id), cycles=False), _STAGED)
    # Copies of a chunk within a task are gone already, so no digest brings more rows than there are tasks; each recipe
    # has a key of its own.
    stored = staged.repartition(storage.partitions(docs), "key").sortWithinPartitions("kind", "key").dropDuplicates(["kind", "key"])
    stored.write.option("compression", "zstd").parquet(f"{folder}/store")

    rows = spark.read.parquet(f"{folder}/store").where("kind = 1")
    own = rows.select("doc_id", "digests", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"), "n_tokens")
    # Ranges of all four, so that one id (or null), and even one id and text, may have any share of the rows.
    keys = ("doc_id", "digests", "file", "nth")
    ordered = own.repartitionByRange(storage.partitions(rows), *keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "digests")
    recipes = ordered.mapInArrow(K.lean(_number), "part bigint, pos bigint, doc_id bigint, start bigint, n_tokens bigint, digests array<binary>")
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    manifest(spark, folder).write.parquet(f"{folder}/manifest")


_MANIFEST = "part bigint, n_docs bigint, n_tokens bigint, start bigint, root binary"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Roots of the recipes as they are now: one row for each part, and one of part -1 above them."""
    recipes = spark.read.parquet(f"{folder}/recipes").select("part", "doc_id", "n_tokens", "digests", "pos")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roots = recipes.repartition(n, "part").sortWithinPartitions("part", "pos").mapInArrow(K.lean(_roots), "part bigint, n_docs bigint, n_tokens bigint, root binary")
    rows, before = [], 0
    for r in sorted(roots.collect()):  # as many as there are parts
        rows.append((r["part"], r["n_docs"], r["n_tokens"], before, bytes(r["root"])))
        before += r["n_tokens"]
    total = (-1, sum(r[1] for r in rows), before, 0, merkle([r[4] for r in rows]))
    return spark.createDataFrame([*rows, total], _MANIFEST)


def verify(spark: SparkSession, folder: str) -> None:
    """Compare the manifest with the recipes."""
    kept = {r["part"]: bytes(r["root"]) for r in spark.read.parquet(f"{folder}/manifest").collect()}
    if kept != {r["part"]: bytes(r["root"]) for r in manifest(spark, folder).collect()}:
        raise ValueError(f"the recipes in {folder} do not match their manifest")


def _opened(batches: Iterable[pa.RecordBatch], width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Digest, number of ids and CRC-32 of their 32-bit form for each stored chunk; fails on a chunk that isn't what its digest says."""
    for b in batches:
        out = []
        for digest, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if _digest(payload) != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            ids = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
            out.append((digest, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["digest", "n", "crc", "ids"])


def _chunks(spark: SparkSession, folder: str, tokenizer: str, with_ids: bool) -> DataFrame:
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    found = spark.read.parquet(f"{folder}/store").where("kind = 0").select(F.col("key").alias("digest"), "payload")
    return found.mapInArrow(K.lean(lambda it: _opened(it, width, with_ids)), "digest binary, n bigint, crc bigint, ids binary")


def _pieces(spark: SparkSession, folder: str, chunks: DataFrame) -> DataFrame:
    """A row for each document with its chunks in order."""
    parts = spark.read.parquet(f"{folder}/manifest").where("part >= 0").select("part", F.col("start").alias("before"))
    # A row for each part, as many as there are shuffle partitions.
    recipes = spark.read.parquet(f"{folder}/recipes").join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")
    steps = recipes.select("part", "pos", "doc_id", "start", F.posexplode("digests").alias("step", "digest"))
    kept = [c for c in ("n", "crc", "ids") if c in chunks.columns]
    found = steps.join(chunks, "digest", "left").groupBy("part", "pos").agg(F.array_sort(F.collect_list(F.struct("step", *kept))).alias("steps"))
    return recipes.select("part", "pos", "doc_id", "start", "n_tokens").join(found, ["part", "pos"], "left")


def read(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian 32-bit), rebuilt from the files."""
    rows = _pieces(spark, folder, _chunks(spark, folder, tokenizer, True).select("digest", "n", "ids"))
    ids = F.when(F.coalesce(F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, s: a + s["n"]), F.lit(0)) != F.col("n_tokens"), F.raise_error(F.lit("a recipe's ids are not all there"))).otherwise(
        F.coalesce(F.aggregate("steps", F.lit(b""), lambda a, s: F.concat(a, s["ids"])), F.lit(b""))
    )
    return rows.select("doc_id", "start", "n_tokens", ids.alias("ids"))


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    p = 0
    while a:
        if a & 0x80000000:
            p ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return p


_shifts: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 n."""
    if n_bytes not in _shifts:
        p, square, n = 0x80000000, 0x00800000, n_bytes
        while n:
            if n & 1:
                p = _times(square, p)
            square = _times(square, square)
            n >>= 1
        _shifts[n_bytes] = p
    return _shifts[n_bytes]


def joined_crc(steps: Iterable[tuple[int, int]], crc: int = 0) -> int:
    """CRC-32 of a sequence of parts from each part's (bytes, CRC-32), and that of what stands before."""
    for n, c in steps:
        crc = _times(_shift(n), crc) ^ c
    return crc


def _times_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_times`` of each pair."""
    p, b = np.zeros(len(a), np.uint32), b.copy()
    for bit in range(31, -1, -1):
        p ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return p


def joined_crcs(first: np.ndarray, n_bytes: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """``joined_crc`` of the parts first[r]:first[r + 1] of each row r: of all rows step by step, while many have one."""
    sizes, size = np.unique(n_bytes, return_inverse=True)
    shift = np.array([_shift(n) for n in sizes.tolist()], np.uint32)[size] if len(sizes) else np.empty(0, np.uint32)
    out, count, step = np.zeros(len(first) - 1, np.uint32), np.diff(first), 0
    rows = np.flatnonzero(count)
    while len(rows) > 16:
        at = first[rows] + step
        out[rows] = _times_all(shift[at], out[rows]) ^ crcs[at]
        step += 1
        rows = rows[count[rows] > step]
    for r in rows.tolist():
        rest = slice(int(first[r]) + step, int(first[r + 1]))
        out[r] = joined_crc(zip(n_bytes[rest].tolist(), crcs[rest].tolist(), strict=True), int(out[r]))
    return out


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        steps = b.column(3)
        count = pc.fill_null(pc.list_value_length(steps), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        flat = steps.flatten()
        n = pc.fill_null(flat.field("n"), -1).to_numpy(zero_copy_only=False)  # a chunk that the store doesn't have
        before = np.concatenate([[0], np.cumsum(n)])
        wrong = before[first[1:]] - before[first[:-1]] != b.column(2).to_numpy(zero_copy_only=False)
        wrong[np.searchsorted(first, np.flatnonzero(n < 0), side="right") - 1] = True
        if wrong.any():
            raise ValueError(f"the ids of document {b.column(0)[int(np.argmax(wrong))].as_py()} are not all there")
        crcs = pc.fill_null(flat.field("crc"), 0).to_numpy(zero_copy_only=False).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(joined_crcs(first, 4 * n, crcs).astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the files. Chunks are read and checked where they lie; what is
    shuffled is their CRC-32, since that of a document follows from those of its chunks."""
    rows = _pieces(spark, folder, _chunks(spark, folder, tokenizer, False).select("digest", "n", "crc"))
    return rows.select("doc_id", "start", "n_tokens", "steps").mapInArrow(K.lean(_digested), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
