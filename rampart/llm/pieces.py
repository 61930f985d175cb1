"""Encoding and decoding with a SentencePiece BPE model by a streaming Viterbi pass.

State at a text boundary: the last piece of the one segmentation of the text so far that the model's merges would
give. A piece may follow another only if merging their joined text gives exactly those two pieces again; with that
rule every boundary has at most one surviving backpointer. The encoder keeps the boundaries within the longest
piece's length of the read position; once all their backpointer paths meet in one boundary, everything before it
can no longer change, and its ids are committed. Signs outside the vocabulary become byte pieces.

Since no piece but runs of the space mark has that mark after its first sign, none has a newline, and none has certain
punctuation after a letter, all paths are known to meet at these places: the encoder commits there whatever comes, so
the ids between two of them depend on the signs between them only and are kept in a bounded cache. All signs that are
not in the cache go through the same encoder, sorted, so that what a stretch shares with the one before stays in the
window. Where paths don't meet for long, the window grows and a commit is tried each time that it has doubled, so time
stays linear.

Null and empty texts have no ids; very long texts are encoded in full, in memory bounded by the text and its ids;
repeated rows give repeated results, whatever their ids (null ones too); an empty table gives an empty result. Of other
columns, only those named as results are replaced. A model whose normaliser changes texts is refused.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm import kernels as K

MARK = "▁"


class Vocabulary:
    """Pieces, scores and byte fallback of a model file, and which pieces may follow which."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.rank = {names[i]: sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id = {names[i]: i for i in range(n) if names[i] in self.rank}
        self.longest = max(map(len, self.rank))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("a piece crosses a word boundary")
        # A piece that merging its own text doesn't give back is never used.
        self.usable = {p for p in self.rank if len(p) == 1 or self.merged(p) == [p]}
        # Ends of usable pieces, and whether one is a usable piece itself.
        self.tails = dict.fromkeys((p[i:] for p in self.usable for i in range(1, len(p))), False) | dict.fromkeys(self.usable, True)
        self.follows: dict[tuple[str, str], bool] = {}
        self.text = [b""] * n  # by id, for decoding
        for p, i in self.id.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """What merging gives: the best-scored adjacent pair that is a piece, leftmost first, until there is none."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.rank.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        ok = self.follows.get((left, right))
        if ok is None:
            if len(self.follows) > 150_000:
                self.follows.clear()
            ok = self.follows[left, right] = self.merged(left + right) == [left, right]
        return ok


class Encoder:
    """Feed text, take committed ids. The window holds the signs after the last boundary where all paths met."""

    #: Signs that enter the window at once.
    STEP = 64

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._restart("")

    def _restart(self, window: str) -> None:
        self.window = window  # text after the last committed boundary
        self.last: list[str | None] = [""]  # by boundary of the window: its surviving last piece; "" at the committed one
        self.before = ""  # the piece that ends at the committed boundary
        self.out: list[int] = []  # committed ids
        self.full = 2 * self.v.longest  # boundaries at which a commit is tried

    def _extend(self) -> None:
        """Find the surviving last piece of every boundary that has entered the window."""
        v = self.v
        tails, rank, follows = v.tails, v.rank, v.follows
        w, last, before = self.window, self.last, self.before
        end = len(last)
        while end <= len(w):
            found = None
            for start in range(end - 1, -1, -1):  # no end of a piece is longer than the longest one
                piece = w[start:end]
                whole = tails.get(piece)
                if not whole:
                    if whole is False:
                        continue
                    left = last[start]
                    if start == end - 1 and left is not None and piece not in rank:  # a sign that the model doesn't know
                        left = left or before
                        if not left or v.may_follow(left, piece):
                            found = piece
                    break
                left = last[start]
                if left is None:
                    continue
                left = left or before
                if left:
                    ok = follows.get((left, piece))
                    if ok is None:
                        ok = v.may_follow(left, piece)
                    if not ok:
                        continue
                found = piece
                break
            last.append(found)
            if end >= self.full:
                end -= self._commit()
                w, last, before = self.window, self.last, self.before
            end += 1

    def _commit(self) -> int:
        """Commit up to the boundary where the paths of all that a later piece can follow meet; the number of signs."""
        n = len(self.last) - 1
        ends = [-e for e in range(n + 1 - min(n, self.v.longest), n + 1) if self.last[e] is not None]
        heapq.heapify(ends)
        while len(ends) > 1:  # the furthest path goes back by one piece; paths that meet go on as one
            top = heapq.heappop(ends)
            if top != ends[0]:
                heapq.heappush(ends, top + len(self.last[-top]))
        shared = -ends[0]
        if shared:
            self._take(shared)
            self.full = 2 * self.v.longest
        else:
            self.full = 2 * n
        return shared

    def _path(self, at: int) -> list[int]:
        """Ids of the path to a boundary of the window."""
        ids, last, known = [], self.last, self.v.id
        while at:
            piece = last[at]
            i = known.get(piece)
            if i is None:
                ids += [self.v.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            else:
                ids.append(i)
            at -= len(piece)
        ids.reverse()
        return ids

    def _take(self, end: int) -> None:
        """Commit the path to a boundary, which becomes the window's start."""
        self.out += self._path(end)
        self.before = self.last[end]
        self.window, self.last = self.window[end:], ["", *self.last[end + 1 :]]

    def feed(self, text: str) -> list[int]:
        for k in range(0, len(text), self.STEP):
            self.window += text[k : k + self.STEP]
            self._extend()
        out, self.out = self.out, []
        return out

    def finish(self) -> list[int]:
        if self.window:
            self._take(len(self.window))
        out = self.out
        self._restart("")
        return out

    def stretches(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each of some sorted texts, of which none goes on from the one before."""
        self._restart("")
        before = ""
        for t in texts:
            head = t[: self.STEP]
            same = 0
            if not self.out:  # nothing of the text before has left the window
                for x, y in zip(head, before, strict=False):
                    if x != y:
                        break
                    same += 1
                self.window = head
                del self.last[same + 1 :]
            else:
                self._restart(head)
            self._extend()
            for k in range(self.STEP, len(t), self.STEP):
                self.window += t[k : k + self.STEP]
                self._extend()
            # The rest of the path is read off without a commit, so that the next text can share the window.
            yield array("i", self.out + self._path(len(self.window))).tobytes()
            before = t if len(t) <= self.STEP else ""
            if not before and not self.out:
                self._restart("")


class Codec:
    """Encoding and decoding of whole texts, with a bounded cache of the ids of stretches between known meeting places."""

    CACHED = 150_000  # stretches in each of two generations

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.encoder = Encoder(self.v)
        # Signs that no piece has after a letter or digit: a word may be cut before them.
        after = {b for p in self.v.rank for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
        free = re.escape("".join(sorted(set("!#$%&*,.:;?|") - after)))
        stop = rf"(?=[{MARK}\n{free}]|\Z)" if free else rf"(?=[{MARK}\n]|\Z)"
        self.cut = re.compile(rf"{MARK}*[^\W_]++{stop}|\n|{MARK}*[^{MARK}\n]++|{MARK}+")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if any(np.frombuffer(self.encode(t), np.int32).tolist() != self.v.library.encode(t) for t in self.PROBES):
            raise ValueError("the model's normaliser changes texts, or it is no BPE model")

    #: Texts on which the library itself must agree.
    PROBES = ("a  b", " a ", "\tA\u030a\u00c5", "\ufb01\u2460\uff21", "Hello, world", "x\u3000y", "\x07\u200b\n\n")

    def parts(self, text: str) -> list[str]:
        """The marked text, cut where no piece can reach across."""
        return self.cut.findall(MARK + text.replace(" ", MARK))

    def learn(self, words: set[str]) -> None:
        young, old, new = self.young, self.old, []
        for w in words - young.keys():
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                young[w] = ids
        new.sort()
        young.update(zip(new, self.encoder.stretches(new), strict=True))

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers; words are learned for about a million signs of text at once."""
        k = 0
        while k < len(texts):
            some, signs = [], 0
            while k < len(texts) and (not some or signs + len(texts[k] or "") < 1_000_000):
                some.append(self.parts(texts[k]) if texts[k] else [])
                signs += len(texts[k] or "")
                k += 1
            for words in some:
                if len(words) > 1_000_000:  # one huge text: in parts
                    yield b"".join(x for i in range(0, len(words), 500_000) for x in self._known(words[i : i + 500_000]))
            if len(some) > 1 or len(some[0]) <= 1_000_000:
                self.learn(set().union(*some))
                young = self.young
                for words in some:
                    yield b"".join(map(young.__getitem__, words))
            self._age()

    def _known(self, words: list[str]) -> list[bytes]:
        self._age()
        self.learn(set(words))
        return list(map(self.young.__getitem__, words))

    def _age(self) -> None:
        if len(self.young) > self.CACHED:
            self.old, self.young = self.young, {}

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes | np.ndarray) -> str:
        ids = np.frombuffer(ids, np.int32) if isinstance(ids, bytes) else ids
        table = self.v.text
        text = b"".join([table[i] for i in ids.tolist()])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}
K.forget.append(_codecs.clear)


def codec(path: str) -> Codec:
    """One for each task and model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoding(path: str, column: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches in, the same with a last column ``piece_ids`` out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo, hi in K.slices(b.column(column)):
                part = b.slice(lo, hi - lo)
                ids = list(c.encode_many(part.column(column).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, "piece_ids"])

    return K.lean(run, cycles=False)


def encode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``piece_ids`` (binary, little-endian 32-bit ids), in place of a column of this name."""
    df = df.drop("piece_ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "piece_ids binary"])
    return df.mapInArrow(encoding(model, df.columns.index(text)), schema)


def decode(df: DataFrame, model: str, ids: str = "piece_ids") -> DataFrame:
    """All columns of ``df`` plus ``decoded``, in place of a column of this name."""
    df = df.drop("decoded")
    at = df.columns.index(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "decoded string"])
    return df.mapInArrow(K.lean(run), schema)


def report(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_ids, the CRC-32 of its ids, and whether decoding gives the text back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for lo, hi in K.slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                ids = list(c.encode_many(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([c.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
                )

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id), F.col(text)).mapInArrow(K.lean(run, cycles=False), f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean")
