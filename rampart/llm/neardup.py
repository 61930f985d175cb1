"""Near-duplicate documents by Order MinHash, candidates verified by banded alignment.

1. Words are lower-cased runs of letters and digits; a document's k-mers are its windows of five words, each labelled
   with its occurrence number, so that a repeated one counts again. Documents with equal words are one *text*.
2. A sketch hashes all labelled k-mers, takes the smallest few and keeps them in text order. Two texts share it with
   about the probability similarity ** few, and only if the shared k-mers come in one order: it is sensitive to edits
   and moves, not only to sets. Sixteen sketches miss a pair of similarity 0.8 about once in ten million times.
3. Texts that share a sketch are candidates, and every pair of candidates is compared unless the two are in one class
   by other links already. First all pairs of small buckets are, and in large ones each text and the bucket's *hub*, the
   text whose sketches the most texts share: in a group of copies that is their original. Then the pairs of large
   buckets that are still in different classes are compared in blocks of bounded size; there, a count of the k-mers
   that two texts share rules out most pairs before they are aligned.
4. Verification aligns two k-mer sequences: shared k-mers are matched in order, within the band of shifts that the
   threshold allows. With m matches, the similarity is m / (n1 + n2 - m); 0.8 or more makes a link.
5. Classes are the connected components of the links.

A document with fewer than five words has one k-mer, of all its words. Null texts and texts without words are alike to
nothing and get a class of their own, as do rows with a null doc_id (whose class is null). Rows that repeat a doc_id
are classed each by its own text. Ties: where several texts have a class's smallest doc_id, the one with the smallest
hash represents it. Very long texts are handled whole; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rampart.llm import graph, storage
from rampart.llm import kernels as K

KMER, SKETCHES, FEW, SIMILAR = 5, 16, 2, 0.8
#: Buckets of up to so many members compare all of them at once; larger ones begin with their hub.
SMALL = 8
#: Bytes in a block of members of a large bucket, about: four for a k-mer and 512 for a member. It bounds memory, not what is compared.
BLOCK = 262_144

_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = False
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def kmers(data: np.ndarray, at: np.ndarray, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled k-mer hashes of all rows, each row's first k-mer, and two hashes of each row's words."""
    s, e, first = K.words(data, at, _BREAK)
    n = np.diff(first)
    h, g = (K.prefix_hash(K.word_hashes(data, s, e, w), w) for w in (0, 1))
    whole = K.span_hash(h, first[:-1], first[1:]), K.span_hash(g, first[:-1], first[1:], 1)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(begin[-1]) - begin[row] + first[row]
    hashed = K.span_hash(h, start, np.minimum(start + k, first[row + 1]))
    # Occurrence numbers: equal hashes of a row are neighbours after a stable sort.
    order = np.lexsort((hashed, row))
    sh, sr = hashed[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    place = np.arange(len(order))
    nth = np.empty(len(order), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return K.mix(hashed + nth.astype(K.U) * K.U(0x9E3779B97F4A7C15)), begin, *whole


def sketch(labelled: np.ndarray, begin: np.ndarray, sketches: int = SKETCHES, few: int = FEW) -> np.ndarray:
    """(rows, sketches) of hashes over the ``few`` smallest k-mers in text order. Every row has a k-mer."""
    n = np.diff(begin)
    out = np.empty((len(n), sketches), K.U)
    top = K.U(0xFFFFFFFFFFFFFFFF)
    for j in range(sketches):
        h = (labelled ^ K.mix(np.array([j + 1], K.U))) * K.U(0xD1342543DE82EF95)
        h ^= h >> K.U(32)
        places = []
        for _ in range(few):
            least = np.minimum.reduceat(h, begin[:-1])
            hits = np.flatnonzero(h == np.repeat(least, n))
            rows = np.searchsorted(begin, hits, side="right") - 1
            place = np.empty(len(n), np.int64)
            place[rows[::-1]] = hits[::-1]
            places.append(np.where(least == top, -1, place))
            h[hits] = top
        ordered = np.sort(np.stack(places), axis=0)
        value = np.full(len(n), j + 1, K.U)
        for p in ordered:
            value = K.mix(value * K.U(0x9FB21C651E98DF25) + np.where(p < 0, K.U(0), labelled[np.maximum(p, 0)]))
        out[:, j] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray, similar: float) -> float:
    """Similarity by alignment within the band, or 0.0 as soon as it can't reach ``similar``."""
    na, nb = len(a), len(b)
    need = similar / (1 + similar) * (na + nb)  # matches at least
    if min(na, nb) < need:
        return 0.0
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[order_a], b[order_b]
    at = np.searchsorted(sb, sa)
    at[at == nb] = nb - 1
    same = sb[at] == sa
    if same.sum() < need:
        return 0.0
    i, j = order_a[same], order_b[at[same]]
    # With ``need`` matches in order, no match stands further off the diagonal than the k-mers left over on its side.
    band = max(na, nb) - need
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    j = j[np.argsort(i, kind="stable")]
    if len(j) < need:
        return 0.0
    if (j[1:] > j[:-1]).all():
        m = len(j)
    else:
        tails: list[int] = []  # the longest rising sequence
        for x in j.tolist():
            p = bisect_left(tails, x)
            tails[p : p + 1] = [x]
        m = len(tails)
    found = m / (na + nb - m)
    return found if found >= similar else 0.0


_TEXTS = "doc_id bigint, row bigint, node binary, n int, sketches array<bigint>"


def _nodes(one: np.ndarray, two: np.ndarray) -> pa.Array:
    both = np.stack([one.byteswap(), two.byteswap()], axis=1).tobytes()  # big-endian: bytes order as numbers do
    return pa.Array.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(both)]).cast(pa.binary())


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.select([0, 2])
        for r0, r1, data, at in K.chunks(batch.column(1), lower=True):
            labelled, begin, one, two = kmers(data, at)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            lists = sketch(labelled, np.append(begin[:-1][some], begin[-1]))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * SKETCHES), pa.array(K.signed(lists.reshape(-1))))
            rows = own.slice(r0, r1 - r0).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rows.columns, _nodes(one[some], two[some]), pa.array(n[some].astype(np.int32)), values], names=["doc_id", "row", "node", "n", "sketches"])


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and its labelled k-mers, 32 bits of each."""
    for batch in batches:
        for r0, r1, data, at in K.chunks(batch.column(1), lower=True):
            labelled, begin, _, _ = kmers(data, at)
            small = (labelled >> K.U(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), pa.array([small[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], names=["node", "kmers"])


def _linked(similar: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ok = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similar) > 0 for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _pairs(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs (a < b) that the numbers of k-mers allow, from rows of x, nx, y, ny."""
    fits = (F.col("x") != F.col("y")) & (F.least("nx", "ny") >= similar * F.greatest("nx", "ny"))
    return rows.where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _first(members: DataFrame) -> DataFrame:
    """Pairs that share a bucket: all of them in small buckets, each member and the hub in large ones."""
    small, large = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL)
    by = W.partitionBy("bucket").orderBy("node")
    back = small.select("node", "n", *(F.lag(F.struct("node", "n"), k).over(by).alias(f"p{k}") for k in range(1, SMALL)))
    near = back.select("node", "n", F.explode(F.array(*(f"p{k}" for k in range(1, SMALL)))).alias("p"))
    near = near.where("p IS NOT NULL").select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("p.node").alias("y"), F.col("p.n").alias("ny"))
    hubs = storage.placed(large.groupBy("bucket").agg(F.max(F.struct("score", "node", "n")).alias("hub")), "hubs")
    star = large.join(hubs, "bucket").select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("hub.node").alias("y"), F.col("hub.n").alias("ny"))
    return near.unionByName(star)


def _cells(members: DataFrame, single: DataFrame, short: DataFrame) -> DataFrame:
    """Members of large buckets that hold several classes, once for each cell: a pair of blocks (i <= j) to compare.

    The members of a bucket's largest class fill blocks of their own, which are not held against each other.
    """
    sizes = members.where(F.col("size") > SMALL).groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("many"), F.sum(4 * F.col("n") + 512).alias("bytes"))
    sizes = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("many", "root", "bytes")).alias("most"), F.sum("bytes").alias("bytes")).where("roots > 1")
    blocks = [F.ceil(k / BLOCK).cast("int") for k in (F.col("bytes") - F.col("most.bytes"), F.col("most.bytes"))]
    sizes = storage.placed(sizes.select("bucket", F.col("most.root").alias("top"), blocks[0].alias("rest"), blocks[1].alias("most")), "mixed")
    salted = members.join(sizes, "bucket").withColumn("h", F.xxhash64("node", "bucket"))
    own = F.when(F.col("root") == F.col("top"), F.col("rest") + F.pmod("h", "most")).otherwise(F.pmod("h", "rest")).cast("int")
    others = F.when(F.col("root") == F.col("top"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("most") - 1))
    placed = salted.select("bucket", "node", "root", own.alias("own"), others.alias("others"))
    whole = placed.join(single.select("node", "sketches"), "node").join(short, "node")
    met = whole.select("bucket", "own", F.explode("others").alias("other"), "node", "root", "sketches", "kmers")
    cells = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "sketches", "kmers")
    return cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _shared(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) of upper bounds of the k-mers that two members share."""
    sizes = np.array([len(g) for g in grams])
    _, inverse, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(grams)), sizes)
    useful = count > 1  # k-mers that occur once are shared by no pair
    column = (np.cumsum(useful) - 1)[inverse]
    keep = useful[inverse]
    order = np.argsort(column[keep], kind="stable")
    member, column = member[keep][order], column[keep][order]
    out = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for c in range(0, int(useful.sum()), step):
        lo, hi = np.searchsorted(column, [c, c + step])
        part = np.zeros((len(grams), step), np.float32)
        np.add.at(part, (member[lo:hi], column[lo:hi] - c), 1)
        out += part[left] @ part[right].T
    return out


def _cell_links(bucket: int, i: int, j: int, rows: list[list], similar: float) -> list[tuple[bytes, bytes]]:
    """Links of one cell between members of different classes; further links between joined classes are left out."""
    own = np.array([r[0] for r in rows])
    grams = [np.frombuffer(r[4], np.uint32) for r in rows]
    n = np.array([len(g) for g in grams])
    sketches = np.array([r[3] for r in rows], np.int64)
    names: dict[bytes, int] = {}
    root = np.array([names.setdefault(r[2], len(names)) for r in rows])
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if not len(left) or not len(right) or len(names) < 2:
        return []
    a, b = n[left][:, None], n[right][None, :]
    need = similar / (1 + similar) * (a + b)
    open_ = (root[left][:, None] != root[right][None, :]) & (np.minimum(a, b) >= need - 1e-6)
    if i == j:
        open_ &= left[:, None] < right[None, :]
    # A pair with several buckets is compared in that of its first common sketch.
    earlier, met = np.zeros(open_.shape, bool), np.zeros(open_.shape, bool)
    for k in range(sketches.shape[1]):
        if not open_.any():
            return []
        here = sketches[left, k] == bucket, sketches[right, k] == bucket
        both = here[0][:, None] & here[1][None, :]
        same = sketches[left, k][:, None] == sketches[right, k][None, :]
        met |= both & ~earlier
        earlier |= same
    open_ &= met
    if not open_.any():
        return []
    count = _shared(grams, left, right)
    x, y = np.nonzero(open_ & (count >= need - 1e-6))
    best = np.argsort(-(count[x, y] / (n[left[x]] + n[right[y]])), kind="stable")
    joined = list(range(len(names)))

    def find(k: int) -> int:
        while joined[k] != k:
            joined[k] = joined[joined[k]]
            k = joined[k]
        return k

    links = []
    for p in best.tolist():
        u, v = int(left[x[p]]), int(right[y[p]])
        ru, rv = find(int(root[u])), find(int(root[v]))
        if ru != rv and aligned(grams[u], grams[v], similar) > 0:
            joined[ru] = rv
            links.append((min(rows[u][1], rows[v][1]), max(rows[u][1], rows[v][1])))
    return links


def _compared(similar: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of all cells; the rows of a cell follow each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def links() -> pa.RecordBatch:
            found = _cell_links(*key, rows, similar)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if key != (bucket, i, j):
                        if rows:
                            yield links()
                        key, rows = (bucket, i, j), []
                    rows.append(row)
        if rows:
            yield links()

    return run


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``doc_id, row, class_id, class_row`` of the rows that have words: ``row`` is the text's hash, ``class_id`` and
    ``class_row`` are those of the class's smallest doc_id."""
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = storage.materialize(known.mapInArrow(K.lean(_sketched), _TEXTS), "sketches")
    # One row of each text goes on: that of its smallest doc_id. Its copies have the same k-mers.
    single = texts.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.any_value("n").alias("n"), F.any_value("sketches").alias("sketches"))
    single = storage.materialize(single.select("node", "first.doc_id", "first.row", "n", "sketches"), "texts")
    buckets = single.select("node", "n", F.explode("sketches").alias("bucket"))
    shared = storage.placed(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    sized = storage.materialize(buckets.join(shared, "bucket"), "buckets")
    # The hub of a bucket has the greatest score: the members of all the text's buckets.
    scores = storage.placed(sized.groupBy("node").agg(F.sum("size").alias("score")), "scores")
    members = storage.materialize(sized.join(scores, "node"), "members")
    # Only what is in a bucket with others is read again; a short list of it spares a shuffle of the texts.
    wanted = storage.placed(members.select("node").distinct().join(single, "node").select("node", "doc_id", "row"), "wanted")
    short = known.join(wanted, ["doc_id", "row"]).select("node", "text").mapInArrow(K.lean(_short), "node binary, kmers binary")
    short = storage.materialize(short.dropDuplicates(["node"]), "kmers")
    storage.discard(shared, sized, scores, wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (short.select(F.col("node").alias(x), F.col("kmers").alias(f"k{x}")) for x in ("a", "b"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "ka", "kb")
        return both.mapInArrow(K.lean(_linked(similar)), "a binary, b binary")

    links = storage.materialize(verified(_pairs(_first(members), similar)), "verified")
    roots = graph.components(links)
    classed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = _cells(classed, single, short).mapInArrow(K.lean(_compared(similar)), "a binary, b binary")
    # One link of each class and node stands for all that were found before.
    more = storage.materialize(more.distinct(), "compared")
    if more.limit(1).count():
        roots = graph.components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = single.join(roots, "node", "left").select("node", "doc_id", "row", F.coalesce("root", "node").alias("root"))
    smallest = storage.placed(named.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")), "classes")
    by_node = named.join(smallest, "root").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row"))
    by_node = storage.materialize(by_node, "nodes")
    storage.discard(members, short, links, more, smallest, single)
    return texts.select("doc_id", "row", "node").join(by_node, "node").select("doc_id", "row", "class_id", "class_row").distinct()


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id for every row of ``df``."""
    found = classes(df, doc_id, text, similar)
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"))
    return rows.join(found, ["doc_id", "row"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each class: that of its smallest doc_id. All rows with a null doc_id or text stay.

    Of rows that repeat a doc_id and a text, the one with the smallest hash of all columns stays; rows that are equal in
    every column count as one. Columns of map type are not looked at for that.
    """
    ids, own = F.col(doc_id).cast("bigint"), F.xxhash64(F.col(text))
    every = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
    gone = classes(df, doc_id, text, similar).where("class_id != doc_id OR class_row != row").select(F.col("doc_id").alias("_rampart_id"), F.col("row").alias("_rampart_row"), F.lit(None).cast("bigint").alias("_rampart_first"))
    named = df.where(ids.isNotNull() & F.col(text).isNotNull()).select(ids.alias("_rampart_id"), own.alias("_rampart_row"), every.alias("_rampart_hash"))
    again = named.groupBy("_rampart_id", "_rampart_row").agg(F.count(F.lit(1)).alias("_rampart_n"), F.min("_rampart_hash").alias("_rampart_first")).where("_rampart_n > 1").drop("_rampart_n")
    again = again.join(gone, ["_rampart_id", "_rampart_row"], "left_anti")
    # Rows to look at: those that go, without a hash, and those that repeat, with the hash that stays.
    marked = storage.placed(gone.unionByName(again).withColumn("_rampart_mark", F.lit(True)), "marked")
    both = df.join(marked, (ids == F.col("_rampart_id")) & (own == F.col("_rampart_row")), "left")
    single = both.where("_rampart_mark IS NULL").select(*df.columns)
    repeated = both.where(F.col("_rampart_first") == every).select(*df.columns, "_rampart_id", "_rampart_row").dropDuplicates(["_rampart_id", "_rampart_row"]).select(*df.columns)
    return single.unionByName(repeated)
