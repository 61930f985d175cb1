"""Language of each word by a linear-chain conditional random field, and of each document by its words.

A word's features are its first and last signs, the n-grams inside it, and whether it is in the lexicon (the most
frequent words of each language in the training texts), all hashed. Weights of features and of transitions between the
languages of neighbouring words are learned together by gradient steps on the log-likelihood of training sequences;
these join stretches of texts of several languages, so that changes of language within a text are learned too.
Forward-backward gives each word's marginals; a document's language is the one with the largest mean marginal, which
is its score.

Training takes at most ``SAMPLE`` documents of each language, those with the smallest hash of their id, and a stretch
of at most ``STRETCH`` signs of each, from a place that the hash gives; of rows that repeat an id, the one with the
smallest stretch. So much goes to the one task that trains, whatever the tables hold. With no language to learn, every
row is ``und``.

``word_labels`` gives the language of every word, for code-switched text; ``predict`` that of each document, ``keep``
the documents whose words are labelled with confidence.

``und`` with score 0 stands for a null text or one without a letter. Very long texts are labelled whole: marginals of
all words of a batch come from one pass over blocks, exact whatever the length; scores are rounded to nine decimals, so
that they don't depend on what stands in the same batch. Rows that repeat a doc_id are labelled each by its own text;
ties go to the first language in alphabetical order; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rampart.llm import kernels as K
from rampart.llm.quality import held_out

BITS, SAMPLE, STRETCH, LEXICON = 15, 300, 4000, 300
STEPS, BATCH, LONG, RATE, DECAY, DECIMALS = 60, 256, 48, 0.5, 1e-5, 9
FAMILIES = 9  # prefixes of 1 to 3, suffixes of 1 to 3, n-grams of 2 to 4
BLOCK = 128
CHUNK = 1 << 19  # bytes of text whose features are in memory at once

_APART = np.ones(256, dtype=bool)
_APART[128:] = False
_APART[[*range(65, 91), *range(97, 123)]] = False


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of the words [s, e)."""
    p, n, low = K.prefix_hash(data.astype(K.U) + K.U(1)), e - s, K.U((1 << BITS) - 1)
    found, of = [], []
    number = np.arange(len(s))

    def add(family: int, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> None:
        found.append((K.span_hash(p, start, end) & low).astype(np.int64) + (family << BITS))
        of.append(word)

    for k in (1, 2, 3):
        w = number[n >= k]
        add(k - 1, s[w], s[w] + k, w)
        add(k + 2, e[w] - k, e[w], w)
    for k in (2, 3, 4):
        count = np.maximum(n - k + 1, 0)
        w = np.repeat(number, count)
        start = s[w] + np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        add(k + 4, start, start + k, w)
    if len(lexicon):
        h = K.span_hash(p, s, e)
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        w = number[lexicon[at] == h]
        found.append(at[w] + (FAMILIES << BITS))
        of.append(w)
    return np.concatenate(found), np.concatenate(of)


class Model:
    """Languages, lexicon, feature weights, start and transition weights."""

    def __init__(self, langs: list[str], lexicon: np.ndarray, weights: np.ndarray, start: np.ndarray, step: np.ndarray) -> None:
        self.langs, self.lexicon, self.weights, self.start, self.step = langs, lexicon, weights, start, step

    def emissions(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Scores (words, languages); equal words are looked up once."""
        h = K.word_hashes(data, s, e)
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        feature, word = features(data, s[one], e[one], self.lexicon)
        out = np.stack([np.bincount(word, self.weights[feature, k], len(one)) for k in range(len(self.langs))], axis=1)
        return out[back]

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward-backward over all rows at once: a row's first word forgets what stands before it."""
        n, k = scores.shape
        own = np.exp(scores - scores.max(axis=1, keepdims=True))
        size = -(-n // BLOCK)
        own = np.concatenate([own, np.ones((size * BLOCK - n, k))]).reshape(size, BLOCK, k)
        fresh = np.zeros(size * BLOCK, bool)
        fresh[first[:-1][np.diff(first) > 0]] = True
        fresh[n:] = True  # the padding tells the last row nothing
        fresh = fresh.reshape(size, BLOCK)
        start, step = np.exp(self.start - self.start.max()), np.exp(self.step - self.step.max())
        product = np.broadcast_to(np.eye(k), (size, k, k)).copy()
        for t in range(BLOCK):
            new = product @ step
            if fresh[:, t].any():
                new = np.where(fresh[:, t, None, None], product.sum(axis=2, keepdims=True) * start, new)
            product = new * own[:, t, None, :]
            product /= product.max(axis=(1, 2), keepdims=True)
        enter, leave = np.empty((size, k)), np.empty((size, k))
        v = np.ones(k)
        for b in range(size):
            enter[b] = v
            v = v @ product[b]
            v = v / v.sum()
        v = np.ones(k)
        for b in range(size - 1, -1, -1):
            leave[b] = v
            v = product[b] @ v
            v = v / v.sum()
        ahead = np.empty_like(own)
        v = enter
        for t in range(BLOCK):
            v = np.where(fresh[:, t, None], v.sum(axis=1, keepdims=True) * start, v @ step) * own[:, t]
            v = v / v.sum(axis=1, keepdims=True)
            ahead[:, t] = v
        back, v = np.empty_like(own), leave
        for t in range(BLOCK - 1, -1, -1):
            back[:, t] = v
            w = own[:, t] * v
            v = np.where(fresh[:, t, None], (w * start).sum(axis=1, keepdims=True), w @ step.T)
            v = v / v.sum(axis=1, keepdims=True)
        both = (ahead * back).reshape(-1, k)[:n]
        return both / both.sum(axis=1, keepdims=True)


def train(texts: list[tuple[str, str]], seed: int = 8) -> Model | None:
    """A model from (language, text) pairs."""
    langs = sorted({lang for lang, _ in texts})
    column = pc.utf8_lower(pa.array([t for _, t in texts], pa.large_string()))
    data, at = K.raw(column)
    data, at = data[at[0] : at[-1]], at - at[0]
    s, e, first = K.words(data, at, _APART)
    if not len(s):
        return None
    label_of = np.array([langs.index(lang) for lang, _ in texts])
    h = K.word_hashes(data, s, e)
    hashes, one, word = np.unique(h, return_index=True, return_inverse=True)
    row = K.row_of(first)
    counts = np.stack([np.bincount(word[label_of[row] == k], minlength=len(hashes)) for k in range(len(langs))])
    common = np.unique(np.concatenate([np.argsort(-c, kind="stable")[:LEXICON][np.sort(-c, kind="stable")[:LEXICON] < 0] for c in counts]))
    lexicon = np.sort(hashes[common])
    feature, of = features(data, s[one], e[one], lexicon)
    order = np.argsort(of, kind="stable")
    feature, begin = feature[order], np.searchsorted(of[order], np.arange(len(one) + 1))
    rng, k = np.random.default_rng(seed), len(langs)
    by_lang = [np.flatnonzero((label_of == x) & (np.diff(first) > 0)) for x in range(k)]
    able = [x for x in range(k) if len(by_lang[x])]
    weights = np.zeros(((FAMILIES << BITS) + len(lexicon), k))
    start, step = np.zeros(k), np.zeros((k, k))
    squares = [np.full_like(w, 1e-4) for w in (weights, start, step)]
    for _ in range(STEPS):
        words, gold = np.zeros((BATCH, LONG), np.int64), np.zeros((BATCH, LONG), np.int64)
        for r in range(BATCH):
            at_, lang = 0, int(rng.choice(able))
            while at_ < LONG:
                doc = int(rng.choice(by_lang[lang]))
                n = min(int(rng.integers(4, LONG)), LONG - at_, int(first[doc + 1] - first[doc]))
                from_ = int(rng.integers(first[doc], first[doc + 1] - n + 1))
                words[r, at_ : at_ + n], gold[r, at_ : at_ + n] = word[from_ : from_ + n], lang
                at_ += n
                lang = int(rng.choice(able))
        flat = words.reshape(-1)
        n = begin[flat + 1] - begin[flat]
        pick = np.repeat(begin[flat] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        used, of_word = feature[pick], np.repeat(np.arange(len(flat)), n)
        score = np.stack([np.bincount(of_word, weights[used, x], len(flat)) for x in range(k)], axis=1).reshape(BATCH, LONG, k)
        a, z = np.empty_like(score), np.zeros_like(score)
        a[:, 0] = start + score[:, 0]
        for t in range(1, LONG):
            a[:, t] = np.logaddexp.reduce(a[:, t - 1, :, None] + step, axis=1) + score[:, t]
        for t in range(LONG - 2, -1, -1):
            z[:, t] = np.logaddexp.reduce(step + (score[:, t + 1] + z[:, t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(a[:, -1], axis=1)
        gap = np.exp(a + z - total[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + step + (score[:, 1:] + z[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1)
        gap -= np.eye(k)[gold]
        flat_gap = gap.reshape(-1, k)
        grad = np.stack([np.bincount(used, flat_gap[of_word, x], len(weights)) for x in range(k)], axis=1)
        for w, g, q in zip((weights, start, step), (grad, gap[:, 0].sum(axis=0), pair), squares, strict=True):
            g = g / BATCH + DECAY * w
            q += g * g
            w -= RATE * g / np.sqrt(q)
    return Model(langs, lexicon, weights, start, step)


def _trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of all rows (doc_id, lang, text) of the task."""
    rows = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    model = train([(lang, text) for _, lang, text in rows]) if rows else None
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(docs: DataFrame, sample: int = SAMPLE, stretch: int = STRETCH) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang); ``sample`` documents of each language are read, ``stretch`` signs of each."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL")
    # Hashes are spread evenly, so those below a bound by the language's number of rows hold the smallest ones. So few
    # rows of each language, some four times ``sample``, go on; the ids are broadcast.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    share = F.greatest(F.lit(4.0 * sample), F.lit(sample + 1000.0)) / F.col("size")
    low = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).join(F.broadcast(sizes), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < share)
    by = W.partitionBy("lang").orderBy("h", "doc_id")
    chosen = low.distinct().withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= sample).select("lang", "doc_id", "h")
    at = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - stretch)).cast("int")
    cut = F.substring(F.col("text"), at, F.lit(stretch))
    rows = known.where("text IS NOT NULL").join(F.broadcast(chosen), ["lang", "doc_id"]).select("doc_id", "lang", cut.alias("text"))
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    made = rows.repartition(1).mapInArrow(K.lean(_trained), "model binary").collect()  # one row
    return pickle.loads(made[0]["model"]) if made else None


def _marginals(column: pa.Array, model: Model) -> Iterator[tuple]:
    """(first row, each row's first byte, starts and ends of words in bytes, each row's first word, bytes, marginals) of groups of rows."""
    for r0, _, data, at in K.chunks(column, lower=True, size=CHUNK):
        s, e, first = K.words(data, at, _APART)
        if len(s):
            yield r0, at, s, e, first, data, model.marginals(model.emissions(data, s, e), first)


def label(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and confidence of each text: the mean marginal of the language, and the mean of every word's largest one."""
    langs, scores, sure = ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column))
    for r0, _, s, e, first, data, marginal in _marginals(column, model):
        n = np.diff(first)
        some = np.flatnonzero(n)
        mean = np.round(np.add.reduceat(marginal, first[some], axis=0) / n[some][:, None], DECIMALS)
        best, most = mean.argmax(axis=1), np.round(np.add.reduceat(marginal.max(axis=1), first[some]) / n[some], DECIMALS)
        ascii_ = np.concatenate([[0], np.cumsum(data < 128)])
        for k, r in enumerate(some.tolist()):
            a, b = first[r], first[r + 1]
            plain = ascii_[e[a:b]] - ascii_[s[a:b]]
            if plain.any() or any(map(str.isalpha, column[r0 + r].as_py())):
                langs[r0 + r], scores[r0 + r], sure[r0 + r] = model.langs[best[k]], min(1.0, max(0.0, float(mean[k, best[k]]))), min(1.0, float(most[k]))
    return langs, scores, sure


def _labelled(model: Model | None, column: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = label(batch.column(column), model) if model else (["und"] * batch.num_rows, np.zeros(batch.num_rows), None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return run


_WORDS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("p", pa.float64())]))


def word_labels(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``word_langs``: for each word of the lower-cased text its start and end (code points,
    end exclusive), language and marginal. Null for null texts, empty without words or model."""
    df = df.drop("word_langs")
    column = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            found: list[list | None] = [[] if valid else None for valid in texts.is_valid().to_pylist()]
            for r0, at, s, e, first, data, marginal in _marginals(texts, model) if model else ():
                signs = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                best = marginal.argmax(axis=1)
                p = np.round(marginal[np.arange(len(best)), best], DECIMALS)
                for r in np.flatnonzero(np.diff(first)).tolist():
                    a, b = first[r], first[r + 1]
                    base = signs[at[r]]
                    found[r0 + r] = [{"start": int(x), "end": int(y), "lang": model.langs[k], "p": float(z)} for x, y, k, z in zip(signs[s[a:b]] - base, signs[e[a:b]] - base, best[a:b], p[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _WORDS)], names=[*batch.schema.names, "word_langs"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "word_langs array<struct<start:bigint,end:bigint,lang:string,p:double>>"])
    return df.mapInArrow(K.lean(run), schema)


def keep(df: DataFrame, model: Model | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` that have a language, with a confidence of ``least`` or more, whatever the share of one
    language in the text; the columns stay as they are."""
    column = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model and batch.num_rows:
                langs, _, sure = label(batch.column(column), model)
                yield batch.filter(pa.array([lang != "und" and x >= least for lang, x in zip(langs, sure, strict=True)], pa.bool_()))

    return df.mapInArrow(K.lean(run), df.schema)


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``lang_pred`` and ``lang_score``, which take the place of columns of these names.
    The model's size doesn't depend on the data."""
    df = df.drop("lang_pred", "lang_score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "lang_pred string, lang_score double"])
    return df.mapInArrow(K.lean(_labelled(model, df.columns.index(text))), schema)


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()), sample)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
