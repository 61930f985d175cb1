"""The detection operators as joins, windows and aggregates over exploded rows.

They give the same rows as the array forms in ``rampart.functions`` and serve as building blocks for reports: a token
table joins the keyword table, phrases are windows over keyword marks, the leet layer is an anti-join, and scores are
sums. Keys may be any columns that tell the texts apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rampart.functions import fuzzy, match, spec, text


def patterns(spark: SparkSession) -> DataFrame:
    """The bank: ord, name, risk, lang."""
    rows = [(i, p.name, p.risk, "fr" if p.name.startswith("fr_") else "en") for i, p in enumerate(spec.PATTERNS)]
    return spark.createDataFrame(rows, "ord int, name string, risk string, lang string")


def keywords(spark: SparkSession) -> DataFrame:
    """keyword, first, last, most_edits: 24 rows, a fixed size."""
    return spark.createDataFrame([(k, k[0], k[-1], fuzzy.most_edits(k)) for k in spec.KEYWORDS], "keyword string, first string, last string, most_edits int")


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(spec.PHRASES)], "ord int, words array<string>")


def normalized(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    return df.select(*keys, text.normalize_text(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))


def token_table(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, idx, token, position of the scanned tokens, edges cleaned."""
    cut = normalized(df, keys, text_col).select(*keys, fuzzy.tokens(F.col("norm")).alias("t"))
    rows = cut.select(*keys, F.posexplode("t.words").alias("idx", "word"), F.col("t.from").alias("from"), F.col("t.base").alias("base"))
    # Positions start anew at the tail of a long text.
    tail = ((F.col("from") > 0) & (F.col("idx") >= F.col("from"))).alias("tail")
    rows = rows.select(*keys, "idx", "word", tail, "base")
    before = W.partitionBy(*keys, "tail").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    position = F.when(F.col("tail"), F.col("base")).otherwise(0) + F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    return rows.select(*keys, "idx", fuzzy.clean(F.col("word")).alias("token"), position.cast("int").alias("position"))


def keyword_marks(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Every token with the keyword that it is or scrambles, else null: an equi-join on first and last letter with the
    edit rules as residual; the keyword side is a constant of 24 rows and is broadcast."""
    tokens = token_table(df, keys, text_col)
    able = F.length("token").between(4, 15)
    first, last = F.when(able, F.substring("token", 1, 1)), F.when(able, F.expr("right(token, 1)"))
    k = F.broadcast(keywords(df.sparkSession))
    near = (F.abs(F.length("keyword") - F.length("token")) <= 1) & ((F.col("keyword") == F.col("token")) | ((fuzzy.multiset_difference(F.col("token"), F.col("keyword")) <= 1) & fuzzy.within(F.col("token"), F.col("keyword"))))
    joined = tokens.withColumns({"_first": first, "_last": last}).join(k, (F.col("_first") == F.col("first")) & (F.col("_last") == F.col("last")) & near, "left")
    return joined.select(*keys, "idx", "token", "position", "keyword")


def fuzzy_rows(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pattern_name, matched_text, position, risk_level of scrambled keywords and of phrases."""
    marks = keyword_marks(df, keys, text_col)
    single = marks.where("keyword != token").select(*keys, F.concat(F.lit("typoglycemia:"), "keyword").alias("pattern_name"), F.col("token").alias("matched_text"), "position")
    by = W.partitionBy(*keys).orderBy("idx")
    wide = marks.select("*", *(F.lead("keyword", i).over(by).alias(f"k{i}") for i in (1, 2)), *(F.lead("token", i).over(by).alias(f"t{i}") for i in (1, 2)))
    found = [single]
    for words in spec.PHRASES:
        if set(words) <= set(spec.KEYWORDS):
            hit = reduce(lambda a, b: a & b, (F.col(c) == w for c, w in zip(("keyword", "k1", "k2"), words, strict=False)))
            shown = F.concat_ws(" ", *(F.col(c) for c in ("token", "t1", "t2")[: len(words)]))
            found.append(wide.where(hit).select(*keys, F.lit("typoglycemia_phrase:" + "_".join(words)).alias("pattern_name"), shown.alias("matched_text"), "position"))
    return reduce(DataFrame.unionByName, found).withColumn("risk_level", F.lit("high"))


def _exploded(df: DataFrame, keys: list[str], found: str) -> DataFrame:
    # The outer form: of the plain one Spark infers a filter on the array, and makes the array a second time for it.
    return df.select(*keys, F.posexplode_outer(found).alias("ord", "d")).where("d is not null").select(*keys, "ord", "d.*")


def regex_rows(df: DataFrame, keys: list[str], text_col: str = "text", use_prefilter: bool = True) -> DataFrame:
    """keys, ord, pattern_name, matched_text, position, risk_level of the pattern layer."""
    n = normalized(df, keys, text_col)
    return _exploded(n.select(*keys, match.regex_detections(F.col("norm"), use_prefilter).alias("found")), keys, "found")


def leet_rows(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The leet layer as an anti-join: matches in the text with leet read as letters, less those of the plain text.

    Texts are read and scanned once, for both sides; then the rows of a key, pattern and position meet. As in a join, a
    null key equals none.
    """

    def both(read: Column) -> Column:
        side = lambda found, name, plain: F.transform(found, lambda d: F.struct(name(d).alias("pattern_name"), d["matched_text"].alias("matched_text"), d["position"].alias("position"), d["risk_level"].alias("risk_level"), F.lit(plain).alias("plain")))
        leet = side(match.scan(read, "leet:", True), lambda d: d["pattern_name"], False)
        return F.when(read != F.col("norm"), F.concat(leet, side(match.scan(F.col("norm")), lambda d: F.concat(F.lit("leet:"), d["pattern_name"]), True)))

    n = normalized(df, keys, text_col)
    rows = _exploded(n.select(*keys, text.let(text.deleet_text(F.col("norm")), both).alias("found")), keys, "found")
    known = F.max("plain").over(W.partitionBy(*keys, "pattern_name", "position"))
    unequal = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    left = rows.withColumn("known", known).where(~F.col("plain") & (~F.col("known") | unequal))
    return left.select(*keys, "pattern_name", "matched_text", "position", "risk_level")


def scores(detections: DataFrame, keys: list[str]) -> DataFrame:
    """risk_score by key, from exploded detections."""
    total = F.sum(text.risk_weight(F.col("risk_level")))
    return detections.groupBy(*keys).agg(F.least(total / F.lit(100.0), F.lit(1.0)).alias("risk_score"))
