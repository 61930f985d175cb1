"""Benchmark items in documents, also with other numbers, names and units, by template canonicalisation.

A text's tokens are its runs of letters and digits; the parts of a number with separators (1,200 or 3.50) and the words of
a name inside a sentence (Mary Ann) are one token. Canonicalisation keeps the order: a token that starts with a digit
becomes a number slot, a unit right after one a unit slot, a capitalised token inside a sentence a name slot; the others
are lower-cased. Windows of eight canonical tokens with at most three slots are hashed and joined between documents and
benchmark. Hits of one document and item at one distance form an alignment. It counts if it covers half of the item, or
25 tokens of it, and its slots are consistent: wherever the item repeats a value, the document repeats the value that it
has in its place.

Items that such windows can't represent, those of fewer than eight tokens or with a window of more slots, are joined by
windows of their plain lower-cased words besides, an item of fewer than eight words by all of them at once.

Everything is built-in DataFrame functions. The benchmark's windows are broadcast up to a counted number of rows of fixed
size, and shuffled beyond, from files, so that Spark splits large partitions; the same holds for the rows of documents
whose slots are to be read.

Null texts and texts without tokens match nothing, nor do rows with a null id. Very long texts are read whole. Rows that
repeat a doc_id are judged each by its own text, and reported once for each; so are items that repeat an item_id. Of
alignments of one document and item, the one that covers most counts, in a tie the one of more tokens. Empty tables give
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm import storage

WINDOW, SLOTS, SHARE, ENOUGH = 8, 3, 0.5, 25
# Units that turn into a slot after a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yd yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph percent degree degrees dollar dollars euro euros cent cents"
).split()
_APART = r"[^\p{L}\p{N}]+"
NUMBER, UNIT, NAME = "0n", "0u", "0p"  # no token can look so: digits never stay
JOINER = "\u02b9"  # a letter by its class; it stands between the parts of one token
_LEAD = r"(?<=[\p{L}\p{N}] .|[\p{L}\p{N}][,;:] .)"  # what was read last opens a word inside a sentence


def joined(text: Column) -> Column:
    """The text with the parts of numbers and of names inside a sentence put together."""
    numbers = F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", JOINER)
    return F.regexp_replace(numbers, rf"(\p{{Lu}}{_LEAD}[\p{{L}}\p{{N}}]*) (?=\p{{Lu}})", f"$1{JOINER}")


def canonical(text: Column) -> Column:
    """Joined text with slots in place of numbers, units and names, lower-cased, with as many tokens as before."""
    numbers = F.regexp_replace(text, r"\d(?<![\p{L}\p{N}]\d)[\p{L}\p{N}]*", NUMBER)
    units = F.regexp_replace(numbers, rf"(?i){NUMBER}([^\p{{L}}\p{{N}}]{{1,2}})(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")
    names = F.regexp_replace(units, rf"\p{{Lu}}{_LEAD}[\p{{L}}\p{{N}}]*", NAME)
    return F.lower(names)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, _APART), "")


def _windows(words: Column, size: int = WINDOW, *tag: Column) -> Column:
    """Hashes of all windows, in order."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(*tag, F.slice(words, i, size))))


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row, item, exact, shift, places, covered, n: tokens covered of the item's n, before slots are checked."""
    items = benchmark.select("item", "text").withColumn("whole", joined(F.col("text"))).select("item", tokens(canonical(F.col("whole"))).alias("words"), tokens(F.lower("text")).alias("raw"))
    slots = F.transform(F.col("words"), lambda w: w.isin(NUMBER, UNIT, NAME).cast("int"))
    count = lambda i: F.aggregate(F.slice("slots", i, WINDOW), F.lit(0), lambda a, x: a + x)
    items = items.withColumns({"n": F.size("words"), "slots": slots, "n_raw": F.size("raw")})
    items = items.withColumn("over", F.when(F.col("n") >= WINDOW, F.exists(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: count(i) > SLOTS)).otherwise(F.lit(True)))
    label = F.lit("exact")  # sets hashes of lower-cased words apart from those of canonical tokens
    usable = items.select("item", "n", "slots", F.posexplode(_windows(F.col("words"))).alias("at", "window")).where(count(F.col("at") + 1) <= SLOTS)
    asked = usable.select("window", "item", F.lit(False).alias("exact"), "n", F.col("at").alias("item_at"))
    plain = items.where("over AND n_raw > 0")
    full = plain.select("item", "n_raw", F.posexplode(_windows(F.col("raw"), WINDOW, label)).alias("at", "window"))
    short = plain.where(F.col("n_raw") < WINDOW).select(F.xxhash64(label, "raw").alias("window"), "item", "n_raw", F.lit(0).alias("at"))
    asked = asked.unionByName(full.unionByName(short).select("window", "item", F.lit(True).alias("exact"), F.col("n_raw").alias("n"), F.col("at").alias("item_at")))
    asked = storage.placed(asked.distinct(), "asked")
    sizes = [r.n for r in asked.where("exact").select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()]  # eight numbers at most
    words = docs.select("doc_id", "row", tokens(canonical(joined(F.col("text")))).alias("words"))
    hits = words.select("doc_id", "row", F.posexplode(_windows(F.col("words"))).alias("at", "window"))
    for size in sizes:
        words = docs.select("doc_id", "row", tokens(F.lower("text")).alias("words"))
        hits = hits.unionByName(words.select("doc_id", "row", F.posexplode(_windows(F.col("words"), size, label)).alias("at", "window")))
    hits = hits.join(asked, "window")
    places = F.array_sort(F.collect_set("item_at"))
    # Each hit covers its window; neighbouring ones overlap.
    found = hits.groupBy("doc_id", "row", "item", "exact", "n", (F.col("at") - F.col("item_at")).alias("shift")).agg(places.alias("places"))
    gaps = F.transform(F.sequence(F.lit(2), F.size("places")), lambda i: F.least(F.element_at("places", i) - F.element_at("places", i - 1), F.lit(WINDOW)))
    covered = F.least(F.lit(WINDOW), F.col("n")) + F.when(F.size("places") > 1, F.aggregate(gaps, F.lit(0), lambda a, g: a + g)).otherwise(0)
    return found.withColumn("covered", covered).where((F.col("covered") >= SHARE * F.col("n")) | (F.col("covered") >= ENOUGH))


def _slots_agree(places: Column) -> Column:
    """Whether equal values of the item's slots have equal values in the document, over the covered tokens."""
    inside = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p + 1, F.least(p + WINDOW, F.col("n"))))))
    open_ = F.filter(inside, lambda i: F.element_at("item_words", i).isin(NUMBER, UNIT, NAME))
    pairs = F.array_distinct(F.transform(open_, lambda i: F.struct(F.element_at("item_values", i).alias("item"), F.element_at("doc_values", i + F.col("shift").cast("int")).alias("doc"))))
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"])))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that match: ``doc_id, row, item_id, covered, n_tokens``, the best alignment's."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("row", F.xxhash64("text"))
    bench = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    bench = bench.withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"])
    found = storage.materialize(alignments(known, bench), "alignments")
    # Equal words need no look at their slots.
    same = found.where("exact").select("doc_id", "row", "item", "covered", "n")
    open_ = found.where("NOT exact")
    wanted = storage.placed(open_.select(F.xxhash64("doc_id").alias("wanted_id"), F.col("row").alias("wanted")).distinct(), "wanted")
    whole = joined(F.col("text"))
    values = known.join(wanted, (F.xxhash64("doc_id") == F.col("wanted_id")) & (F.col("row") == F.col("wanted")), "left_semi")
    values = values.select("doc_id", "row", tokens(F.lower(whole)).alias("doc_values")).groupBy("doc_id", "row").agg(F.any_value("doc_values").alias("doc_values"))
    sides = bench.select("item", tokens(canonical(whole)).alias("item_words"), tokens(F.lower(whole)).alias("item_values"))
    both = open_.join(values, ["doc_id", "row"]).join(sides, "item")
    agreed = both.where(_slots_agree(F.col("places"))).select("doc_id", "row", "item", "covered", "n").unionByName(same)
    best = agreed.groupBy("doc_id", "row", "item").agg(F.max(F.struct("covered", "n")).alias("best"))
    return best.join(bench.select("item", "item_id"), "item").groupBy("doc_id", "row", "item_id").agg(F.max("best").alias("best")).select("doc_id", "row", "item_id", F.col("best.covered").cast("bigint").alias("covered"), F.col("best.n").cast("bigint").alias("n_tokens"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered, n_tokens of every match."""
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "n_tokens")).alias("best")).select("doc_id", "item_id", "best.covered", "best.n_tokens")


def remove(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item; rows with a null id or text stay."""
    found = matches(docs, benchmark, doc_id, text).select(F.xxhash64("doc_id").alias("_rampart_id"), F.col("row").alias("_rampart_row")).distinct()
    found = storage.placed(found, "matched")
    return docs.join(found, (F.xxhash64(F.col(doc_id)) == F.col("_rampart_id")) & (F.xxhash64(F.col(text)) == F.col("_rampart_row")), "left_anti")
