"""Screening of a text column: results, exploded detections, audit rows and roll-ups, as lazy plans."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.functions import screen, spec, text
from rampart.functions.sqltext import written

_RAW, _NORM, _READ, _FOUND, _EVADES, _OUT = (f"_rampart_{x}" for x in ("raw", "norm", "read", "found", "evades", "out"))


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _is_screened(df: DataFrame, result: str) -> bool:
    """Whether the column is one of ``sanitize``; a user's own column of that name is not."""
    kind = next((f.dataType for f in df.schema.fields if f.name == result), None)
    return isinstance(kind, T.StructType) and kind.fieldNames() == spec.RESULT.fieldNames()


@cache
def _layers() -> str:
    """The detections of all layers as SQL text: parsed at once, where Columns are built call by call."""
    return written(screen.layers, _RAW, _NORM, _READ, _EVADES)


def _judged(df: DataFrame, raw: Column) -> DataFrame:
    """``df`` with the normalized text and what is found in it, and columns that led there."""
    norm = F.col(_NORM)
    # Each step has a projection of its own, so that what it makes is computed once however often the next refers to it.
    one = df.withColumn(_NORM, text.normalize_text(raw))
    two = one.withColumns({_RAW: raw, _EVADES: screen.evasion(raw), _READ: text.deleet_text(norm)})
    # One row for each, from a generator: a filter on what is found would else be moved below it, and make all of it again.
    return two.select("*", F.explode_outer(F.array(F.expr(_layers()))).alias(_FOUND))


def sanitize(df: DataFrame, text_col: str | Column = "text", source: str | Column | None = None, result: str = "result") -> DataFrame:
    """``df`` with a struct ``result`` of original_text, sanitized_text, detected_patterns, risk_score, content_hash,
    was_modified and source.

    Null text: null texts and hash, no detections, score 0, not modified. One narrow stage: no shuffle, no Python.
    """
    raw, label = _column(text_col), F.lit("") if source is None else _column(source)
    norm, found, out = map(F.col, (_NORM, _FOUND, _OUT))
    score = text.calculate_risk_score(found)
    four = _judged(df, raw).withColumn(_OUT, screen.output(raw, norm, found, screen.is_marked(found, score)))
    return four.withColumn(result, screen.result(raw, out, found, score, label)).drop(_RAW, _NORM, _READ, _FOUND, _EVADES, _OUT)


def detections(df: DataFrame, keys: list[str], text_col: str | Column = "text", result: str = "result") -> DataFrame:
    """One row for each detection: the keys, its place in the order of detection, layer, name, text, position, risk.

    ``df`` may be one of ``sanitize`` or not yet screened; then a column named as ``result`` gives way, unless it is a key.
    """
    if not _is_screened(df, result):
        result = "_rampart_result"
        df = sanitize(df, text_col, result=result)
    rows = df.select(*keys, F.posexplode(F.col(f"{result}.detected_patterns")).alias("ord", "d"))
    layer = F.when(F.startswith(F.col("d.pattern_name"), F.lit("leet:")), "leet").when(F.startswith(F.col("d.pattern_name"), F.lit("typoglycemia")), "fuzzy").otherwise("regex")
    return rows.select(*keys, "ord", layer.alias("layer"), "d.pattern_name", "d.matched_text", "d.position", "d.risk_level")


def audit(df: DataFrame, text_col: str | Column = "text", source: str | Column | None = None, result: str = "result") -> DataFrame:
    """One row for each text with a detection, as a trace hook would get it."""
    if _is_screened(df, result):
        r = F.col(result)
        kept, label, hashed, found, score, modified = df, *(r[c] for c in ("source", "content_hash", "detected_patterns", "risk_score", "was_modified"))
    else:  # without the sanitized text, which no row of the audit has
        raw, label, found = _column(text_col), F.lit("") if source is None else _column(source), F.col(_FOUND)
        kept, hashed, score = _judged(df, raw), text.content_hash(raw), text.calculate_risk_score(found)
        modified = screen.was_modified(raw, found, score)
    return kept.where(F.size(found) > 0).select(
        label.alias("source"),
        hashed.alias("content_hash"),
        F.lit(spec.DETECTION_LAYER).alias("detection_layer"),
        F.transform(found, lambda d: d["pattern_name"]).alias("patterns_detected"),
        score.alias("risk_score"),
        F.when(modified, "escaped").otherwise("logged").alias("action_taken"),
    )


def source_rollup(df: DataFrame, text_col: str = "text", source: str = "source") -> DataFrame:
    """Per source: texts, texts with detections, modified ones, and the highest score."""
    r = sanitize(df, text_col, source).select(F.col("result.source").alias("source"), F.size("result.detected_patterns").alias("n"), "result.was_modified", "result.risk_score")
    return r.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum((F.col("n") > 0).cast("bigint")).alias("detected"),
        F.sum(F.col("was_modified").cast("bigint")).alias("modified"),
        F.max("risk_score").alias("highest"),
    )
