"""A whole screening of one text as one Column, for SQL; plans take ``plans.sanitize``, which is the same in steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rampart.functions import fuzzy, match, spec, text
from rampart.functions.text import let


def layers(raw: Column, norm: Column, read: Column, evades: Column) -> Column:
    """Detections of all three layers, with their length gates; none in a null text."""
    size = F.length(raw)
    scrambled = F.when(size >= spec.FUZZY_MIN_LENGTH, fuzzy.fuzzy_detections(norm)).otherwise(match.no_detections())
    leet = F.when((size >= spec.LEET_MIN_LENGTH) | evades, match.leet_detections(norm, read)).otherwise(match.no_detections())
    return F.when(raw.isNull(), match.no_detections()).otherwise(F.concat(match.regex_detections(norm), leet, scrambled))


def is_marked(found: Column, score: Column) -> Column:
    return (score >= spec.MODIFICATION_THRESHOLD) & (F.size(found) > 0)


def output(raw: Column, norm: Column, found: Column, marked: Column) -> Column:
    return text.escape_data_tags(F.when(marked, text.annotate(norm, found)).otherwise(raw))


def result(raw: Column, out: Column, found: Column, score: Column, source: Column) -> Column:
    return F.struct(
        raw.alias("original_text"),
        out.alias("sanitized_text"),
        found.alias("detected_patterns"),
        score.alias("risk_score"),
        text.content_hash(raw).alias("content_hash"),
        was_modified(raw, found, score).alias("was_modified"),
        source.alias("source"),
    )


def was_modified(raw: Column, found: Column, score: Column) -> Column:
    return F.coalesce(is_marked(found, score) | (text.escape_data_tags(raw) != raw), F.lit(False))


def evasion(raw: Column) -> Column:
    return (F.length(raw) < spec.LEET_MIN_LENGTH) & text.has_evasion(raw)


def screened(raw: Column, source: Column) -> Column:
    """The struct of ``plans.sanitize`` for one text."""

    def of(norm: Column) -> Column:
        found = let(text.deleet_text(norm), lambda read: layers(raw, norm, read, evasion(raw)))
        return let(found, lambda f: result(raw, output(raw, norm, f, is_marked(f, text.calculate_risk_score(f))), f, text.calculate_risk_score(f), source))

    return let(text.normalize_text(raw), of)
