"""Text operators as Column to Column functions. Null gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rampart.functions import spec

_FROM = "".join(spec.HOMOGLYPHS) + spec.ZERO_WIDTH  # what has no counterpart in _TO goes
_TO = "".join(spec.HOMOGLYPHS.values())
#: All that _FROM may hold: what is beyond Latin-1, and the soft hyphen.
_BEYOND_LATIN = r"[^\x00-\xac\xae-\xff]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _java(class_name: str, method: str, *args: Column) -> Column:
    return F.reflect(F.lit(class_name), F.lit(method), *args)


def normalize_text(text: Column) -> Column:
    """Compatibility composition, look-alikes folded, zero-width characters removed, full case folding."""
    composed = _java("com.ibm.icu.text.Normalizer", "compose", text, F.lit(True))
    # ASCII text only needs lower case, and text of Latin letters nothing of the translation, which goes sign by sign.
    plain = let(composed, lambda t: F.when(t.rlike(_BEYOND_LATIN), F.translate(t, _FROM, _TO)).otherwise(t))
    folded = _java("com.ibm.icu.lang.UCharacter", "foldCase", plain, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).when(text.isNotNull(), folded)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


_MIXED = rf"[a-zA-Z][^{{0}}]*{spec.LEET_CLASS}|{spec.LEET_CLASS}[^{{0}}]*[a-zA-Z]"


def has_mixed_token(text: Column, space: str = spec.SPACE) -> Column:
    """Whether a token holds both an ASCII letter and a leet character."""
    return text.rlike(spec.LEET_CLASS) & text.rlike(_MIXED.replace("{0}", space))


_SPACES = "array(" + ", ".join(f"'\\u{ord(c):04x}'" for c in spec.SPACES) + ")"


def spaced(normalized: Column) -> Column:
    """Every sign of white space as a plain space; offsets stay."""
    return F.aggregate(F.expr(_SPACES), normalized, lambda t, c: F.when(F.contains(t, c), F.replace(t, c, F.lit(" "))).otherwise(t))


#: A whole token that mixes both, looked at from its start only.
_MIXED_TOKEN = rf"(?<![^{spec.SPACE}])(?=[^{spec.SPACE}a-zA-Z]*+[a-zA-Z])(?=[^{spec.SPACE}{spec.LEET_CLASS[1:-1]}]*+{spec.LEET_CLASS})[^{spec.SPACE}]++"
_LEET_SIGN = "[" + "".join(spec.LEET) + "269]"


def deleet_text(normalized: Column) -> Column:
    """Leet characters read as letters in the tokens that mix both; the length stays."""
    letters = lambda gap, t: F.concat(gap, F.coalesce(F.translate(t, "".join(spec.LEET), "".join(spec.LEET.values())), F.lit("")))
    joined = lambda part, mixed: F.array_join(F.zip_with(F.split(part, _MIXED_TOKEN, -1), mixed, letters), "")

    def read(part: Column) -> Column:
        return let(F.regexp_extract_all(part, F.lit(_MIXED_TOKEN), F.lit(0)), lambda mixed: F.when(F.size(mixed) > 0, joined(part, mixed)).otherwise(part))

    # Cutting at plain spaces takes no regular expression; the one for tokens, which does more at every sign, sees the few parts with a leet character.
    parts = F.transform(F.split(normalized, " ", -1), lambda part: F.when(part.rlike(_LEET_SIGN), read(part)).otherwise(part))
    return F.when(normalized.rlike(_LEET_SIGN), F.array_join(parts, " ")).otherwise(normalized)


def has_evasion(text: Column) -> Column:
    """Whether raw text has look-alikes or a token that mixes letters and leet characters."""
    return text.rlike("[" + "".join(spec.HOMOGLYPHS) + "]") | has_mixed_token(text, spec.RAW_SPACE)


def escape_data_tags(text: Column) -> Column:
    """The data boundary's own tags as entities; other markup stays."""
    closed = F.regexp_replace(text, spec.DATA_TAG_CLOSE, spec.DATA_TAG_CLOSE_ESCAPED)
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(closed, spec.DATA_TAG_OPEN, spec.DATA_TAG_OPEN_ESCAPED)).otherwise(text)


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def wrap_in_data_tags(text: Column, source: Column) -> Column:
    return F.concat(F.lit('<data-content source="'), escape_html(source), F.lit('">\n'), escape_data_tags(text), F.lit("\n</data-content>"))


def strip_sanitization_markers(text: Column) -> Column:
    """One pass from the left; what marked spans hold stays."""
    return F.when(F.contains(text, F.lit(spec.MARK_GUARD)), F.regexp_replace(text, spec.MARK_REGEX, "$1")).otherwise(text)


def _weight(level: Column) -> Column:
    weight = F.lit(spec.UNKNOWN_WEIGHT)
    for name, value in spec.RISK_WEIGHTS.items():
        weight = F.when(level == name, value).otherwise(weight)
    return weight


def calculate_risk_score(detections: Column) -> Column:
    """Sum of the weights of all detections, at most 1; exact, since it adds hundredths."""
    total = F.aggregate(detections, F.lit(0), lambda a, d: a + _weight(d["risk_level"]))
    return F.when(detections.isNull(), 0.0).otherwise(F.least(total / F.lit(100.0), F.lit(1.0)))


def risk_weight(level: Column) -> Column:
    """Hundredths of one detection, for exploded detections."""
    return _weight(level)


def annotate(normalized: Column, detections: Column) -> Column:
    """Marks around every detection, from the last position to the first, each cut from the text as it is by then."""
    numbered = F.transform(detections, lambda d, i: F.struct((-d["position"]).alias("at"), i.alias("nth"), d["pattern_name"].alias("name"), F.length(d["matched_text"]).alias("n")))

    def put(text: Column, d: Column) -> Column:
        start = -d["at"]
        return F.concat(
            F.substring(text, F.lit(1), start),
            F.lit(spec.MARK_OPEN),
            d["name"],
            F.lit("]"),
            F.substring(text, start + 1, d["n"]),
            F.lit(spec.MARK_CLOSE),
            F.substring(text, start + d["n"] + 1, F.length(text)),
        )

    return F.aggregate(F.array_sort(numbered), normalized, put)
