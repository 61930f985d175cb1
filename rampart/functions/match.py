"""Pattern detection: all matches of every pattern with their offsets, as arrays of detections."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from rampart.functions import spec
from rampart.functions.text import deleet_text, let, normalize_text, spaced


def no_detections() -> Column:
    return F.array().cast(spec_array())


def spec_array() -> str:
    return "array<struct<pattern_name:string,matched_text:string,position:int,risk_level:string>>"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _groups(words: tuple[str, ...]) -> list[tuple[str, tuple[str, ...]]]:
    """The words that no shorter one covers, under a part that several share: without the part none of them is there."""
    left = [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
    groups = []
    while left:
        parts: dict[str, list[str]] = {}
        for w in left:
            for p in {w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)} or {w}:
                parts.setdefault(p, []).append(w)
        part = max(sorted(parts), key=lambda p: (len(parts[p]), len(p)))
        own = tuple(parts[part])
        groups.append((part, own) if len(own) > 1 else (own[0], own))
        left = [w for w in left if w not in own]
    return groups


@cache
def _signals() -> str:
    """The signal words under their common parts, as an array literal."""
    return "array(" + ", ".join(f"named_struct('part', {quote(part)}, 'words', array({', '.join(map(quote, own))}))" for part, own in _groups(spec.SIGNAL_WORDS)) + ")"


def _begins(regex: str, most: int = 16) -> list[str]:
    """Literals of which every match begins with one, in text with a plain space for every run of white space: as long as
    the pattern fixes them and no more than ``most``."""

    def of(nodes: Iterable) -> list[tuple[str, bool]]:
        found = [("", False)]  # literal, whether it is at its end
        for op, arg in nodes:
            if op is C.LITERAL:
                tails = [(chr(arg), False)]
            elif op is C.IN and all(x is C.LITERAL for x, _ in arg):
                tails = [(chr(x), False) for _, x in arg]
            elif op is C.SUBPATTERN:
                tails = of(arg[-1])
            elif op is C.BRANCH:
                tails = [t for branch in arg[1] for t in of(branch)]
            elif op is C.MAX_REPEAT and arg[:2] == (0, 1):
                tails = [*of(arg[2]), ("", False)]
            elif op is C.MAX_REPEAT and arg[0] == 1 and list(arg[2]) == [(C.IN, [(C.CATEGORY, C.CATEGORY_SPACE)])]:
                tails = [(" ", False)]
            else:
                tails = [("", True)]
            longer = {f if f[1] else (f[0] + t[0], t[1]) for f in found for t in tails}
            if len(longer) > most and all(f[0] for f in found):
                return sorted({(f[0], True) for f in found})
            found = sorted(longer)
        return found

    found = {f[0] for f in of(_parser.parse(regex.lower()))}
    assert all(found), regex
    return sorted(f for f in found if not any(g != f and f.startswith(g) for g in found))


@cache
def _bank(prefix: str, promoted: bool) -> str:
    """The patterns as an array literal: one expression serves all of them, so plans stay small."""
    rows = (
        f"named_struct('ord', {i}, 'name', {quote(prefix + p.name)}, 'risk', {quote(spec.RISK_PROMOTED[p.risk] if promoted else p.risk)}, 'regex', {quote(spec.java(p.regex))}, 'needs', array({', '.join(map(quote, p.needs))}), 'begins', array({', '.join(map(quote, _begins(p.regex)))}))"
        for i, p in enumerate(spec.PATTERNS)
    )
    return "array(" + ", ".join(rows) + ")"


def has_signal(normalized: Column) -> Column:
    """Whether any signal word occurs. Without one, patterns are not looked for: this decides results, not only speed."""
    return F.exists(F.expr(_signals()), lambda g: F.contains(normalized, g["part"]) & F.exists(g["words"], lambda w: F.contains(normalized, w)))


def find_iter(text: Column, regex: str | Column) -> Column:
    """``array<struct<start, match>>`` of all matches from the left: offsets follow from the lengths of the gaps and matches."""
    return let(text, lambda t: _find_iter(t, F.lit(regex) if isinstance(regex, str) else regex))


def _find_iter(text: Column, regex: Column) -> Column:
    lengths = F.transform(F.split(text, regex, -1), lambda g: F.length(g))

    def found(gaps: Column) -> Column:
        def step(state: Column, m: Column) -> Column:
            start = state["end"] + F.element_at(gaps, F.size(state["found"]) + 1)
            return F.struct((start + F.length(m)).alias("end"), F.concat(state["found"], F.array(F.struct(start.alias("start"), m.alias("match")))).alias("found"))

        first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,match:string>>").alias("found"))
        return F.aggregate(F.regexp_extract_all(text, regex, F.lit(0)), first, step, lambda s: s["found"])

    return let(lengths, found)


def scan(text: Column, prefix: str = "", promoted: bool = False) -> Column:
    """Matches of the whole bank in folded text, by position, then in the bank's order."""
    return let(text, lambda t: _scan(t, prefix, promoted))


def _scan(text: Column, prefix: str, promoted: bool) -> Column:
    """Patterns are looked for only in texts with one of their literals and one of their beginnings, and from there on."""

    def squeezed(spaced_: Column) -> Column:
        dotted = F.when(F.contains(spaced_, F.lit("\u0131")), F.replace(spaced_, F.lit("\u0131"), F.lit("i"))).otherwise(spaced_)
        return let(dotted, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))

    def begun(flat: Column) -> Column:
        there = F.filter(F.expr(_bank(prefix, promoted)), lambda p: F.exists(p["needs"], lambda w: F.contains(text, w)) & F.exists(p["begins"], lambda w: F.contains(flat, w)))
        return let(there, lambda t: F.when(F.size(t) > 0, _matches(text, flat, t)).otherwise(no_detections()))

    return let(squeezed(spaced(text)), begun)


def _matches(text: Column, flat: Column, there: Column) -> Column:
    def first(p: Column) -> Column:
        """Where the first of the beginnings is, from 0; with longer white space, offsets of ``flat`` don't hold."""
        at = F.array_min(F.transform(F.filter(p["begins"], lambda w: F.contains(flat, w)), lambda w: F.instr(flat, w)))
        return F.when(F.length(flat) == F.length(text), at - 1).otherwise(0)

    def places(p: Column, skipped: Column) -> Column:
        return F.transform(
            find_iter(F.substring(text, skipped + 1, F.length(text)), p["regex"]),
            lambda m: F.struct((m["start"] + skipped).alias("position"), p["ord"].alias("ord"), p["name"].alias("pattern_name"), m["match"].alias("matched_text"), p["risk"].alias("risk_level")),
        )

    every = F.transform(there, lambda p: let(first(p), lambda skipped: places(p, skipped)))
    return F.transform(F.array_sort(F.flatten(every)), lambda d: F.struct(d["pattern_name"].alias("pattern_name"), d["matched_text"].alias("matched_text"), d["position"].alias("position"), d["risk_level"].alias("risk_level")))


def regex_detections(normalized: Column, use_prefilter: bool = True) -> Column:
    """Detections in normalized text."""
    if not use_prefilter:
        return scan(normalized)
    # The gate costs more than the scan, so it is asked only where there is something to hold back.
    return let(scan(normalized), lambda found: F.when((F.size(found) == 0) | has_signal(normalized), found).otherwise(no_detections()))


def novel(leet: Column, plain: Column) -> Column:
    """The leet detections whose pattern has no match at their position in the plain text."""
    key = F.transform(plain, lambda d: F.struct(F.concat(F.lit("leet:"), d["pattern_name"]).alias("name"), d["position"].alias("at")))
    return F.filter(leet, lambda d: ~F.array_contains(key, F.struct(d["pattern_name"].alias("name"), d["position"].alias("at"))))


def leet_detections(normalized: Column, read: Column) -> Column:
    """Detections only in ``read``, the text with leet characters read as letters; one level up. No prefilter on either text."""
    return F.when(
        read != normalized,
        let(scan(read, "leet:", True), lambda found: F.when(F.size(found) > 0, novel(found, scan(normalized))).otherwise(found)),
    ).otherwise(no_detections())


def detect_injection_patterns(text: Column, use_prefilter: bool = True) -> Column:
    return let(normalize_text(F.coalesce(text, F.lit(""))), lambda n: regex_detections(n, use_prefilter))


def detect_leet_injection(text: Column) -> Column:
    return let(normalize_text(F.coalesce(text, F.lit(""))), lambda n: let(deleet_text(n), lambda d: leet_detections(n, d)))
