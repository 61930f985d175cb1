"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, scheme marks, colons, plus signs, digits, the fixed openings of
keys and country codes, and cue words. At each anchor a parser that knows one kind walks to the left and right over the
characters of that kind, never further than the run of such characters or a fixed number of words, and checks what it
found. No other part of the text is looked at.

Base kinds (fixed patterns): ``email`` ``ip`` ``card`` ``phone``. The method adds ``url`` ``ipv6`` ``iban`` ``ssn``
``account`` ``secret`` and ``street``. Spans are code points, end exclusive, leftmost and non-overlapping per kind.

Null text counts as empty and has no spans; very long texts are scanned in full; repeated rows give repeated results, and
null ids stay null; an empty table gives an empty result; where two anchors give one kind the same span, it counts once;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm import kernels as K

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "ipv6", "iban", "ssn", "account", "secret", "street")

# The patterns of the base kinds.
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = "0123456789"
_IP_RUN = re.compile(r"[0-9.]+")
_URL_TAIL = re.compile(r"://[^\s<>\"'`{}|\\^\[\]]+")
_HOST_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:[:/?#][^\s<>\"'`{}|\\^\[\]]*)?")
_V6_RUN = frozenset("0123456789abcdefABCDEF:.")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?:\s?(?:number|num|no|nr|n\u00ba|id)\b\.?)?\s{0,2}[:=#]?\s{0,2}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.IGNORECASE)
_ASSIGNED = r"[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?"
_SECRET = re.compile(_ASSIGNED + r"([A-Za-z0-9_/+=.~-]{16,})")
_PASSWORD = re.compile(_ASSIGNED + r"([^\s\"'<>,;]{6,})")
_BEARER = re.compile(r"\s{1,3}([A-Za-z0-9_/+=.~-]{16,})")
_KEY_TAIL = re.compile(r"[A-Za-z0-9_-]+")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?")
# Cue words of secrets, of passwords and of account numbers.
SECRET_CUES = ("token", "secret", "api_key", "apikey", "api-key", "api key", "access_key", "access-key", "private_key", "auth_key", "credential", "credentials")
PASSWORD_CUES = ("password", "passwd", "pwd", "passphrase", "passwort", "contrase\u00f1a", "mot de passe")
ACCOUNT_CUES = ("account", "acct", "routing", "konto", "kontonummer", "cuenta", "compte")
# Openings of keys, and the least and greatest number of signs after them.
KEY_OPENINGS = {
    "ghp_": (30, 255), "gho_": (30, 255), "ghu_": (30, 255), "ghs_": (30, 255), "ghr_": (30, 255), "github_pat_": (20, 255), "glpat-": (16, 64),
    "AKIA": (16, 16), "ASIA": (16, 16), "AIza": (35, 35), "sk-": (20, 200), "sk_live_": (16, 200), "sk_test_": (16, 200), "rk_live_": (16, 200), "pk_live_": (16, 200),
    "xoxb-": (10, 200), "xoxp-": (10, 200), "xoxa-": (10, 200), "xoxr-": (10, 200), "npm_": (30, 64), "hf_": (30, 64),
}
# Signs of an IBAN by country.
IBAN_SIGNS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# Words that close or open the name of a street.
STREET_AFTER = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Court", "Square", "Terrace", "Crescent", " Ave", " Blvd", " Rd", " St.")
STREET_JOINED = ("stra\u00dfe", "strasse")
STREET_BEFORE = (" rue ", " avenue ", " boulevard ", " place ", "Calle ", "calle ", "Avenida ", "avenida ", "Plaza ")
_NAME = r"[^\W\d_][\w'\u2019.-]*"
_HOUSE_BEFORE = re.compile(rf"(?<![\w.,-])[0-9]{{1,5}}[A-Za-z]?,? (?:{_NAME} ){{0,4}}\Z")
_HOUSE_AFTER = re.compile(rf" [0-9]{{1,5}}[A-Za-z]?(?![\w.,-]*[0-9])")
_NAMED = re.compile(rf"(?:{_NAME} ){{0,4}}{_NAME},? (?:n\u00ba ?)?[0-9]{{1,5}}(?![0-9.,]*[0-9])")
_FRENCH = re.compile(r"(?<![\w.,-])[0-9]{1,5}(?: ?(?:bis|ter))?,?\Z")
_FRENCH_NAME = re.compile(rf"(?:(?:de|du|des|la|le|les|l'|d') ?){{0,3}}[^\W\d_a-z][\w'\u2019-]*(?: [^\W\d_a-z][\w'\u2019-]*){{0,3}}")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) == IBAN_SIGNS.get(s[:2]) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


Span = tuple[int, int]


def _email(text: str, at: int, last: int) -> tuple[Span | None, int]:
    start = at
    while start > last and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or not (m := _EMAIL_DOMAIN.match(text, at)):
        return None, last
    return (start, m.end()), m.end()


def _ip(text: str, at: int, last: int) -> tuple[list[Span], int]:
    """All addresses of the run of digits and dots at ``at``; the run's end."""
    run = _IP_RUN.match(text, at)
    found = []
    for m in _IP.finditer(text, at, run.end()):
        if all(len(v := x.lstrip("0")) < 4 and int(v or 0) <= 255 for x in m.group().split(".")):
            found.append(m.span())
    return found, run.end()


def _card(text: str, at: int, last: int) -> tuple[Span | None, int]:
    m = _CARD.match(text, at)
    if not m:
        return None, at + 1
    digits = m.group().replace(" ", "").replace("-", "")
    return (m.span() if 13 <= len(digits) <= 19 and luhn(digits) else None), m.end()


def _phone(text: str, at: int, last: int) -> tuple[Span | None, int]:
    m = _PHONE.match(text, at)
    if not m:
        return None, last
    return (m.span() if 9 <= sum(c in _DIGITS for c in m.group()) <= 15 else None), m.end()


def _url(text: str, at: int, last: int) -> tuple[Span | None, int]:
    start = at
    while start > last and text[start - 1] in _SCHEME:
        start -= 1
    m = _URL_TAIL.match(text, at)
    if not m or start == at or not text[start].isalpha():
        return None, last
    end = m.end()
    while end > at + 4 and text[end - 1] in ".,;:!?)":
        end -= 1
    return (start, end), end


def _www(text: str, at: int, last: int) -> tuple[Span | None, int]:
    """A host name that opens with www. and has no scheme."""
    m = _HOST_TAIL.match(text, at)
    if at < last or not m or (at and (text[at - 1].isalnum() or text[at - 1] in "./@-_")):
        return None, last
    end = m.end()
    while text[end - 1] in ".,;:!?)":
        end -= 1
    return (at, end), end


def _ipv6(text: str, at: int, last: int) -> tuple[Span | None, int]:
    start = end = at
    while start > last and text[start - 1] in _V6_RUN and at - start < 40:
        start -= 1
    while end < len(text) and text[end] in _V6_RUN and end - at < 40:
        end += 1
    past = max(end, last)
    if text[end - 1] == "." or (text[end - 1] == ":" and text[end - 2] != ":"):
        end -= 1
    run = text[start:end]
    if run.count(":") < 2 or len(run) < 4 or not any(c in _DIGITS for c in run) or (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return None, past
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return None, past
    return (start, end), past


def _iban(text: str, at: int, last: int) -> tuple[Span | None, int]:
    if at and text[at - 1].isalnum():
        return None, last
    left, k = IBAN_SIGNS[text[at : at + 2]], at
    while left and k < len(text):
        c = text[k]
        if c.isascii() and (c.isdigit() or c.isupper()):
            left -= 1
        elif c != " " or text[k - 1] == " ":
            break
        k += 1
    if left or (k < len(text) and text[k].isalnum()) or not iban_ok(text[at:k]):
        return None, last
    return (at, k), k


def _ssn(text: str, at: int, last: int) -> tuple[Span | None, int]:
    m = _SSN.match(text, at)
    return (m.span(), m.end()) if m and not (at and (text[at - 1].isalnum() or text[at - 1] == "-")) else (None, last)


def _account(text: str, after: int, last: int) -> tuple[Span | None, int]:
    m = _ACCOUNT.match(text, after)
    return (m.span(1), m.end()) if m else (None, last)


def _mixed(value: str) -> bool:
    return any(c in _DIGITS for c in value) and any(c.isalpha() for c in value)


def _secret(text: str, after: int, last: int) -> tuple[Span | None, int]:
    m = _SECRET.match(text, after)
    return (m.span(1), m.end()) if m and _mixed(m[1]) else (None, last)


def _password(text: str, after: int, last: int) -> tuple[Span | None, int]:
    m = _PASSWORD.match(text, after)
    value = m[1].rstrip(".,;:!?)") if m else ""
    return ((m.start(1), m.start(1) + len(value)), m.end()) if len(value) > 5 and any(not c.isalpha() for c in value) else (None, last)


def _bearer(text: str, after: int, last: int) -> tuple[Span | None, int]:
    m = _BEARER.match(text, after)
    return (m.span(1), m.end()) if m and _mixed(m[1]) else (None, last)


def _key(text: str, after: int, last: int, opening: str) -> tuple[Span | None, int]:
    """A key that is told by its first signs."""
    start = after - len(opening)
    if start < last or (start and (text[start - 1].isalnum() or text[start - 1] in "_-")):
        return None, last
    if opening in ("eyJ", "-----BEGIN "):
        m = (_JWT if opening == "eyJ" else _PEM).match(text, start)
        return (m.span(), m.end()) if m else (None, last)
    m = _KEY_TAIL.match(text, after)
    least, most = KEY_OPENINGS[opening]
    return ((start, m.end()), m.end()) if m and least <= len(m[0]) <= most and any(c in _DIGITS for c in m[0]) else (None, last)


#: Code points around a cue in which the rest of a street is looked for.
NEAR = 100


def _street(text: str, after: int, last: int, cue: str) -> tuple[Span | None, int]:
    start, low = after - len(cue), max(last, after - len(cue) - NEAR)
    if cue in STREET_JOINED:
        while start > low and text[start - 1].isalpha():
            start -= 1
        m = _HOUSE_AFTER.match(text, after, after + NEAR)
        return ((start, m.end()), m.end()) if m and text[start].isupper() else (None, last)
    if cue in STREET_BEFORE:
        if cue[0] == " ":
            number, name = _FRENCH.search(text[low:start]), _FRENCH_NAME.match(text, after, after + NEAR)
            return ((low + number.start(), name.end()), name.end()) if number and name else (None, last)
        m = _NAMED.match(text, after, after + NEAR)
        return ((start, m.end()), m.end()) if m and text[after : after + 1].isupper() else (None, last)
    if after < len(text) and text[after].isalnum():
        return None, last
    m = _HOUSE_BEFORE.search(text[low : start + (cue[0] == " ")])
    words = m[0].split()[1:] if m else []
    return ((low + m.start(), after), after) if words and all(w[0].isupper() or w[0].isdigit() for w in words) else (None, last)


def automaton() -> ahocorasick.Automaton:
    """Words with what they are anchors of: for each, kind, parser, signs from the anchor to the word's last sign, and a
    parser's further argument. A parser that reads on after a cue begins behind it."""
    found: dict[str, list[tuple]] = {}

    def add(word: str, kind: str, parser: Callable | None, back: int, *more: str) -> None:
        found.setdefault(word, []).append((kind, parser, back, more))

    add("@", "email", _email, 0)
    add("://", "url", _url, 2)
    add("www.", "url", _www, 3)
    add("+", "phone", _phone, 0)
    add("::", "ipv6", _ipv6, 0)
    for a in "0123456789abcdefABCDEF":
        add(a + ":", "ipv6", _ipv6, 0)
    for d in _DIGITS:
        add(d, "digit", None, 0)
        add("-" + d, "ssn", _ssn, 4)
        for country in IBAN_SIGNS:
            add(country + d, "iban", _iban, 2)
    for cues, kind, parser in ((SECRET_CUES, "secret", _secret), (PASSWORD_CUES, "secret", _password), (("bearer",), "secret", _bearer), (ACCOUNT_CUES, "account", _account)):
        for cue in cues:
            for form in dict.fromkeys((cue, cue.upper(), cue.title(), cue.capitalize())):
                add(form, kind, parser, -1)
    for opening in (*KEY_OPENINGS, "eyJ", "-----BEGIN "):
        add(opening, "secret", _key, -1, opening)
    for cue in (*STREET_AFTER, *STREET_JOINED, *STREET_BEFORE):
        add(cue, "street", _street, -1, cue)
    a = ahocorasick.Automaton()
    for word, uses in found.items():
        a.add_word(word, uses)
    a.make_automaton()
    return a


_automaton: list[ahocorasick.Automaton] = []


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind in the order of KINDS, then by start."""
    if not _automaton:
        _automaton.append(automaton())
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    ends = dict.fromkeys(KINDS, 0)
    for last, uses in _automaton[0].iter(text):
        for kind, parser, back, more in uses:
            at = last - back
            if parser is None:
                if at >= ends["ip"]:
                    found, ends["ip"] = _ip(text, at, ends["ip"])
                    out["ip"] += found
                if at >= ends["card"]:
                    span, ends["card"] = _card(text, at, ends["card"])
                    if span:
                        out["card"].append(span)
                continue
            if at < ends[kind]:
                continue
            span, ends[kind] = parser(text, at, ends[kind], *more)
            if span:
                out[kind].append(span)
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each span by its kind in angle brackets; where spans of several kinds overlap, they become one mark of the first."""
    out, last = [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[last:s], f"<{k}>"]
        last = e
    return "".join([*out, text[last:]])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``pii_spans``, which takes the place of a column of this name."""
    df = df.drop("pii_spans")
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] if t else [] for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _SPANS_ARROW)], names=[*b.schema.names, "pii_spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"pii_spans {_SPANS}"])
    return df.mapInArrow(K.lean(run), schema)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with marks in place of the spans; null texts stay null."""
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redact(t, find(t)) if t else t for t in b.column(column).to_pylist()]
            yield b.set_column(column, b.schema.field(column), pa.array(texts, b.schema.field(column).type))

    return df.mapInArrow(K.lean(run), df.schema)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, the SHA-256 of the base spans, and all spans as ``kind:start:end`` joined by
    commas; then the counts of the other kinds and of all spans."""
    others = [k for k in KINDS if k not in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [find(t) if t else [] for t in b.column(1).to_pylist()]
            counts = {k: pa.array([sum(x[0] == k for x in r) for r in rows], pa.int64()) for k in KINDS}
            joined = [[f"{k}:{s}:{e}" for k, s, e in r] for r in rows]
            base = [",".join(x for x in j if x.partition(":")[0] in BASE) for j in joined]
            digest = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
            columns = [b.column(0), *(counts[k] for k in BASE), digest, pa.array([",".join(j) for j in joined], pa.string()), *(counts[k] for k in others), pa.array(list(map(len, rows)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in others), "n_spans"]
    kind = df.schema[doc_id].dataType.simpleString()
    schema = ", ".join(f"{n} {kind if n == 'doc_id' else 'string' if n in ('base_sha256', 'spans') else 'bigint'}" for n in names)
    return df.select(F.col(doc_id), F.col(text)).mapInArrow(K.lean(run), schema)
