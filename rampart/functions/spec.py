"""Fixed values of the screening rules, and the schemas of their results."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import types as T

# --- Fixed values: risk levels, their weights in hundredths, and the level one step up -------------------------------
RISK_WEIGHTS = {"critical": 40, "high": 25, "medium": 15, "low": 5}
UNKNOWN_WEIGHT = 5
RISK_PROMOTED = {"low": "medium", "medium": "high", "high": "critical", "critical": "critical"}
MODIFICATION_THRESHOLD = 0.3

# --- Fixed values: characters -----------------------------------------------------------------------------------------
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad\u2060"
HOMOGLYPHS = {
    # Cyrillic, lower case
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "т": "t", "н": "h", "к": "k", "м": "m", "в": "b", "г": "r", "л": "n",
    # Cyrillic, upper case
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "Х": "x",
    # others
    "ɡ": "g", "ǃ": "!",
    # Greek
    "ο": "o", "α": "a", "ρ": "p",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "(": "c", "|": "l"}
LEET_CLASS = r"[0-9@$!|(]"
EDGE_PUNCTUATION = ".,!?;:\"'()[]{}/<>"

# --- Fixed values: white space, as Java classes -----------------------------------------------------------------------
#: What separates words in raw text, and what of it is left after compatibility composition.
RAW_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = r"\t-\r\x1c-\x20\x{85}\x{1680}\x{2028}\x{2029}"
#: The same, one by one, without the plain space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"

# --- Fixed values: scrambled words -------------------------------------------------------------------------------------
KEYWORDS = (
    "ignore", "instructions", "previous", "system", "prompt", "forget", "disregard", "override", "pretend", "bypass", "admin", "assistant",
    "execute", "command", "role", "jailbreak", "ignorer", "oublier", "consignes", "precedentes", "contrainte", "restriction", "revele", "affiche",
)
PHRASES = (
    ("ignore", "previous", "instructions"),
    ("ignore", "all", "instructions"),
    ("disregard", "previous"),
    ("forget", "your", "instructions"),
    ("new", "role"),
    ("you", "are", "now"),
    ("system", "prompt"),
    ("override", "instructions"),
    ("ignore", "instructions", "precedentes"),
    ("oublie", "les", "consignes"),
    ("prompt", "systeme"),
    ("libre", "contrainte"),
    ("sans", "restriction"),
)
SCANNED_TOKENS = 200
FUZZY_MIN_LENGTH, LEET_MIN_LENGTH = 10, 50


class Pattern(NamedTuple):
    """A rule of the bank. ``regex`` is in the common dialect; ``needs`` are literals of which a match holds one at least.

    No literal has an ``i``: case-insensitive matching takes the dotless one for it.
    """

    name: str
    risk: str
    regex: str
    needs: tuple[str, ...]


# --- Fixed values: the pattern bank, in order ----------------------------------------------------------------------------
PATTERNS = (
    Pattern("ignore_instructions", "critical", r"ignore\s+(all\s+)?(previous|prior|above|your)\s+instructions", ("nstruct",)),
    Pattern("disregard_instructions", "critical", r"disregard\s+(all\s+)?(previous|prior|above|your)\s+(instructions|rules|guidelines)", ("sregard",)),
    Pattern("forget_instructions", "critical", r"forget\s+(everything|all)\s+(you|that)\s+(know|were|have)", ("forget",)),
    Pattern("identity_hijack", "high", r"you\s+are\s+now\s+(?:a|an|the)\s+", ("you",)),
    Pattern("role_override", "high", r"act\s+as\s+(?:a|an|if)\s+", ("act",)),
    Pattern("pretend_override", "high", r"pretend\s+(to\s+be|you\s+are)\s+", ("pretend",)),
    Pattern("new_role_assignment", "critical", r"your\s+new\s+(role|instructions?|task|purpose)\s+(is|are)", ("your",)),
    Pattern("system_prompt_extraction", "high", r"(reveal|show|display|print|output|repeat)\s+(your\s+)?(system\s+prompt|instructions|rules)", ("prompt", "nstruct", "rules")),
    Pattern("system_prompt_query", "medium", r"what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions|rules)", ("your",)),
    Pattern("base64_payload", "medium", r"base64\s*:\s*[A-Za-z0-9+/=]{20,}", ("base64",)),
    Pattern("hex_encoded_payload", "medium", r"\\x[0-9a-fA-F]{2}(\\x[0-9a-fA-F]{2}){3,}", ("\\x",)),
    Pattern("mode_switch", "critical", r"(enter|enable|switch\s+to|activate)\s+(developer|debug|admin|god)\s+mode", ("mode",)),
    Pattern("dan_jailbreak", "critical", r"DAN\s+(mode|prompt|jailbreak)", ("dan",)),
    Pattern("data_exfiltration", "critical", r"(send|transmit|exfiltrate|post)\s+(to|data|this)\s+(https?://|external)", ("http", "external")),
    Pattern("data_encoding_exfil", "high", r"(include|embed|insert)\s+(in|into|as)\s+(url|link|image|img\s+src)", ("nclude", "embed", "nsert")),
    Pattern("role_tag_injection", "high", r"</?(?:system|user|assistant|human|instructions?|prompt)>", (">",)),
    Pattern("bracket_role_injection", "high", r"\[\s*(?:SYSTEM|INST|SYS)\s*\]", ("[",)),
    Pattern("multi_step_injection", "high", r"(first|step\s*1|before\s+anything)\s*[,:]\s*(ignore|forget|disregard)", ("gnore", "forget", "sregard")),
    Pattern("output_override", "medium", r"(always|must|shall)\s+(respond|reply|answer|output)\s+with", ("always", "must", "shall")),
    Pattern("suppression_attempt", "medium", r"(do\s+not|never|don'?t)\s+(mention|reveal|tell|say|disclose)", ("do", "never")),
    Pattern("fr_ignore_instructions", "critical", r"ignor(?:e|ez)\s+(toutes?\s+)?(?:les\s+)?instructions?\s+(?:pr[eé]c[eé]dentes?|ant[eé]rieures?|ci-dessus)", ("nstruct",)),
    Pattern("fr_forget_instructions", "critical", r"oubli(?:e|ez)\s+(?:toutes?\s+)?(?:les\s+)?(?:instructions?|r[eè]gles?|consignes?)", ("oubl",)),
    Pattern("fr_disregard_instructions", "critical", r"ne\s+(?:tiens?|tenez)\s+(?:pas\s+)?compte\s+(?:des?\s+)?(?:instructions?|r[eè]gles?|consignes?)", ("compte",)),
    Pattern("fr_identity_hijack", "high", r"tu\s+es\s+(?:maintenant|d[eé]sormais)\s+", ("ntenant", "sorma")),
    Pattern("fr_role_override", "high", r"(?:agis|comporte[- ]toi|fais)\s+comme\s+si\s+", ("comme",)),
    Pattern("fr_new_role_assignment", "critical", r"(?:tes?|vos?)\s+(?:nouvelles?\s+)?(?:instructions?|r[eè]gles?|r[oô]le|consignes?)\s+(?:sont?|est|sera)", ("nstruct", "gle", "le", "gne")),
    Pattern("fr_system_prompt_extraction", "high", r"(?:r[eé]v[eè]le|montre|affiche|donne|r[eé]p[eè]te|imprime)\s+(?:ton\s+|le\s+)?(?:prompt\s+syst[eè]me|instructions?\s+syst[eè]me|consignes?)", ("syst", "cons")),
    Pattern("fr_system_prompt_query", "medium", r"(?:quelles?\s+sont|quel\s+est)\s+(?:ton\s+|tes\s+|le\s+)?(?:prompt\s+syst[eè]me|instructions?\s+syst[eè]me|consignes?)", ("quel",)),
    Pattern("fr_output_override", "medium", r"(?:r[eé]ponds?|r[eé]pondez)\s+(?:toujours|syst[eé]matiquement)\s+(?:par|avec|en\s+disant)", ("pond",)),
    Pattern("fr_mode_switch", "critical", r"(?:active|passe\s+en|entre\s+en)\s+(?:mode\s+)?(?:d[eé]veloppeur|debug|admin|dieu|god|sans\s+(?:limite|restriction|contrainte))", ("act", "passe", "entre")),
    Pattern("fr_suppression_attempt", "medium", r"(?:ne\s+)?(?:mentionne|r[eé]v[eè]le|dis|divulgue)\s+(?:pas|jamais|surtout\s+pas)", ("pas", "jama")),
    Pattern("fr_unrestricted", "high", r"(?:libre|libr[eé]r[eé]|affranchi|d[eé]gag[eé])\s+(?:de\s+)?(?:toute|toutes)\s+(?:contrainte|restriction|r[eè]gle|limite)", ("toute",)),
    Pattern("fr_data_exfiltration", "critical", r"(?:envoie|transmets?|transf[eè]re)(?:\s+(?:tout|toute|tous|toutes))?(?:\s+(?:l[ea']?s?|la|le|l'))?\s*(?:historique|conversation|donn[eé]es?|m[eé]moire|contexte)", ("envo", "transm", "transf")),
    Pattern("fr_command_execution", "high", r"(?:ex[eé]cute|lance|fais)\s+(?:la\s+)?(?:commande|instruction)\s+suivante", ("vante",)),
    Pattern("fr_indirect_injection", "medium", r"(?:quand|lorsqu|si)\s+(?:on\s+te|quelqu'?un)\s+(?:demand|interrog|parl|pos)", ("on", "quelqu")),
    Pattern("fr_no_restrictions", "high", r"(?:aucune?|sans|plus\s+de)\s+(?:restriction|contrainte|limite|r[eè]gle|garde-?fou)", ("aucun", "sans", "plus")),
    Pattern("en_unrestricted", "high", r"(?:you\s+have|with)\s+no\s+(?:restrictions?|limitations?|constraints?|rules?|guardrails?)", ("no",)),
    Pattern("en_data_exfil_broad", "critical", r"(?:send|forward|post|upload|transmit)\s+.*?(?:conversation|history|memory|context|data)\s+.*?https?://", ("http",)),
    Pattern("en_elevated_mode", "high", r"(?:operating|running|working)\s+in\s+(?:debug|admin|elevated|root|privileged|unrestricted)\s+(?:mode|privileges?)", ("operat", "runn", "work")),
    Pattern("en_deferred_injection", "medium", r"(?:remember|store|save)\s+(?:this|the\s+following)\s+(?:for\s+later|instruction)", ("remember", "store", "save")),
    Pattern("en_command_execution", "high", r"(?:execute|run)\s+(?:the\s+following|this)\s+(?:command|script|code)", ("execute", "run")),
    Pattern("en_pretend_unrestricted", "critical", r"pretend\s+(?:you\s+)?(?:have|had)\s+no\s+(?:restrictions?|limitations?|constraints?|rules?|guardrails?|boundaries)", ("pretend",)),
)

# --- Fixed values: a text without any of these is not scanned for patterns -----------------------------------------------
SIGNAL_WORDS = (
    "ignore", "disregard", "forget", "pretend", "you are now", "act as ", "your new ", "reveal", "display", "system prompt", "system ", "instructions",
    "base64", "\\x", "mode", "dan ", "send ", "transmit", "exfiltrat", "include ", "embed ", "respond with", "reply with", "answer with", "output with",
    "not mention", "never reveal", "never tell", "first,", "first:", "step 1", "before anything", "<system", "</system", "<user", "</user", "<assistant",
    "<human", "<instruct", "<prompt", "</prompt", "[system", "[inst", "[sys", "no restriction", "no limitation", "no constraint", "no rule", "no guardrail",
    "operating in", "running in", "working in", "remember this", "store this", "save this", "execute the", "execute this", "run the", "run this",
    "post ", "insert ", "forward", "upload", "disclose", "not tell", "don't tell", "not say", "never say", "don't say", "never mention", "don't mention",
    "not reveal", "don't reveal", "the following", "repeat", "output ", "rules",
    "ignor", "oubli", "consigne", "tiens pas compte", "tenez pas compte", "tu es maintenant", "tu es désormais", "tu es desormais", "agis comme", "comporte",
    "fais comme", "révèle", "revele", "montre ", "affiche ", "donne ", "imprime", "répète", "repete", "prompt systè", "prompt syste", "instructions systè",
    "instructions syste", "réponds", "reponds", "active ", "passe en", "entre en", "mentionne", "divulgue", "libre ", "libéré", "libere", "affranchi",
    "contrainte", "restriction", "envoie", "transmets", "transfère", "transfere", "exécute", "execute", "lance ", "commande ", "quand on te", "lorsqu",
    "quelqu", "aucune", "sans restriction", "sans contrainte", "sans limite", "plus de restriction", "plus de contrainte",
)

# --- Fixed values: marks and tags in the output ----------------------------------------------------------------------------
MARK_OPEN, MARK_CLOSE = "[SANITIZED: ", "[/SANITIZED]"
MARK_GUARD = "[SANITIZED:"
MARK_REGEX = r"(?s)\[SANITIZED:[^\]]*\](.*?)\[/SANITIZED\]"
DATA_TAG_CLOSE, DATA_TAG_CLOSE_ESCAPED = "(?i)</data-content>", "&lt;/data-content&gt;"
DATA_TAG_OPEN, DATA_TAG_OPEN_ESCAPED = r"(?i)<data-content(?![\p{L}\p{N}_])", "&lt;data-content"
DETECTION_LAYER = "sanitizer"

DETECTION = T.StructType(
    [
        T.StructField("pattern_name", T.StringType()),
        T.StructField("matched_text", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("risk_level", T.StringType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("original_text", T.StringType()),
        T.StructField("sanitized_text", T.StringType()),
        T.StructField("detected_patterns", T.ArrayType(DETECTION)),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("was_modified", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)


_PART = re.compile(r"\\.|\[[^\]]*\]|.")


def java(regex: str) -> str:
    """A bank pattern for folded text, in the engine's dialect.

    Folded text has no upper case, so the pattern is lower-cased and needs no flags; only the dotless i is left of what
    counts as equal to another letter. White space and the dot mean what they mean on normalized text.
    """
    out = []
    for part in _PART.findall(regex.replace(".*?", "\0")):
        if part == r"\s":
            out.append(f"[{SPACE}]")
        elif part.startswith("\\"):
            out.append(part)
        elif part.startswith("["):
            out.append(part[:-1].lower() + ("\u0131]" if "a-z" in part.lower() else "]"))
        else:
            out.append({"i": "[i\u0131]", "\0": r"[^\n]*?"}.get(part.lower(), part.lower()))
    return "".join(out)
