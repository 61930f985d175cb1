"""The operators on a single text, as Column to Column functions, and the fixed values behind them."""

from rampart.functions.fuzzy import detect_typoglycemia
from rampart.functions.match import detect_injection_patterns, detect_leet_injection
from rampart.functions.spec import DETECTION, MODIFICATION_THRESHOLD, RESULT
from rampart.functions.text import calculate_risk_score, escape_data_tags, normalize_text, strip_sanitization_markers, wrap_in_data_tags

__all__ = [
    "DETECTION",
    "MODIFICATION_THRESHOLD",
    "RESULT",
    "calculate_risk_score",
    "detect_injection_patterns",
    "detect_leet_injection",
    "detect_typoglycemia",
    "escape_data_tags",
    "normalize_text",
    "strip_sanitization_markers",
    "wrap_in_data_tags",
]
