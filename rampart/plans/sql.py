"""The operators as SQL functions of a session, and as views."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from rampart.functions import fuzzy, match, text
from rampart.functions.screen import screened
from rampart.functions.sqltext import written
from rampart.plans.pipeline import audit, detections, sanitize


def _bodies() -> dict[str, str]:
    """Name and parameters, and SQL body, of every function; the bodies are what the Column functions write down."""
    kind = "ARRAY<STRUCT<pattern_name: STRING, matched_text: STRING, position: INT, risk_level: STRING>>"
    result = f"STRUCT<original_text: STRING, sanitized_text: STRING, detected_patterns: {kind}, risk_score: DOUBLE, content_hash: STRING, was_modified: BOOLEAN, source: STRING>"
    return {
        "normalize_text(t STRING) RETURNS STRING": written(text.normalize_text, "t"),
        "content_hash(t STRING) RETURNS STRING": written(text.content_hash, "t"),
        "escape_data_tags(t STRING) RETURNS STRING": written(text.escape_data_tags, "t"),
        "wrap_in_data_tags(t STRING, source STRING) RETURNS STRING": written(text.wrap_in_data_tags, "t", "source"),
        "strip_sanitization_markers(t STRING) RETURNS STRING": written(text.strip_sanitization_markers, "t"),
        f"calculate_risk_score(found {kind}) RETURNS DOUBLE": written(text.calculate_risk_score, "found"),
        f"detect_injection_patterns(t STRING) RETURNS {kind}": written(match.detect_injection_patterns, "t"),
        f"detect_leet_injection(t STRING) RETURNS {kind}": written(match.detect_leet_injection, "t"),
        f"detect_typoglycemia(t STRING) RETURNS {kind}": written(fuzzy.detect_typoglycemia, "t"),
        f"sanitize(t STRING, source STRING) RETURNS {result}": written(screened, "t", "source"),
    }


@cache
def functions() -> dict[str, str]:
    return _bodies()


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for head, body in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in functions()]


def views(df: DataFrame, name: str, keys: list[str], text_col: str = "text", source: str | None = None) -> None:
    """Temporary views ``name``, ``name_detections`` and ``name_audit``: results and tables for SQL."""
    screened = sanitize(df, text_col, source)
    screened.createOrReplaceTempView(name)
    detections(screened, keys).createOrReplaceTempView(f"{name}_detections")
    audit(screened).createOrReplaceTempView(f"{name}_audit")
