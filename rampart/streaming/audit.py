"""Audit of detections in batches and streams. The plan is the batch one: screening keeps no state."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.readwriter import DataStreamWriter

from rampart.plans.pipeline import audit

TraceHook = Callable[..., object]
_hook: list[TraceHook] = []


def set_trace_hook(hook: TraceHook | None) -> None:
    """Register the function that ``trace`` calls for each text with a detection; None clears it."""
    _hook[:] = [] if hook is None else [hook]


def trace(audited: DataFrame) -> int:
    """Call the hook with the fields of each audit row, as keywords; what it raises is logged and has no effect.

    Rows come to the driver a partition at a time. Without a hook nothing runs.
    """
    n = 0
    if _hook:
        for row in audited.toLocalIterator():
            n += 1
            try:
                _hook[0](**row.asDict())
            except Exception:
                logging.getLogger(__name__).debug("trace hook failed", exc_info=True)
    return n


def audit_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, text_col: str = "text", source: str | None = None) -> DataStreamWriter:
    """A writer that hands every micro-batch's audit rows to ``sink`` and to the trace hook.

    Give it a checkpoint folder and start it; a sink that writes by batch id makes retries harmless.
    """
    rows = audit(stream, text_col, source)

    def each(batch: DataFrame, number: int) -> None:
        if sink:
            sink(batch, number)
        trace(batch)

    return rows.writeStream.outputMode("append").foreachBatch(each)
