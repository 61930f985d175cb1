"""Screening of streams."""

from rampart.streaming.audit import TraceHook, audit_stream, set_trace_hook

__all__ = ["TraceHook", "audit_stream", "set_trace_hook"]
