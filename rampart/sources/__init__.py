"""Inputs: tables of a folder, and documents with planted attack text."""

from rampart.sources.tables import PAYLOADS, attacks, planted, table

__all__ = ["PAYLOADS", "attacks", "planted", "table"]
