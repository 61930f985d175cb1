"""Prompt-injection screening and text processing as Spark plans."""
