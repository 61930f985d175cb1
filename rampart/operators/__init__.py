"""Relational forms of detection: tokens, keywords, phrases, layers and scores as tables."""
