"""Registered queries, by area."""

from catalog import archived, documents, indexing, screening, searching, texts, tiering

MODULES = [tiering, screening, searching, texts, documents, indexing, archived]
