"""Auditable text-rewriting policies: pure functions of a text and validated tables."""
