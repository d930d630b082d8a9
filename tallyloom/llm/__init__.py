"""Operators of language-model data: on document texts, and percentiles by multi-select. Nothing else in the library imports this package."""
