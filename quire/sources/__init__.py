"""Readers and writers of the library's tables."""

from quire.sources.tables import table

__all__ = ["table"]
