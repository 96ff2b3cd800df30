"""Readers and writers."""

from fieldbook.sources.tables import table, text_table

__all__ = ["table", "text_table"]
