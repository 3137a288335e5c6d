"""Readers."""

from plumbspark.sources.files import number_lines, read_documents, read_lines, read_marked_lines
from plumbspark.sources.tables import read_table, small_table

__all__ = ["number_lines", "read_documents", "read_lines", "read_marked_lines", "read_table", "small_table"]
