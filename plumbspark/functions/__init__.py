"""Column expressions shared by the operators."""

from plumbspark.functions.lines import has_line, line_predicate, line_regex, lines_match, text_lines
from plumbspark.functions.paths import basename, default_if_empty, glob_match, strip_extension

__all__ = [
    "basename",
    "default_if_empty",
    "glob_match",
    "has_line",
    "line_predicate",
    "line_regex",
    "lines_match",
    "strip_extension",
    "text_lines",
]
