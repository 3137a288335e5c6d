"""Line-level text expressions with the semantics of shell line tools.

Lines end at ``\\n`` only, a final line without a newline still counts, and a
text that ends in a newline has no extra empty line after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_MODES = ("regex", "regex_line", "word", "fixed", "fixed_line")

#: What a word is made of in any language; a match of mode "word" has none of it on either side.
WORD_CHARACTER = r"[\p{L}\p{M}\p{N}_]"


def text_lines(text: Column | str) -> Column:
    """Array of the lines of ``text``; empty for an empty text, NULL for NULL."""
    text = _col(text)
    body = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def join_lines(lines: Column, text: Column) -> Column:
    """Put lines back together, keeping the final newline ``text`` had or lacked."""
    ending = F.when(text.endswith("\n") & (text != ""), "\n").otherwise("")
    return F.concat(F.array_join(lines, "\n"), ending)


def line_regex(pattern: str, mode: str = "regex", ignore_case: bool = False) -> str:
    """Java regex that tests one line.

    ``(?d)`` keeps ``\\r`` and friends from acting as line ends, ``(?s)`` lets
    ``.`` run over them.
    """
    if mode not in LINE_MODES:
        raise ValueError(f"mode must be one of {LINE_MODES}, got {mode!r}")
    body = quote_regex(pattern) if mode.startswith("fixed") else pattern
    if mode in ("regex_line", "fixed_line"):
        body = f"^(?:{body})$"
    elif mode == "word":
        body = rf"(?<!{WORD_CHARACTER})(?:{body})(?!{WORD_CHARACTER})"
    return ("(?sdiu)" if ignore_case else "(?sd)") + body


def line_regex_column(pattern: str, mode: str, ignore_case: str) -> Column:
    """As :func:`line_regex` for columns, NULL meaning a plain regex; mode ``suffix`` is fixed text that ends the line."""
    return line_regex_of(F.col(pattern), F.col(mode), F.col(ignore_case))


def line_regex_of(given: Column, mode: Column, ignore_case: Column) -> Column:
    """:func:`line_regex_column` of any expressions."""
    how = F.coalesce(mode, F.lit("regex"))
    quoted = F.regexp_replace(given, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    whole = lambda body: F.concat(F.lit("^(?:"), body, F.lit(")$"))
    body = (
        F.when(how == "regex", given)
        .when(how == "regex_line", whole(given))
        .when(how == "word", F.concat(F.lit(f"(?<!{WORD_CHARACTER})(?:"), given, F.lit(f")(?!{WORD_CHARACTER})")))
        .when(how == "fixed", quoted)
        .when(how == "fixed_line", whole(quoted))
        .when(how == "suffix", F.concat(quoted, F.lit("$")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), how)).cast("string"))
    )
    return F.concat(F.when(F.coalesce(ignore_case, F.lit(False)), "(?sdiu)").otherwise("(?sd)"), body)


def line_predicate(
    pattern: str, mode: str = "regex", ignore_case: bool = False, invert: bool = False
) -> Callable[[Column], Column]:
    """Predicate over one line: Java regex, whole-line, whole-word or fixed text."""
    regex = line_regex(pattern, mode, ignore_case)
    if "\n" in pattern:
        raise ValueError("a line pattern cannot hold a newline")

    def test(line: Column) -> Column:
        if mode == "fixed" and not ignore_case:
            hit = line.contains(pattern)
        elif mode == "fixed_line" and not ignore_case:
            hit = line == F.lit(pattern)
        else:
            hit = line.rlike(regex)
        return ~hit if invert else hit

    return test


def has_line(
    text: Column | str,
    pattern: str,
    mode: str = "regex",
    ignore_case: bool = False,
    invert: bool = False,
) -> Column:
    """True if some line of ``text`` matches; false for a missing (NULL) text.

    Fixed text needs no line split: a needle without a newline is in some line
    exactly if it is in the text, and a whole line is one between two newlines.
    """
    text = _col(text)
    test = line_predicate(pattern, mode, ignore_case, invert)
    if pattern and not ignore_case and not invert and mode == "fixed":
        hit = text.contains(pattern)
    elif pattern and not ignore_case and not invert and mode == "fixed_line":
        hit = F.concat(F.lit("\n"), text, F.lit("\n")).contains(f"\n{pattern}\n")
    else:
        hit = F.exists(text_lines(text), test)
    return F.coalesce(hit, F.lit(False))


def lines_match(
    lines: Column | str, pattern: str, mode: str = "regex", ignore_case: bool = False, invert: bool = False
) -> Column:
    """:func:`has_line` over lines that are already split, for many tests of one text."""
    return F.coalesce(F.exists(_col(lines), line_predicate(pattern, mode, ignore_case, invert)), F.lit(False))


def quote_regex(literal: str) -> str:
    """Java regex that matches ``literal`` as it stands."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def quote_replacement(literal: str) -> str:
    """Java replacement text that inserts ``literal`` as it stands."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
