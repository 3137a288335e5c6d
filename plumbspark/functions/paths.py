"""Path and small string expressions, all built-in Spark functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbspark.functions.lines import quote_regex


def basename(path: Column | str) -> Column:
    """Last component of a ``/`` separated path."""
    return F.element_at(F.split(path, "/"), -1)


def strip_extension(name: Column | str) -> Column:
    """``name`` without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def default_if_empty(value: Column | str, default: Column | str) -> Column:
    """``value`` unless it is NULL or empty, in which case ``default``."""
    value = F.col(value) if isinstance(value, str) else value
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(value, F.lit("")), default)


def glob_match(path: Column | str, glob: str) -> Column:
    """True if the whole of ``path`` fits a shell glob (``*``, ``?``, ``[..]``).

    A glob without a character class becomes ``LIKE``, which the optimizer turns
    into prefix / suffix / substring tests that reach the parquet scan. ``*`` also
    runs over ``/``, as in a name or whole-path test of a file search.
    """
    path = F.col(path) if isinstance(path, str) else path
    if "[" in glob:
        return path.rlike(_glob_regex(glob))
    escaped = re.sub(r"([\\%_])", r"\\\1", glob)
    return path.like(escaped.replace("*", "%").replace("?", "_"))


def _glob_regex(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        # A "]" right after "[" or "[!" is a member of the class, not its end.
        members = re.match(r"\[(!?)(\]?[^\]]*)\]", glob[i:]) if char == "[" else None
        if members:
            body = re.sub(r"([\\\[\]^&])", r"\\\1", members.group(2))
            out.append(f"[{'^' if members.group(1) else ''}{body}]")
            i += members.end()
            continue
        out.append({"*": ".*", "?": "."}.get(char) or quote_regex(char))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"
