"""Idempotent text edits over a corpus; all of them map-only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.lines import (
    has_line,
    join_lines,
    quote_regex,
    quote_replacement,
    text_lines,
)

SCOPES = ("first_per_line", "first_per_doc", "all")
TRAILING_WHITESPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rewrite:
    """Replace ``pattern`` by ``replacement``.

    A Java regex works on single lines and its replacement may use ``$0``, ``$1`` and
    on; with ``literal`` both are plain text, and over a whole document or in ``all``
    the pattern may span lines. The rewrite is left out where the document already
    holds the text ``unless``.
    """

    pattern: str
    replacement: str
    scope: str = "first_per_line"
    literal: bool = False
    unless: str | None = None


def append_if_absent(
    docs: DataFrame,
    marker: str,
    block: Column | str,
    on_missing: str = "create",
    marker_mode: str = "fixed",
    trim_end: bool = False,
    text: str = "text",
) -> DataFrame:
    """Append ``block`` to documents without a line holding ``marker``; sets ``changed``.

    A missing (NULL) document becomes the block alone (``create``) or stays
    missing (``skip``). ``trim_end`` drops white space before the block. Existing
    blocks are left as they are, so a second run changes nothing provided that the
    block contains the marker. ``changed`` stays true where an earlier edit set it.
    """
    if on_missing not in ("create", "skip"):
        raise ValueError(f"on_missing must be 'create' or 'skip', got {on_missing!r}")
    block = F.lit(block) if isinstance(block, str) else block
    old = F.col(text)
    absent = F.when(old.isNull(), F.lit(on_missing == "create")).otherwise(
        ~has_line(old, marker, marker_mode)
    )
    kept = F.rtrim(old, F.lit(TRAILING_WHITESPACE)) if trim_end else old
    edited = F.when(F.col("__absent"), F.concat(F.coalesce(kept, F.lit("")), block)).otherwise(old)
    marked = docs.withColumn("__absent", absent).withColumn(text, edited)
    return marked.withColumn("changed", _or_earlier(docs, F.col("__absent"))).drop("__absent")


def rewrite_lines(
    docs: DataFrame,
    rewrites: Sequence[Rewrite],
    condition: Column | str | None = None,
    text: str = "text",
) -> DataFrame:
    """Apply ``rewrites`` in order, each to the outcome of the last; sets ``changed``.

    ``first_per_line`` replaces the first hit in each line, ``first_per_doc`` the
    first in the document, ``all`` every one. Documents where ``condition`` does
    not hold, and missing ones, are left alone. ``changed`` stays true where an
    earlier edit set it.
    """
    if not rewrites:
        raise ValueError("rewrites is empty")
    for rewrite in rewrites:
        if rewrite.scope not in SCOPES:
            raise ValueError(f"scope must be one of {SCOPES}, got {rewrite.scope!r}")
        if not rewrite.pattern:
            raise ValueError("an empty pattern cannot be replaced")
    # One column per step: nesting the steps would repeat their text many times over.
    edited = docs.withColumn("__new", F.col(text))
    for by_line, steps in groupby(rewrites, _works_on_lines):
        if by_line:
            edited = edited.withColumn("__new", _rewrite_each_line(F.col("__new"), list(steps)))
        else:
            for step in steps:
                edited = edited.withColumn("__new", _rewrite_document(F.col("__new"), step))
    new = F.col("__new")
    if condition is not None:
        holds = F.expr(condition) if isinstance(condition, str) else condition
        new = F.when(holds, new).otherwise(F.col(text))
        edited = edited.withColumn("__new", new)
    columns = [F.col("__new").alias(text) if c == text else F.col(c) for c in docs.columns if c != "changed"]
    changed = _or_earlier(docs, ~F.col(text).eqNullSafe(F.col("__new")))
    return edited.select(*columns, changed.alias("changed"))


def _or_earlier(docs: DataFrame, changed: Column) -> Column:
    if "changed" not in docs.columns:
        return changed
    return changed | F.coalesce(F.col("changed").cast("boolean"), F.lit(False))


def _works_on_lines(rewrite: Rewrite) -> bool:
    by_line = rewrite.scope == "first_per_line" or (rewrite.scope == "all" and not rewrite.literal)
    return by_line and rewrite.unless is None


def _rewrite_each_line(text: Column, rewrites: list[Rewrite]) -> Column:
    def edit(line: Column) -> Column:
        for rewrite in rewrites:
            pattern, replacement = _as_regex(rewrite)
            if rewrite.scope == "all":
                line = F.regexp_replace(line, f"(?sd){pattern}", replacement)
            else:
                line = _replace_first(line, pattern, replacement)
        return line

    return join_lines(F.transform(text_lines(text), edit), text)


def _rewrite_document(text: Column, rewrite: Rewrite) -> Column:
    if rewrite.scope == "first_per_line" or (rewrite.scope == "all" and not rewrite.literal):
        new = _rewrite_each_line(text, [rewrite])
    elif rewrite.scope == "all":
        new = F.replace(text, F.lit(rewrite.pattern), F.lit(rewrite.replacement))
    elif rewrite.literal:
        before = F.substring_index(text, rewrite.pattern, 1)
        after = F.substr(text, F.length(before) + (len(rewrite.pattern) + 1))
        new = F.when(
            text.contains(rewrite.pattern), F.concat(before, F.lit(rewrite.replacement), after)
        ).otherwise(text)
    else:
        new = _rewrite_first_line(text, rewrite)
    if rewrite.unless is not None:
        new = F.when(text.contains(rewrite.unless), text).otherwise(new)
    return new


def _rewrite_first_line(text: Column, rewrite: Rewrite) -> Column:
    """Edit the first line with a hit and no other."""
    lines = text_lines(text)
    hit = F.array_position(F.transform(lines, lambda line: line.rlike(f"(?sd){rewrite.pattern}")), True)

    def edit(found: Column) -> Column:
        at = found["at"].cast("int")
        edited = _replace_first(F.get(found["lines"], at - 1), rewrite.pattern, rewrite.replacement)
        rest = F.slice(found["lines"], at + 1, F.size(found["lines"]))
        return F.concat(F.slice(found["lines"], 1, at - 1), F.array(edited), rest)

    # An array of one, so that lines and position are computed once.
    found = F.array(F.struct(lines.alias("lines"), hit.alias("at")))
    new = F.get(F.transform(found, lambda x: F.when(x["at"] > 0, edit(x)).otherwise(x["lines"])), F.lit(0))
    return join_lines(new, text)


def _as_regex(rewrite: Rewrite) -> tuple[str, str]:
    if rewrite.literal:
        return quote_regex(rewrite.pattern), quote_replacement(rewrite.replacement)
    return rewrite.pattern, rewrite.replacement


def _replace_first(line: Column, pattern: str, replacement: str) -> Column:
    """Replace the first hit only: group 1 takes what comes before it, group 2 is the hit.

    A line without a hit is told apart first, so that the search runs once over it.
    """
    shifted, groups = _shift_pattern(pattern, 2)
    moved = _shift_replacement(replacement, 2, groups)
    hit = line.rlike(f"(?sd){pattern}")
    return F.when(hit, F.regexp_replace(line, f"(?sd)^(.*?)({shifted})", f"$1{moved}")).otherwise(line)


def _shift_pattern(pattern: str, by: int) -> tuple[str, int]:
    """``pattern`` with its numbered back references moved ``by`` groups on, and its number of groups.

    As in Java a back reference takes further digits while so many groups have begun.
    """
    out, groups, i, depth = [], 0, 0, 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("\\Q"):
            end = pattern.find("\\E", i)
            step = len(rest) if end < 0 else end + 2 - i
        elif rest[0] == "\\" and depth == 0 and rest[1:2] in tuple("123456789"):
            step = 2
            while rest[step : step + 1].isdigit() and int(rest[1 : step + 1]) <= groups:
                step += 1
            out.append(f"(?:\\{int(rest[1:step]) + by})")
            i += step
            continue
        elif rest[0] == "\\":
            step = 2
        else:
            step = 1
            if rest[0] == "[":
                depth += 1
            elif rest[0] == "]" and depth:
                depth -= 1
            elif rest[0] == "(" and depth == 0:
                groups += not rest.startswith("(?") or re.match(r"\(\?<[A-Za-z]", rest) is not None
        out.append(rest[:step])
        i += step
    return "".join(out), groups


def _shift_replacement(replacement: str, by: int, groups: int) -> str:
    """``replacement`` with its ``$n`` moved ``by`` groups on; a digit that follows one stays a digit."""
    out, i = [], 0
    while i < len(replacement):
        rest = replacement[i:]
        if rest[0] == "\\":
            step = 2
            out.append(rest[:step])
        elif rest[0] == "$" and rest[1:2].isdigit():
            step = 2
            while rest[step : step + 1].isdigit() and int(rest[1 : step + 1]) <= groups:
                step += 1
            out.append(f"${int(rest[1:step]) + by}")
            if rest[step : step + 1].isdigit():
                out.append("\\")
        else:
            step = 1
            out.append(rest[0])
        i += step
    # a digit right after $1, the lead, is kept apart from it
    moved = "".join(out)
    return "\\" + moved if moved[:1].isdigit() else moved
