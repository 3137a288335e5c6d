"""Pick one value out of parsed lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_matching(
    df: DataFrame,
    column: str,
    regex: str,
    casts: Mapping[str, tuple[int, str]],
    predicate: Column | str,
    order: Sequence[Column | str],
    label: Column | str,
    fallback: Column | str,
    output: str = "latest",
) -> DataFrame:
    """Parse matching rows, filter them, keep the highest: one row ``(output,)``.

    ``casts`` maps new columns to ``(regex group, type)``; a row with a group that
    does not fit its type is dropped. ``order`` lists expressions, highest first
    wins, ties going to later ones and at last to ``label``, which is also the
    value returned. With no row left the result is ``fallback``.

    One aggregate does top-1 and fallback: each task sends a single row.
    """
    parsed = df.filter(F.col(column).rlike(regex)).select(
        "*",
        *[F.regexp_extract(column, regex, group).try_cast(kind).alias(name) for name, (group, kind) in casts.items()],
    )
    chosen = parsed.dropna(subset=list(casts)).filter(_expr(predicate))
    rank = F.struct(*[_expr(o).alias(f"_{i}") for i, o in enumerate(order)], _expr(label).alias("label"))
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return chosen.agg(F.max(rank).alias("__top")).select(F.coalesce("__top.label", fallback).alias(output))


def _expr(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e
