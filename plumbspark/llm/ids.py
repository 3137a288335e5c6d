"""Ids of documents as whole numbers that stay exact beside NULLs, and columns of any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

#: The rank of a NULL id, after all others.
LAST = (1 << 63) - 1


def integer_id(documents: DataFrame, id_column: str) -> Column:
    """``id_column`` as bigint; ValueError where ids are no whole numbers, which operators compare."""
    kind = documents.schema[id_column].dataType
    if not isinstance(kind, ByteType | ShortType | IntegerType | LongType):
        raise ValueError(f"{id_column!r} has to hold whole numbers, and is {kind.simpleString()}; number the documents first")
    return F.col(id_column).cast("bigint")


def rank_and_gap(ident: Column) -> list[Column]:
    """``rank, gap`` for ``ident``: numbers without NULL, which pandas would turn into floats, and whether there is none."""
    return [F.coalesce(ident, F.lit(LAST)).alias("rank"), ident.isNull().alias("gap")]


def quoted(name: str) -> str:
    """A column of any name, also one with dots, blanks or backticks."""
    return "`" + name.replace("`", "``") + "`"


def plain_columns(documents: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` as ``c0, c1, ...``: functions over batches take no names with dots or backticks."""
    return documents.select(*[F.col(quoted(x)).alias(f"c{i}") for i, x in enumerate(kept)])
