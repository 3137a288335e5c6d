"""Text files as rows. Lines end at ``\\n`` only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbspark.functions.lines import text_lines


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files: ``(source, block, seq, text)``.

    Many tasks read a big file in blocks; ``block`` is the block's place in the file and
    ``seq`` grows within it, so that both together order the lines of a source. Nothing is
    shuffled or sorted. :func:`number_lines` adds numbers to the lines that need them.
    """
    return spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )


def number_lines(lines: DataFrame, kept: Column | None = None) -> DataFrame:
    """``(source, line_no, text)`` of the ``kept`` lines of :func:`read_lines`, numbered from 1 per file.

    A first pass over ``lines`` counts those of each block; a line's number is the count
    of the blocks before its own plus its place in its block. Only one row per block is
    aggregated and ordered, and only kept lines meet these rows.
    """
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Both passes cut the same files into the same partitions, so their seq agree.
    blocks = (
        lines.groupBy("source", "block")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
        .select("source", "block", "first_seq", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    line_no = F.col("before") + F.col("seq") - F.col("first_seq") + 1
    wanted = lines if kept is None else lines.filter(kept)
    return wanted.join(blocks, ["source", "block"]).select("source", line_no.alias("line_no"), "text")


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole text files: ``(path, text)``, one row per file.

    Listing skips names that start with ``.`` or ``_``, as all Spark file sources
    do; use an inventory table for those.
    """
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


#: Byte-order marks and the encodings they stand for.
MARKS = {"FFFE": "UTF-16LE", "FEFF": "UTF-16BE", "EFBBBF": "UTF-8"}


def read_marked_lines(
    spark: SparkSession, paths: str | Sequence[str], unmarked: str = "UTF-16LE", keep_cr: bool = False
) -> DataFrame:
    """Lines of files with a byte-order mark: ``(source, line_no, text)``, lines from 1.

    The mark says whether a file is UTF-16LE, UTF-16BE or UTF-8 and is no part of the text; a
    file without one is read as ``unmarked``. Lines end at ``\\n``, and a ``\\r`` before it, or at the
    end of the file, is dropped unless ``keep_cr``. Of a UTF-16 file with an odd number of bytes
    the last byte is left out; any other malformed text fails the query. An empty file, or one
    of a mark alone, has no lines. Each file is read by one task, as its lines have to be
    decoded from the start; many files are many tasks.
    """
    content = F.col("content")
    start = F.hex(F.substring(content, 1, 3))
    encoding, skip = F.lit(unmarked), F.lit(0)
    for mark, name in MARKS.items():
        encoding = F.when(start.startswith(mark), name).otherwise(encoding)
        skip = F.when(start.startswith(mark), len(mark) // 2).otherwise(skip)
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source"), "content", encoding.alias("encoding"), skip.alias("skip"))
    size = F.octet_length(content) - F.col("skip")
    whole = F.when(F.col("encoding").startswith("UTF-16"), size - size % 2).otherwise(size)
    body = F.substring(content, F.col("skip") + 1, whole)
    text = F.lit("").cast("string")
    for name in dict.fromkeys([*MARKS.values(), unmarked]):
        text = F.when(F.col("encoding") == name, F.decode(body, name)).otherwise(text)
    lines = files.select("source", F.posexplode(text_lines(text)).alias("place", "text"))
    line = F.col("text") if keep_cr else F.regexp_replace("text", r"\r\z", "")
    return lines.select("source", (F.col("place") + 1).cast("bigint").alias("line_no"), line.alias("text"))
