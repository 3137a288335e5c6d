"""Benchmark decontamination: Wu-Manber search for the word windows of all test items at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbspark.llm.ids import plain_columns
from plumbspark.llm.storage import cut
from plumbspark.llm.text import LOWER, Texts, blocks, runs

#: Test strings (windows) of one search block: what a task holds of the benchmark at a time.
BLOCK_WINDOWS = 100_000

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = True
_WORD[0x41:0x5B] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def word_lists(texts: Texts) -> tuple[list[str], np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, and where each text begins among them."""
    inside = _WORD[texts.data]
    found = runs(texts, inside)
    spaced = np.full(len(texts.data) + len(texts), 0x20, dtype=np.uint8)
    shift = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    spaced[np.arange(len(texts.data)) + shift] = np.where(inside, LOWER[texts.data], 0x20)
    return list(filter(None, spaced.tobytes().decode().split(" "))), found.first


class WindowSearch:
    """Wu-Manber tables over words for test strings of one length.

    The alphabet is the words, a block is the last two (or one) of them.  ``shift`` tells for
    a block how far the search may go on; blocks it doesn't have allow the whole length.
    Blocks that end a test string lead to its bucket; a set finds the string there to compare
    with, however many end alike.
    """

    def __init__(self, strings: dict[tuple[str, ...], set[int]]) -> None:
        self.length = len(next(iter(strings)))
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift: dict[tuple[str, ...] | str, int] = {}
        self.bucket: dict[tuple[str, ...] | str, set[tuple[str, ...]]] = defaultdict(set)
        self.items = strings
        for string in strings:
            for end in range(self.block, self.length + 1):
                key = string[end - 2 : end] if self.block == 2 else string[0]
                self.shift[key] = min(self.shift.get(key, self.most), self.length - end)
            self.bucket[key].add(string)

    def find(self, word: list[str], low: int, high: int) -> Iterator[tuple[int, tuple[str, ...]]]:
        """Start and test string of every occurrence within ``word[low:high]``."""
        length, shift, most = self.length, self.shift.get, self.most
        at = low + length - 1
        if self.block == 1:
            for at in range(low, high):
                if word[at] in self.shift:
                    yield at, (word[at],)
            return
        while at < high:
            key = (word[at - 1], word[at])
            step = shift(key, most)
            if step:
                at += step
                continue
            begin = at - length + 1
            text = tuple(word[begin : at + 1])
            if text in self.bucket[key]:
                yield begin, text
            at += 1


def item_windows(items: list[tuple[object, str | None]], width: int) -> dict[tuple[str, ...], set[object]]:
    """Every test string of the items, with the items that hold it; an item under ``width`` words is one string."""
    found: dict[tuple[str, ...], set[object]] = defaultdict(set)
    for item, text in items:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        words, _ = word_lists(Texts(data, np.array([0, len(data)])))
        for k in range(max(1, len(words) - width + 1) if words else 0):
            found[tuple(words[k : k + width])].add(item)
    return found


def _test_strings(benchmark: DataFrame, width: int, item_column: str, text_column: str) -> DataFrame:
    """``string, items``: every distinct test string, its words joined by a blank, and the items that hold it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                strings = [" ".join(x) for x in item_windows([(item, text)], width)]
                yield pa.RecordBatch.from_arrays([pa.array(strings, type=pa.string()), pa.array([item] * len(strings), type=pa.string())], names=["string", "item"])

    rows = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(scan, "string string, item string").groupBy("string").agg(F.collect_set("item").alias("items"))


def _searches(strings: dict[tuple[str, ...], set[str]]) -> list[WindowSearch]:
    by_length: dict[int, dict] = defaultdict(dict)
    for string, items in strings.items():
        by_length[len(string)][string] = items
    return [WindowSearch(x) for _, x in sorted(by_length.items())]


def _loaded(block: Broadcast) -> list[WindowSearch]:
    """The search tables of one block, whose strings the worker does not keep for the next."""
    searches = _searches(block.value)
    vars(block).pop("_value", None)
    return searches


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", width: int = 10, block_windows: int = BLOCK_WINDOWS, keep_columns: bool = False) -> DataFrame:
    """Words of each document inside any occurrence of a benchmark window, and the items found.

    The benchmark is the stated query set.  Its distinct test strings are dealt by a hash into
    blocks of about ``block_windows``; each is broadcast by itself, so that the driver holds no
    more than one.  One pass maps the documents: a worker splits a few MB of texts into words
    once and searches them for one block after the other, with the tables of one block in
    memory at a time (a single block stays loaded).  Within a block each length of test string
    has its tables.  No document is shuffled.

    Returns ``id_column, n_words, n_hit, items, hits``, or with ``keep_columns`` the documents
    with these columns in place of any of the same names: the item ids as sorted distinct
    strings, and the maximal intervals of hit words ``(start, end)``, end exclusive.  One row
    per input row.  NULL and empty texts and items have no words; very long texts are searched
    whole; an item without an id is left out; an empty benchmark finds nothing; repeated items
    count once; a NULL document id is kept; an empty table gives no rows.
    """
    spark = documents.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    results = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", span)]
    kept = [x for x in documents.columns if x not in {f.name for f in results}] if keep_columns else [id_column, text_column]
    picked = plain_columns(documents, kept)
    at = f"c{kept.index(text_column)}"
    if not keep_columns:
        picked = picked.withColumn(at, F.col(at).cast("string"))
    schema = T.StructType([*picked.schema.fields, *results])

    strings = _test_strings(benchmark, width, item_column, item_text_column)
    n_blocks = strings.count() // block_windows + 1
    if n_blocks > 1:
        # read once for each block
        strings = cut(strings)
    tables = []
    for k in range(n_blocks):
        block = strings.where(F.pmod(F.xxhash64("string"), F.lit(n_blocks)) == k).toArrow()
        some = zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)
        tables.append(spark.sparkContext.broadcast({tuple(string.split(" ")): set(items) for string, items in some}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _searches(tables[0].value) if len(tables) == 1 else None
        for rows, texts in blocks(batches, at):
            word, first = word_lists(texts)
            first = first.tolist()
            step = np.zeros(len(word) + 1, dtype=np.int32)
            items: list[set[str]] = [set() for _ in range(len(texts))]
            for searches in [only] if only is not None else map(_loaded, tables):
                for found, low, high in zip(items, first[:-1], first[1:], strict=True):
                    for tried in searches:
                        for begin, string in tried.find(word, low, high):
                            step[begin] += 1
                            step[begin + tried.length] -= 1
                            found |= tried.items[string]
            inside = (np.cumsum(step) > 0).astype(np.int8)
            n_hit, all_hits = [], []
            for found, low, high in zip(items, first[:-1], first[1:], strict=True):
                edges = np.flatnonzero(np.diff(inside[low:high], prepend=0, append=0)).reshape(-1, 2) if found else np.zeros((0, 2), dtype=np.int64)
                n_hit.append(int((edges[:, 1] - edges[:, 0]).sum()))
                all_hits.append([{"start": a, "end": b} for a, b in edges.tolist()])
            columns = [*rows.columns, pa.array(np.diff(first)), pa.array(n_hit, type=pa.int64()), pa.array([sorted(x) for x in items], type=pa.list_(pa.string())), pa.array(all_hits, type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    done = picked.mapInArrow(scan, schema).toDF(*kept, *[f.name for f in results])
    return done if keep_columns else done.drop(text_column)
