"""Substring dedup: words of 13-word windows that an earlier document holds as well are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.ids import integer_id, rank_and_gap
from plumbspark.llm.text import Runs, Texts, blocks, codes, mixed, words

#: Text bytes of a part: what one task holds at a time, beside its longest text.
PART_BYTES = 6 << 20

#: Rows that a part, or a bucket, sends at most; with more buckets or parts these come in ranges that are split on the way.
RANGES = 2048

#: Bytes of hashes that are split at a time.
SPLIT_BYTES = 32 << 20

#: Odd, so that no bit of a window's first word is lost; words are mixed before and windows after.
_STEP = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(texts: Texts, width: int) -> tuple[Runs, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Rabin-Karp hashes of all windows of ``width`` words.

    Gives the words, the first word and the hash of each window, the distinct words and
    every word's number among them.
    """
    found = words(texts)
    code, distinct, hashes = codes(texts.data, found)
    n = np.diff(found.first)
    fits = np.arange(len(code)) < np.repeat(found.first[1:], n) - (width - 1)
    begin = np.flatnonzero(fits)
    if not len(begin):
        return found, begin, np.zeros(0, dtype=np.uint64), distinct, code
    word = hashes[code]
    count = len(word) - width + 1
    value = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        value *= _STEP
        value += word[k : k + count]
    return found, begin, mixed(value[begin]), distinct, code


def _packed(values: np.ndarray) -> bytes:
    """Fixed-width numbers, high bytes first, byte plane by byte plane: sorted or small ones compress well."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(">u8").astype(np.uint64).ravel()


def _cuts(number: np.ndarray) -> list[tuple[int, int, int]]:
    """Begin, end and value of each run of equal numbers."""
    edge = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    return list(zip(edge, [*edge[1:], *([len(number)] if edge else [])], number[edge].tolist(), strict=True))


def sent_rows(part: int, value: np.ndarray, rank: np.ndarray, buckets: int, per_range: int) -> pd.DataFrame:
    """``to, part, hashes, ids``: the hashes of one part by bucket, or by range of ``per_range`` buckets.

    A bucket's hashes are sent as quotients by the number of buckets, a range's as they are.
    """
    bucket = value % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    value, rank, to = value[by], rank[by], (bucket[by] // np.uint64(per_range)).astype(np.int64)
    shown = value // np.uint64(buckets) if per_range == 1 else value
    rows = [(k, part, _packed(shown[a:b]), _packed(rank[a:b].view(np.uint64))) for a, b, k in _cuts(to)]
    return pd.DataFrame(rows, columns=["to", "part", "hashes", "ids"])


def _split(batches: Iterator[pa.RecordBatch], flush) -> Iterator[pa.RecordBatch]:
    """``flush`` of all columns' numbers, a bounded number of bytes at a time."""
    kept: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            numbers = [_unpacked(x) if isinstance(x, bytes) else x for x in row]
            count = max(len(x) for x in numbers if isinstance(x, np.ndarray))
            kept.append([x if isinstance(x, np.ndarray) else np.full(count, x, dtype=np.uint64) for x in numbers])
            size += 8 * count * len(numbers)
            if size > SPLIT_BYTES:
                yield flush(*[np.concatenate(x) for x in zip(*kept, strict=True)])
                kept, size = [], 0
    if kept:
        yield flush(*[np.concatenate(x) for x in zip(*kept, strict=True)])


def drop_repeated_windows(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 13, part_bytes: int = PART_BYTES) -> DataFrame:
    """Remove from every text the words of windows that also start in a document with a smaller id.

    1. Documents are dealt into parts of about ``part_bytes`` by a hash of id and text.
    2. Each part sends every distinct window hash once, with the smallest id that has it
       there, to the hash's bucket: a passage in a third of all documents costs one entry a
       part, not one a document.
    3. Buckets count the parts of each hash and answer those parts in which the hash does
       not start first.
    4. Each part marks the windows that were answered or that an earlier document of the
       part holds, merges overlapping windows into maximal intervals and removes them.
    There are as many buckets as parts.  Where they are more than ``RANGES``, a part sends a row
    for each range of buckets and a bucket one for each range of parts, which are split on
    the way: rows grow with the parts, not with their square.
    Windows are judged on the input.  Windows count as equal when their 64-bit hashes are.

    Returns ``id_column, n_words, n_removed, kept_text, removed``: kept words joined by one
    space, and the maximal intervals as an array of ``(start, end)`` word numbers, end
    exclusive.  One row per input row.  NULL texts have no words.  Rows with the same id
    don't remove from each other; a NULL id counts as larger than any other.  Texts under
    ``width`` words stay whole.  Other columns are ignored.
    """
    kind = documents.schema[id_column].dataType
    picked = documents.select(*rank_and_gap(integer_id(documents, id_column)), F.col(text_column).cast("string").alias("text"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // part_bytes + 1
    buckets, tasks = np.uint64(parts), int(min(parts, 100_000))
    per_range = int(-(-parts // RANGES))
    ranges = int(-(-parts // per_range))
    dealt = picked.withColumn("part", F.pmod(F.xxhash64("rank", "text"), F.lit(parts))).repartition(tasks, "part")

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values("rank", kind="stable")

    def windows_of(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, Texts, tuple]]:
        """Blocks of an ordered part: ranks, texts and their windows."""
        batch = pa.RecordBatch.from_arrays([pa.array(frame["rank"].to_numpy()), pa.array(frame["text"], type=pa.string())], names=["rank", "text"])
        for rows, texts in blocks(iter([batch]), "text"):
            yield rows.column(0).to_numpy(), texts, window_hashes(texts, width)

    def smallest(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Distinct window hashes of a part, sorted, and the smallest id that has each."""
        values, ranks = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for rank, _, (found, begin, value, _, _) in windows_of(frame):
            values.append(value)
            ranks.append(rank[np.searchsorted(found.first, begin, side="right") - 1])
        value, at = np.unique(np.concatenate(values), return_index=True)
        return value, np.concatenate(ranks)[at]

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        return sent_rows(int(rows["part"].iloc[0]), *smallest(order(rows)), int(buckets), per_range)

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(_: np.ndarray, part: np.ndarray, value: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
            by = np.lexsort((value, value % buckets))
            part, value, rank = part[by], value[by], rank[by]
            rows = [(k, _packed(part[a:b]), _packed(value[a:b] // buckets), _packed(rank[a:b])) for a, b, k in _cuts((value % buckets).astype(np.int64))]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int64()), *[pa.array(c, type=pa.binary()) for c in columns[1:]]], names=["to", "parts", "hashes", "ids"])

        return _split(batches, flush)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [_unpacked(x) for x in rows["hashes"]]
        value = np.concatenate(hashes)
        rank = np.concatenate([_unpacked(x).view(np.int64) for x in rows["ids"]])
        if "parts" in rows:
            part = np.concatenate([_unpacked(x) for x in rows["parts"]]).astype(np.int64)
        else:
            part = np.repeat(rows["part"].to_numpy(), [len(x) for x in hashes])
        by = np.argsort(value, kind="stable")
        value, rank, part = value[by], rank[by], part[by]
        edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, edge), np.diff(np.append(edge, len(value))))
        late = rank > least
        value, part = value[late], part[late]
        by = np.argsort(part, kind="stable")
        value, part, bucket = value[by], part[by], int(rows["to"].iloc[0])
        if per_range == 1:
            out = [(k, bucket, _packed(value[a:b])) for a, b, k in _cuts(part)]
            return pd.DataFrame(out, columns=["part", "bucket", "hashes"])
        whole = value * buckets + np.uint64(bucket)
        out = [(k, _packed(part[a:b].view(np.uint64)), _packed(whole[a:b])) for a, b, k in _cuts(part // per_range)]
        return pd.DataFrame(out, columns=["range", "parts", "hashes"])

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(_: np.ndarray, part: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            by = np.lexsort((value, part))
            part, value = part[by].astype(np.int64), value[by]
            rows = [(k, _packed(value[a:b])) for a, b, k in _cuts(part)]
            # no bucket: the hashes are whole
            columns = [pa.array([k for k, _ in rows], type=pa.int64()), pa.array([-1] * len(rows), type=pa.int64()), pa.array([x for _, x in rows], type=pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "bucket", "hashes"])

        return _split(batches, flush)

    def remove(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"rank": [], "gap": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []})
        frame = order(rows)
        # a bucket's hashes come as their quotients by the number of buckets
        late = [_unpacked(x) * buckets + np.uint64(bucket) if bucket >= 0 else _unpacked(x) for bucket, x in zip(answers["bucket"], answers["hashes"], strict=True)]
        late = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *late]))
        value, rank = smallest(frame)
        out = []
        for ranks, texts, (found, begin, hashes, distinct, code) in windows_of(frame):
            owner = np.searchsorted(found.first, begin, side="right") - 1
            hit = rank[np.searchsorted(value, hashes)] < ranks[owner] if len(begin) else np.zeros(0, dtype=bool)
            if len(late):
                at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
                hit |= late[at] == hashes
            step = np.zeros(len(code) + 1, dtype=np.int64)
            np.add.at(step, begin[hit], 1)
            np.add.at(step, begin[hit] + width, -1)
            gone = np.cumsum(step[:-1]) > 0
            word = np.array([x.decode() for x in distinct] or [""], dtype=object)[code]
            first = found.first.tolist()
            for a, b in zip(first[:-1], first[1:], strict=True):
                lost = gone[a:b]
                edges = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                out.append((b - a, int(lost.sum()), " ".join(word[a:b][~lost]), edges.tolist()))
        done = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "removed"])
        done.insert(0, "rank", frame["rank"].to_numpy())
        done.insert(1, "gap", frame["gap"].to_numpy())
        return done

    sent = dealt.groupBy("part").applyInPandas(send, "to bigint, part bigint, hashes binary, ids binary")
    if per_range == 1:
        answers = sent.repartition(tasks, "to").groupBy("to").applyInPandas(answer, "part bigint, bucket bigint, hashes binary")
    else:
        split = sent.repartition(ranges, "to").mapInArrow(to_buckets, "to bigint, parts binary, hashes binary, ids binary")
        found = split.repartition(tasks, "to").groupBy("to").applyInPandas(answer, "range bigint, parts binary, hashes binary")
        answers = found.repartition(ranges, "range").mapInArrow(to_parts, "part bigint, bucket bigint, hashes binary")
    done = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(remove, "rank bigint, gap boolean, n_words bigint, n_removed bigint, kept_text string, removed array<array<int>>")
    spans = F.transform("removed", lambda x: F.struct(x[0].alias("start"), x[1].alias("end")))
    return done.select(F.when(~F.col("gap"), F.col("rank")).cast(kind).alias(id_column), "n_words", "n_removed", "kept_text", spans.alias("removed"))
