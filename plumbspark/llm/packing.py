"""Mixture-controlled packing: every window takes its share of each source, by deficit round-robin."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import cached_property, lru_cache
from math import ceil, lcm

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.ids import integer_id, rank_and_gap
from plumbspark.llm.storage import cut
from plumbspark.llm.text import blocks
from plumbspark.llm.tokens import WordTokenizer, encoded

#: Tokens of one bucket of a source's queue: what a task holds at a time, beside its longest document.
BUCKET_TOKENS = 1_000_000

#: Target shares are read as fractions with at most this denominator.
DENOMINATOR = 1_000_000


class Schedule:
    """Deficit round-robin over queues of known length, in closed form.

    Queue ``q`` is owed ``window * share`` tokens a window.  It is served whole tokens; the
    fraction it is still owed is its deficit and carries on.  With ``F(q, v)`` for what queues
    ``0..q`` are owed once ``v`` tokens are out, these queues have got exactly
    ``floor(F(q, v))`` then: every window is full, no queue is ever a token or more away
    from what it is owed, and the deficits before any window follow from its number, so
    that no partition has to run the rounds before its own.  Shares of queues that
    run out go to the others in proportion to theirs.
    """

    def __init__(self, totals: list[int], shares: list[Fraction], window: int) -> None:
        self.window, self.total, self.totals = window, sum(totals), totals
        self.sequences = -(-self.total // window)
        scale = lcm(1, *(x.denominator for x in shares))
        #: Shares as whole numbers, and the queues in the order in which they run out.
        self.weights = [int(x * scale) for x in shares]
        self.order = sorted((q for q, n in enumerate(totals) if n and self.weights[q]), key=lambda q: Fraction(totals[q], self.weights[q]))
        self.last = [q for q, n in enumerate(totals) if n and not self.weights[q]]
        # until the next queue runs out, those left share what comes by weight
        gone, weight, at = 0, sum(self.weights[q] for q in self.order), Fraction(0)
        #: Of each phase the first position, the tokens of queues that ran out before, and the weight of those left.
        self.phases: list[tuple[int, int, int]] = []
        for q in self.order:
            self.phases.append((ceil(at), gone, weight))
            at = gone + weight * Fraction(totals[q], self.weights[q])
            gone += totals[q]
            weight -= self.weights[q]
        if self.last:
            # queues without a share come after all others, in proportion to their tokens
            self.phases.append((gone, gone, sum(totals[q] for q in self.last)))

    @cached_property
    def _begins(self) -> list[int]:
        return [at for at, _, _ in self.phases]

    @lru_cache(maxsize=64)  # noqa: B019
    def _lines(self, queues: int) -> list[tuple[int, int]]:
        """For each phase the tokens of those of the first ``queues`` that ran out, and the weight of the others."""
        gone, weight, lines = 0, sum(self.weights[q] for q in self.order if q < queues), []
        for q in self.order:
            lines.append((gone, weight))
            if q < queues:
                gone += self.totals[q]
                weight -= self.weights[q]
        if self.last:
            lines.append((gone, sum(self.totals[q] for q in self.last if q < queues)))
        return lines

    def served(self, queues: int, sequence: int) -> int:
        """Tokens that the first ``queues`` queues have got before ``sequence`` begins."""
        if not self.phases:
            return 0
        v = min(sequence * self.window, self.total)
        k = bisect_right(self._begins, v) - 1
        _, before, weight = self.phases[k]
        gone, own = self._lines(queues)[k]
        return gone + own * (v - before) // weight

    def cuts(self, queue: int, begin: int, end: int) -> tuple[int, list[int], list[int]]:
        """For the queue's tokens ``begin..end``: the first sequence that takes some, then for
        each sequence up to the last that does, and one more, the queue's tokens before it
        and those of earlier queues within it."""
        low, high = 0, self.sequences
        while high - low > 1:
            middle = (low + high) // 2
            taken = self.served(queue + 1, middle) - self.served(queue, middle)
            low, high = (middle, high) if taken <= begin else (low, middle)
        first, before, within = low, [], []
        earlier = self.served(queue, low)
        while True:
            before.append(self.served(queue + 1, low) - earlier)
            following = self.served(queue, low + 1)
            within.append(following - earlier)
            if before[-1] >= end:
                return first, before, within
            earlier = following
            low += 1


def _queues(totals: dict[str | None, int], total: int, targets: Mapping[str, float], window: int) -> tuple[list[str | None], list[int], list[Fraction]]:
    """Named queues, then the shared one; tokens and share of each.

    ``totals`` has the named sources and those whose natural part of a window is a token or more.
    """
    named = {s: Fraction(targets[s]).limit_denominator(DENOMINATOR) for s in targets if totals.get(s)}
    rest = max(Fraction(0), 1 - sum((Fraction(x).limit_denominator(DENOMINATOR) for x in targets.values()), Fraction(0)))
    others = total - sum(totals[s] for s in named)
    part = rest or Fraction(1)
    single = sorted((s for s in totals if s not in named), key=lambda s: (-totals[s], s is None, s or ""))
    while single and part * totals[single[-1]] * window < others:
        single.pop()
    shared = others - sum(totals[s] for s in single)
    while shared and single and part * shared * window < others:
        shared += totals[single.pop()]
    names = [*sorted(named), *single]
    lengths = [*(totals[s] for s in names), shared]
    shares = [named[s] if s in named else rest * Fraction(totals[s], others) for s in names]
    shares.append(max(rest * Fraction(shared, others), Fraction(1, window)) if shared and rest else Fraction(0))
    return names, lengths, shares


def pack_documents(documents: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", targets: Mapping[str, float] | None = None, window: int = 4096, end_id: int = 2, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Pack every token of every document into sequences of ``window`` tokens that hold the target mixture.

    ``targets`` gives the share of each window by source; sources that it doesn't name
    share the rest in proportion to their tokens, which without ``targets`` makes every
    window a sample of the corpus' own mixture.  Each source is a queue of its documents,
    dealt into buckets by a hash of id and tokens.  Sources whose part of a window is under one token
    share one queue, so that there are never more than ``window`` queues, whatever the
    number of sources.  A source of any size is many buckets, and every bucket is cut
    where :class:`Schedule` says, on its own.  All sequences but the last are full.

    1. Tokenize once; ids go to the checkpoint folder.
    2. Sum tokens by source, and by queue and bucket; running sums place each bucket.
    3. Cut each bucket's documents at the borders of sequences.

    Returns ``id_column, start, length, ids, doc_tokens, sequence_id, offset, source``, one row
    per piece; ``ids`` are little-endian unsigned 32-bit numbers.  Each document ends with
    ``end_id``, a NULL or empty text is that id alone, and a very long one is cut like any
    other.  A NULL source is a source; NULL and repeated ids are documents of their own, and
    ids are whole numbers, or ValueError is raised; other columns are ignored; an empty table
    gives no pieces.
    """
    if any(x * window < 1 for x in (targets or {}).values()) or sum((targets or {}).values()) > 1 + 1e-9:
        raise ValueError("each target needs one token a window, and their sum is 1 at most")

    WordTokenizer(tokenizer_path)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        narrow = tokenizer.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        for rows, texts in blocks(batches, "text"):
            ids, sizes = encoded(tokenizer, texts, end_id)
            data = ids.astype("<u2" if narrow else "<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)]) * (2 if narrow else 4)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(sizes.astype(np.int64)), binary], names=["rank", "gap", "source", "n", "ids"])

    kind = documents.schema[id_column].dataType
    spark = documents.sparkSession
    picked = documents.select(*rank_and_gap(integer_id(documents, id_column)), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text"))
    tokens = cut(picked.mapInArrow(tokenize, "rank bigint, gap boolean, source string, n bigint, ids binary"))
    by_source = cut(tokens.groupBy("source").agg(F.sum("n").alias("n")))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    # at most as many sources as a window has tokens, and those that targets name
    large = by_source.where((F.col("n") * window >= total) | F.col("source").isin(list(targets or {}))).collect()
    names, lengths, shares = _queues({x["source"]: x["n"] for x in large}, total, targets or {}, window)
    schedule = Schedule(lengths, shares, window)
    shared = len(names)

    queues = spark.createDataFrame([(s, i, max(1, -(-lengths[i] // bucket_tokens))) for i, s in enumerate(names)] or [(None, -1, 1)], "name string, queue int, buckets bigint").where("queue >= 0")
    # never more queues than a window has tokens
    placed = tokens.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("name")), "left")
    placed = placed.select("rank", "gap", "source", "n", "ids", F.coalesce("queue", F.lit(shared)).alias("queue"), F.coalesce("buckets", F.lit(max(1, -(-lengths[shared] // bucket_tokens)))).alias("buckets"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("rank", "ids"), "buckets")).drop("buckets")
    sums = placed.groupBy("queue", "bucket").agg(F.sum("n").alias("n"))
    begins = sums.select(F.col("queue").alias("to_queue"), F.col("bucket").alias("to_bucket"), F.expr("sum(n) OVER (PARTITION BY queue ORDER BY bucket ROWS UNBOUNDED PRECEDING) - n").alias("begin"))

    def pieces(rows: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "gap", "n", "ids"], kind="stable")
        size = rows["n"].to_numpy()
        data = b"".join(rows["ids"])
        ids = np.frombuffer(data, dtype="<u2" if len(data) == 2 * size.sum() else "<u4").astype("<u4")
        begin = int(place["begin"].iloc[0])
        # positions are counted from the bucket's first token
        first, before, within = schedule.cuts(int(rows["queue"].iloc[0]), begin, begin + len(ids))
        edges = np.array([x - begin for x in before], dtype=np.int64)
        within = np.array(within, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.union1d(starts, edges[(edges > 0) & (edges < len(ids))])
        length = np.diff(np.append(at, len(ids)))
        owner = np.searchsorted(starts, at, side="right") - 1
        sequence = np.searchsorted(edges, at, side="right") - 1
        raw = ids.tobytes()
        document = rows.iloc[owner]
        return pd.DataFrame({
            "rank": document["rank"].to_numpy(), "gap": document["gap"].to_numpy(), "start": at - starts[owner], "length": length,
            "ids": [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)],
            "doc_tokens": size[owner], "sequence_id": first + sequence, "offset": within[sequence] + at - edges[sequence], "source": document["source"].to_numpy(),
        })

    # tasks follow the number of buckets, a few of them each
    n_buckets = sum(max(1, -(-n // bucket_tokens)) for n in lengths)
    tasks = min(100_000, -(-n_buckets // 4))
    placed, begins = placed.repartition(tasks, "queue", "bucket"), begins.repartition(tasks, "to_queue", "to_bucket")
    grouped = placed.groupBy("queue", "bucket").cogroup(begins.groupBy("to_queue", "to_bucket"))
    done = grouped.applyInPandas(pieces, "rank bigint, gap boolean, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, source string")
    ident = F.when(~F.col("gap"), F.col("rank")).cast(kind).alias(id_column)
    return done.select(ident, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source")
