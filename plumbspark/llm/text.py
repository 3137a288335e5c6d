"""Whole texts of an Arrow batch as numpy arrays: bytes, runs, words and dictionary codes.

All operators of this subpackage that run Python read texts through this module.  A
batch is handled in blocks of bounded size (a single longer text is a block of its own),
so a task's memory follows its longest text and not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20

#: Bytes of runs that are hashed at a time: they take eight 64-bit numbers each, and the powers are kept.
HASH_BYTES = 256 << 10

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Texts:
    """The bytes of some texts, one after the other; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Runs:
    """Byte ranges in text order; those of text ``i`` are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches into row ranges of at most ``limit`` bytes of ``column``; a NULL text is empty."""
    for batch in batches:
        values = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        values = values.cast(pa.large_binary())
        ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
        data = values.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        low = 0
        while low < len(values):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, side="right")) - 1)
            yield batch.slice(low, high - low), Texts(data[ends[low] : ends[high]], ends[low : high + 1] - ends[low])
            low = high


def runs(texts: Texts, inside: np.ndarray) -> Runs:
    """Maximal runs of bytes for which ``inside`` holds, never across two texts."""
    size = len(texts.data)
    edge = np.zeros(size + 1, dtype=bool)
    edge[texts.offsets] = True
    before = np.empty(size + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(size + 1, dtype=bool)
    after[:-1] = inside
    after[-1] = False
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Runs(start, end, np.searchsorted(start, texts.offsets))


def words(texts: Texts) -> Runs:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(texts, ~SPACE[texts.data])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """``base`` to the powers ``0..count`` modulo 2**64."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) <= count:
        kept = np.full(count + 1, base, dtype=np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if count <= 2 * HASH_BYTES:
            _powers[int(base)] = kept
    return kept


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers after which every bit depends on all."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def run_hashes(data: np.ndarray, found: Runs) -> np.ndarray:
    """A 64-bit polynomial hash of every run's bytes, the same in every text and process."""
    out = np.empty(len(found.start), dtype=np.uint64)
    low = 0
    while low < len(out):
        base = found.start[low]
        high = max(low + 1, int(np.searchsorted(found.end, base + HASH_BYTES, side="right")))
        part = data[base : found.end[high - 1]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[part] * powers(_BASE, len(part))[: len(part)], out=sums[1:])
        start, end = found.start[low:high] - base, found.end[low:high] - base
        value = (sums[end] - sums[start]) * powers(_BASE_INVERSE, len(part))[start]
        out[low:high] = mixed(value + (end - start).astype(np.uint64) * _BASE_INVERSE)
        low = high
    return out


def codes(data: np.ndarray, found: Runs) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A number for each run; the distinct runs in the order of these numbers, and their hashes."""
    code, hashes = pd.factorize(run_hashes(data, found))
    first = np.empty(len(hashes), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    raw = data.tobytes()
    distinct = [raw[a:b] for a, b in zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)]
    return code, distinct, hashes


def per_text(found: Runs, values: np.ndarray) -> np.ndarray:
    """Sums of one value a run, by text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[found.first[1:]] - total[found.first[:-1]]


def gather(lists: list[bytes], picked: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the lists numbered ``picked``, one list after the other, and the length of each."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(lists), dtype=kind)
    begins = np.cumsum(sizes) - sizes
    lengths = sizes[picked]
    where = np.repeat(begins[picked] - (np.cumsum(lengths) - lengths), lengths)
    where += np.arange(len(where))
    return flat[where], lengths
