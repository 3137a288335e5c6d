"""Spelling variants: words one edit apart, found by tiles of padded code-point matrices."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.storage import cut
from plumbspark.llm.text import LOWER, Runs, Texts, blocks, codes, runs

#: Words of one key that are compared in one go; larger keys are dealt out in tiles.
TILE = 4096

#: Words, each under all its keys, that a task compares with each other.
TASK_WORDS = 12_500

#: Code points of word pairs that are compared at a time.
PAIR_POINTS = 1 << 23

#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000

#: Runs of up to so many bytes get their checksum by tables, longer ones one by one.
TABLE_BYTES = 256

_CRC_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)
_shifts: dict[int, np.ndarray] = {}


def _shift_tables(length: int) -> np.ndarray:
    """What ``length`` zero bytes make of a checksum, as one table for each of its four bytes."""
    if length not in _shifts:
        values = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for _ in range(length):
            values = (values >> np.uint32(8)) ^ _CRC_STEP[values & np.uint32(0xFF)]
        _shifts[length] = values
    return _shifts[length]


def followed_by(before: np.ndarray, owner: np.ndarray, parts: list[bytes], code: np.ndarray) -> np.ndarray:
    """The CRC-32 of some bytes with checksum ``before[owner]`` followed by ``parts[code]``, for each pair."""
    own = np.fromiter(map(zlib.crc32, parts), dtype=np.uint32, count=len(parts))
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))[code]
    out = np.zeros(len(code), dtype=np.uint32)
    by = np.argsort(lengths, kind="stable")
    edge = np.flatnonzero(np.diff(lengths[by], prepend=-1))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(by)], strict=True):
        at, length = by[a:b], int(lengths[by[a]])
        first = before[owner[at]]
        if length > TABLE_BYTES:
            out[at] = [zlib.crc32(parts[c], int(x)) for c, x in zip(code[at].tolist(), first.tolist(), strict=True)]
            continue
        table = _shift_tables(length)
        moved = table[0][first & np.uint32(0xFF)]
        for k in (1, 2, 3):
            moved = moved ^ table[k][(first >> np.uint32(8 * k)) & np.uint32(0xFF)]
        out[at] = moved ^ own[code[at]]
    return out


def letter_runs(texts: Texts) -> Runs:
    """Runs ``[A-Za-z\\u00C0-\\u00FF]+``."""
    data = texts.data
    low = data | 0x20
    wide = data == 0xC3  # the first byte of U+00C0 to U+00FF, whose second follows
    inside = ((low >= 0x61) & (low <= 0x7A)) | wide
    inside[1:] |= wide[:-1]
    return runs(texts, inside)


def words_of(names: list[str], texts: Texts, least: int, one_of: int) -> Counter:
    """How often each word of ``least`` code points or more comes from these texts.

    A word is a lower-case run; where ``one_of`` divides its checksum after ``<name>:``, it
    lacks the code point that the checksum points to.
    """
    found = letter_runs(texts)
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    size = points[found.end] - points[found.start]
    long = size >= least
    owner = np.searchsorted(found.first, np.flatnonzero(long), side="right") - 1
    kept = Runs(found.start[long], found.end[long], found.first)
    if not len(kept.start):
        return Counter()
    code, distinct, _ = codes(LOWER[texts.data], kept)
    size = size[long]
    before = np.fromiter((zlib.crc32(f"{x}:".encode()) for x in names), dtype=np.uint32, count=len(names))
    checksum = followed_by(before, owner, distinct, code)
    hit = checksum % one_of == 0
    whole = np.bincount(code[~hit], minlength=len(distinct))
    counts = Counter({distinct[c].decode(): int(whole[c]) for c in np.flatnonzero(whole).tolist()})
    hit &= size > least
    shortened = np.stack([code[hit], checksum[hit] % size[hit]], axis=1)
    for (c, at), n in zip(*(x.tolist() for x in np.unique(shortened, axis=0, return_counts=True)), strict=True):
        word = distinct[c].decode()
        counts[word[:at] + word[at + 1 :]] += n
    return counts


def word_counts(documents: DataFrame, *, id_column: str, text_column: str, least: int, one_of: int) -> DataFrame:
    """``word, n`` over all documents; a NULL id is an empty name."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], names=["word", "n"])

        for rows, texts in blocks(batches, "text"):
            counts.update(words_of(rows.column(0).to_pylist(), texts, least, one_of))
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        if counts:
            yield out()

    picked = documents.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(scan, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def single_edits(words: list[str], longest: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs ``left, right`` of words are one edit apart, and how long their common prefixes are.

    ``words`` are distinct and have ``longest`` code points up to U+00FF, or one fewer; a pair
    has one of ``longest`` at least.  Rows of a matrix of code points, padded at the end and
    once more at the front, give common prefix and common suffix; together they reach
    ``longest - 1`` just if one code point is inserted, deleted or replaced.
    """
    raw = [x.encode("latin-1") for x in words]
    front = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in raw), dtype=np.uint8).reshape(-1, longest)
    back = np.frombuffer(b"".join(x[::-1].ljust(longest, b"\0") for x in raw), dtype=np.uint8).reshape(-1, longest)
    prefix = (front[left] != front[right]).argmax(axis=1)
    suffix = (back[left] != back[right]).argmax(axis=1)
    return prefix + suffix >= longest - 1, prefix


def _near(frame: pd.DataFrame, longest: int) -> pa.RecordBatch:
    """Near words of every word, counted and the best of them, from the whole keys of one length."""
    words, n = frame["word"].tolist(), frame["n"].to_numpy()
    whole = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) == longest
    names = ["side", "key", "row_tile", "column_tile"]
    new = (frame[names] != frame[names].shift()).any(axis=1).to_numpy()
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(words))[group]
    # a row meets all after it in its group; between two tiles only those of the other
    own = frame["tile"].to_numpy()
    across = (frame["row_tile"] != frame["column_tile"]).to_numpy()
    first = np.arange(len(words)) + 1
    second = np.searchsorted(group * 2 + (across & (own == frame["column_tile"].to_numpy())), group * 2 + 1)
    first = np.where(across, np.where(own == frame["column_tile"].to_numpy(), end, second), first)
    count = np.maximum(end - first, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    prefix_side = (frame["side"] == 0).to_numpy()
    half = ceil((longest - 1) / 2)
    lefts, rights = [], []
    step = max(1, PAIR_POINTS // longest)
    for low in range(0, int(total[-1]), step):
        index = np.arange(low, min(low + step, int(total[-1])))
        i = np.searchsorted(total, index, side="right") - 1
        j = first[i] + index - total[i]
        # two words one shorter meet under a key of their own length
        useful = whole[i] | whole[j]
        i, j = i[useful], j[useful]
        a, b = int(i.min(initial=0)), int(j.max(initial=-1)) + 1
        if not len(i):
            continue
        near, prefix = single_edits(words[a:b], longest, i - a, j - a)
        # what shares half of the word at either end counts under its first half
        near &= prefix_side[i] | (prefix < half)
        lefts.append(i[near])
        rights.append(j[near])
    i, j = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (lefts, rights))
    one, other = np.concatenate([i, j]), np.concatenate([j, i])
    partner = np.array(words, dtype=object)[other]
    by = np.lexsort((pd.factorize(partner, sort=True)[0], -n[other], one))
    one, other = one[by], other[by]
    at = np.flatnonzero(np.diff(one, prepend=-1))
    picked = one[at]
    arrays = [pa.array([words[k] for k in picked], type=pa.string()), pa.array(np.diff(np.append(at, len(one)))), pa.array(n[other[at]]), pa.array([words[k] for k in other[at]], type=pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of all ``words`` (``word, n``) one edit from another.

    Words of ``L`` and of ``L - 1`` code points one edit apart share their first
    ``ceil((L - 1) / 2)`` code points or else the rest of them at the end.  Each goes to these
    keys; a key's words are compared in tiles of ``TILE``, all pairs of them inside a task, and
    a larger key's tiles meet two by two in tasks of their own.  ``best`` has the largest
    ``n``, then the smallest word.
    """
    keyed = words.withColumn("size", F.length("word")).select("word", "n", F.explode(F.array("size", F.col("size") + 1)).alias("longest"))
    half = "cast(ceil((longest - 1) / 2) AS int)"
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr(f"left(word, {half})").alias("key")), F.struct(F.lit(1).alias("side"), F.expr(f"right(word, longest - {half})").alias("key")))
    keyed = keyed.select("word", "n", "longest", F.inline(sides))
    by = ["longest", "side", "key"]
    # a word one shorter than a key's length needs another of that length
    useful = keyed.groupBy(*by).agg(F.count("*").alias("size"), F.max(F.length("word")).alias("most")).where("size > 1 AND most = longest")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    counted = keyed.join(useful.select(*by, tiles.alias("tiles")), by)
    own = F.pmod(F.xxhash64("word"), "tiles").cast("int").alias("tile")
    met = counted.select("word", "n", *by, own, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
    met = met.select("word", "n", *by, "tile", F.least("tile", "with").alias("row_tile"), F.greatest("tile", "with").alias("column_tile"))
    keys = [*by, "row_tile", "column_tile"]
    # comparing costs far more than the bytes that are read, by which tasks would be joined
    tasks = min(100_000, -(-words.count() // TASK_WORDS) + 1)
    grouped = met.repartition(tasks, *keys).sortWithinPartitions(*keys, "tile")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = pd.DataFrame()
        for batch in batches:
            frame = batch.to_pandas()
            rest = pd.concat([rest, frame], ignore_index=True) if len(rest) else frame
            if not len(rest):
                continue
            open_ = (rest[keys] == rest[keys].iloc[-1]).all(axis=1).to_numpy()
            at = 0 if open_.all() else int(np.flatnonzero(~open_)[-1]) + 1
            for longest, part in rest.iloc[:at].groupby("longest", sort=False):
                yield _near(part.reset_index(drop=True), int(longest))
            rest = rest.iloc[at:]
        if len(rest):
            yield _near(rest.reset_index(drop=True), int(rest["longest"].iloc[0]))

    found = grouped.mapInArrow(near, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus_n"), "best")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.minus_n")).alias("best_n"), "best.best")


def group_spellings(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: int = 7, times: int = 2, ratio: int = 10, one_of: int = 31) -> DataFrame:
    """Words of a corpus, each with the frequent word that it is a variant of.

    Words are runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts with A-Z in lower case; where
    ``one_of`` divides the CRC-32 of ``<id>:<run>``, without the code point that the checksum
    points to.  Those of ``least`` code points and ``times`` occurrences are kept.  A word's
    form is the word one edit away with the largest ``n`` (then the smallest), if that is
    ``ratio`` times its own or more; ``root`` is where following forms ends.

    Returns ``word, form, root, n, n_near, form_n``, one row per word.  NULL and empty texts
    have no words, a NULL id is an empty name, repeated rows count again, very long words
    are compared whole, no words give no rows, and other columns are ignored.
    """
    if least < 3 or ratio < 2:
        raise ValueError("least must be 3 or more, ratio 2 or more")
    counts = word_counts(documents, id_column=id_column, text_column=text_column, least=least, one_of=one_of)
    words = cut(counts.where(F.col("n") >= times))
    best = near_words(words).withColumnRenamed("word", "said")
    is_form = F.col("best_n") >= F.lit(ratio) * F.col("n")
    marked = words.join(best, words.word == best.said, "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    marked = cut(marked)
    jumps = marked.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = marked.agg(F.max("n")).first()[0] or 1
    # every form is ratio times as frequent, so few of them follow each other
    depth = max(1, int(log10(most) / log10(ratio)) + 1)
    for _ in range(ceil(log2(depth))):
        on = jumps.select(F.col("word").alias("via"), F.col("root").alias("end"))
        jumps = cut(jumps.join(on, jumps.root == on.via, "left").select("word", F.coalesce("end", "root").alias("root")))
    ends = jumps.select(F.col("word").alias("said"), "root")
    return marked.join(ends, marked.word == ends.said, "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
