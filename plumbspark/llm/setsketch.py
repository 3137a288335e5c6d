"""MinHash near-duplicates by SetSketch registers: bands find candidates, a likelihood thins them, whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from plumbspark.llm.components import component_roots
from plumbspark.llm.storage import cut
from plumbspark.llm.text import LOWER, Texts, blocks, mixed
from plumbspark.llm.windows import window_hashes

#: Base of the registers' spacing, and registers in a band and bands.
BASE, BAND, BANDS = 1.1, 5, 32

REGISTERS = BAND * BANDS

#: A register is zero from this minimum on, and 255 at ``BASE`` to the power of -255 of it.
ZERO = 20.0

#: Standard deviations under the wanted similarity at which a candidate is left out.
DEVIATIONS = 6.0

#: Nodes of one band key that are compared by registers; a larger key's are all candidates of its first.
KEY_NODES = 16_384

#: Shingles that one task compares at a time as whole sets; larger groups are dealt out in tiles.
TILE_SHINGLES = 1 << 20

#: Bytes of texts that a worker sketches at a time.
SKETCH_BYTES = 1 << 20

_ADD, _STEP = np.random.default_rng(13).integers(0, 1 << 32, (2, REGISTERS), dtype=np.uint32) | np.array([[0], [1]], dtype=np.uint32)


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text's shingles; those of text ``i`` are ``first[i]:first[i + 1]``.

    A text of fewer words, but one at least, has its whole sequence as its only shingle.
    """
    low = Texts(LOWER[texts.data], texts.offsets)
    found, at, value, distinct, code = window_hashes(low, width)
    owner = np.searchsorted(found.first, at, side="right") - 1
    n = np.diff(found.first)
    short = np.flatnonzero((n > 0) & (n < width))
    whole = [xxhash.xxh64_intdigest(b" ".join(distinct[c] for c in code[found.first[i] : found.first[i + 1]].tolist())) for i in short.tolist()]
    owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def registers(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SetSketch of every set, ``REGISTERS`` bytes each.

    A register is the number of steps of ``BASE`` by which the smallest of the set's
    exponentially distributed hashes lies under ``ZERO``, from 0 to 255.  The sketch of a
    union is the larger of each two registers.
    """
    out = np.zeros((len(first) - 1, REGISTERS), dtype=np.uint8)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    short = (mixed(value) >> np.uint64(32)).astype(np.uint32)
    begin = first[some]
    for k in range(REGISTERS):
        least = np.minimum.reduceat((short ^ _ADD[k]) * _STEP[k], begin)
        # the hash is uniform; its minimum becomes that of exponentials
        smallest = -np.log1p(-(least + 0.5) / 2.0**32)
        out[some, k] = np.clip(np.floor(1 + (log(ZERO) - np.log(smallest)) / log(BASE)), 0, 255)
    return out


def _chance(x: np.ndarray) -> np.ndarray:
    """How likely the register of one set is above that of another, ``x`` being its own share of the rate."""
    return -np.log1p(-x * (BASE - 1) / BASE) / log(BASE)


def _slope(j: np.ndarray, above: np.ndarray, below: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The derivative by ``j`` of the log-likelihood of registers ``above``, ``below`` and the ``same``."""
    scale = (BASE - 1) / (BASE * log(BASE))

    def steep(x: np.ndarray) -> np.ndarray:
        return scale / (1 - x * (BASE - 1) / BASE)

    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    p, q = _chance(x), _chance(y)
    dp, dq = -v * steep(x), -u * steep(y)
    return above * dp / p + below * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def likely_jaccard(one: np.ndarray, other: np.ndarray, one_size: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """The Jaccard similarity under which the registers of two sets of known sizes are likeliest.

    The likelihood has one maximum between 0 and the ratio of the sizes, found by halving.
    """
    counts = _compared(one, other, one_size, other_size)
    low, high = np.zeros(len(one)), np.minimum(one_size / other_size, other_size / one_size).astype(float)
    for _ in range(40):
        middle = (low + high) / 2
        rising = _slope(middle, *counts) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def _compared(one: np.ndarray, other: np.ndarray, one_size: np.ndarray, other_size: np.ndarray) -> tuple[np.ndarray, ...]:
    above, below = (one > other).sum(axis=-1), (one < other).sum(axis=-1)
    total = one_size + other_size
    return above, below, one.shape[-1] - above - below, one_size / total, other_size / total


def likely_alike(one: np.ndarray, other: np.ndarray, one_size: np.ndarray, other_size: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets may be ``similarity`` alike: their likeliest similarity is not ``DEVIATIONS`` lower.

    Sizes further apart than ``similarity`` rule it out.
    """
    least = similarity - DEVIATIONS * sqrt(similarity * (1 - similarity) / REGISTERS)
    sizes = np.minimum(one_size, other_size) >= similarity * np.maximum(one_size, other_size)
    # the likelihood still rises there, so its maximum lies above
    return sizes & (_slope(np.float64(least), *_compared(one, other, one_size, other_size)) > 0)


def _band_edges(frame: pd.DataFrame, similarity: float) -> pa.RecordBatch:
    """Edges that connect the nodes of every key that may be alike, as a spanning forest of each key."""
    node, size = frame["node"].to_numpy(), frame["size"].to_numpy()
    sketch = np.frombuffer(b"".join(frame["registers"]), dtype=np.uint8).reshape(len(frame), -1)
    key = frame["key"].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(begin[1:], len(key))

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return likely_alike(sketch[i], sketch[j], size[i], size[j], similarity)

    pair = begin[end - begin == 2]
    pair = pair[near(pair, pair + 1)]
    left, right = [node[pair]], [node[pair + 1]]
    for a, b in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
        open_ = np.arange(a, b)
        while len(open_) > 1:
            frontier, open_ = [open_[0]], open_[1:]
            while frontier and len(open_):
                at = frontier.pop()
                close = near(np.full(len(open_), at), open_)
                new, open_ = open_[close], open_[~close]
                left.append(np.full(len(new), node[at]))
                right.append(node[new])
                frontier += new.tolist()
    return _edges(np.concatenate(left), np.concatenate(right))


def _edges(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])


def candidate_edges(nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` between ``nodes`` (``node, size, registers``) that may be alike.

    Nodes with the same registers in one of the bands meet under that band's key.  Within a
    key they are compared by registers, and connected by a spanning forest.  In a key of more
    than ``KEY_NODES`` all are candidates of the smallest node, without comparing them.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(node), BANDS, BAND)
            value = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(node), BANDS)).copy()
            for k in range(BAND):
                value = mixed(value * np.uint64(256) + sketch[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(value.ravel().view(np.int64)), pa.array(np.repeat(node, BANDS))], names=["key", "node"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = pd.DataFrame()
        for batch in batches:
            frame = batch.to_pandas()
            rest = pd.concat([rest, frame], ignore_index=True) if len(rest) else frame
            at = int(np.searchsorted(rest["key"].to_numpy(), rest["key"].iloc[-1])) if len(rest) else 0
            if at:
                yield _band_edges(rest.iloc[:at], similarity)
                rest = rest.iloc[at:]
        if len(rest):
            yield _band_edges(rest, similarity)

    keyed = nodes.select("node", "registers").mapInArrow(keys, "key bigint, node bigint")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    shared = cut(keyed.join(counted, "key"))
    compared = shared.where(F.col("n") <= KEY_NODES).select("key", "node").join(nodes, "node")
    found = compared.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "size", "registers").mapInArrow(links, "a bigint, b bigint")
    stars = shared.where((F.col("n") > KEY_NODES) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return found.union(stars).distinct()


def _alike(left: pd.DataFrame, right: pd.DataFrame | None, similarity: float) -> pa.Table:
    """Edges that connect the sets of ``left`` that are alike, or those of ``left`` with those of ``right``.

    Rows are ``node, shingles``.  A set that is found is not looked for again: within one
    group the edges are a spanning forest.  Between two groups every set of ``left`` meets
    all of ``right``.
    """
    frame = left if right is None else pd.concat([left, right], ignore_index=True)
    node = frame["node"].to_numpy()
    sizes = frame["shingles"].map(len).to_numpy() // 8
    code = pd.factorize(np.frombuffer(b"".join(frame["shingles"]), dtype=np.uint64))[0]
    begin = np.cumsum(sizes) - sizes
    inside = np.zeros(int(code.max(initial=-1)) + 1, dtype=bool)
    out = [(node[:0], node[:0])]

    def close_to(at: int, others: np.ndarray, shingles: np.ndarray) -> np.ndarray:
        own = code[begin[at] : begin[at] + sizes[at]]
        inside[own] = True
        common = np.add.reduceat(inside[shingles], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        inside[own] = False
        # as integers up to 2**53 and their quotient rounded once, this is exact
        return common / (sizes[at] + sizes[others] - common) >= similarity

    if right is not None:
        others = np.arange(len(left), len(frame))
        for at in range(len(left) if len(others) else 0):
            close = others[close_to(at, others, code[begin[len(left)] :])]
            close = close[node[close] != node[at]]
            out.append((np.full(len(close), node[at]), node[close]))
    else:
        open_, rest = np.arange(len(frame)), code
        frontier: list[int] = []
        while len(open_):
            if not frontier:
                frontier, rest, open_ = [int(open_[0])], rest[sizes[open_[0]] :], open_[1:]
                continue
            at = frontier.pop()
            close = close_to(at, open_, rest)
            if close.any():
                new = open_[close]
                out.append((np.full(len(new), node[at]), node[new]))
                frontier += new.tolist()
                rest = rest[np.repeat(~close, sizes[open_])]
                open_ = open_[~close]
    return pa.Table.from_batches([_edges(*(np.concatenate(x) for x in zip(*out, strict=True)))])


def confirmed_edges(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` that connect all nodes of a candidate component whose sets are ``similarity`` alike.

    ``sets`` has ``node, shingles`` and ``members`` ``node, root, size``.  A component of up to
    ``TILE_SHINGLES`` is compared in one task.  A larger one is dealt out in tiles, to each
    of which its first node is added: copies of one text come together there and are
    settled.  Only nodes that this leaves apart from the first go on to meet all tiles.
    """
    totals = members.groupBy("root").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), "tiles").cast("int")
    dealt = cut(members.join(totals, "root").select("node", "root", "tiles", own.alias("tile")))
    here = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    rows = dealt.select("node", "root", F.explode(here).alias("tile")).join(sets, "node")

    def within(group: pa.Table) -> pa.Table:
        return _alike(group.select(["node", "shingles"]).to_pandas().sort_values("node", ignore_index=True), None, similarity)

    edges = cut(rows.groupBy("root", "tile").applyInArrow(within, "a bigint, b bigint"))
    large = dealt.where("tiles > 1")
    if large.isEmpty():
        return edges
    pieces = component_roots(edges).withColumnRenamed("root", "piece").withColumnRenamed("node", "member")
    apart = large.join(pieces, large.node == pieces.member, "left").where(F.coalesce("piece", "node") != F.col("root")).select("node", "root")
    weighed = apart.join(members.select("node", "size"), "node")
    rows_of = weighed.groupBy("root").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("row_tiles"))
    left = weighed.join(rows_of, "root").join(totals, "root")
    left = left.select("node", "root", F.pmod(F.xxhash64("node"), "row_tiles").cast("int").alias("row_tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    right = large.join(rows_of, "root").select("node", "root", F.explode(F.sequence(F.lit(0), F.col("row_tiles") - 1)).alias("row_tile"), "tile")

    def across(one: pa.Table, other: pa.Table) -> pa.Table:
        return _alike(one.select(["node", "shingles"]).to_pandas(), other.select(["node", "shingles"]).to_pandas(), similarity)

    by = ["root", "row_tile", "tile"]
    columns = ["node", "shingles", *by]
    # the same tables are on both sides; new names of columns tell them apart
    one = left.join(sets, "node").select(columns).toDF(*columns)
    other = right.join(sets, "node").select(columns).toDF(*columns)
    found = one.groupBy(*by).cogroup(other.groupBy(*by)).applyInArrow(across, "a bigint, b bigint")
    return edges.union(found)


def minhash_components(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 3, similarity: float = 0.85) -> DataFrame:
    """The component of every document over links between sets of shingles ``similarity`` alike, by Jaccard.

    A document's set are the distinct shingles of ``width`` words of its whole text, A-Z in
    lower case; with fewer words its whole sequence.

    1. Documents with the same words are one node, so that any number of copies costs one.
    2. Nodes that agree in all registers of any of ``BANDS`` bands meet; of two sets just
       ``similarity`` alike none does with a chance of about 3e-9, for 0.85.
    3. From the registers and sizes of both comes the likeliest similarity; pairs six
       standard deviations too low are left out, of those alike one in 1e9 or so.
    4. Whole sets decide on what is left, between all nodes that candidates connect.

    Returns ``id_column, n_shingles, component_id, kept``, one row per input row: the smallest
    id of the component, and whether it is the row's own.  NULL and empty texts, and those
    without a word, have no shingle and are linked with nothing.  A NULL id gets the smallest
    id of its component that is not NULL, if any, and is kept if there is none; rows with the
    same id are linked by their texts only.  Very long texts are read whole, an empty table
    gives no rows, and other columns are ignored.
    """
    id_field = StructField("id", documents.schema[id_column].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text", SKETCH_BYTES):
            value, first = shingle_sets(texts, width)
            sketch = pa.array([x.tobytes() for x in registers(value, first)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(text_keys(texts), type=pa.binary()), pa.array(np.diff(first)), sketch], names=["id", "words", "size", "registers"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, "text", SKETCH_BYTES):
            value, first = shingle_sets(texts, width)
            shingles = [value[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text_keys(texts), type=pa.binary()), pa.array(shingles, type=pa.binary())], names=["words", "shingles"])

    picked = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = StructType([id_field, StructField("words", BinaryType()), StructField("size", LongType()), StructField("registers", BinaryType())])
    marked = cut(picked.mapInArrow(scan, schema))
    of_words = marked.where("size > 0").groupBy("words")
    nodes = of_words.agg(F.min("id").alias("first_id"), F.min("size").alias("size"), F.min("registers").alias("registers"))
    # written once, so that a node keeps its number
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    candidates = component_roots(candidate_edges(nodes.select("node", "size", "registers"), similarity))
    members = cut(candidates.join(nodes.select("node", "words", "first_id", "size"), "node"))
    wanted = members.select("first_id").distinct()
    read = picked.join(wanted, picked.id.eqNullSafe(wanted.first_id), "left_semi").select("text").mapInArrow(sets, "words binary, shingles binary")
    # of the rows with one id several texts may come, and copies of one text
    whole = read.join(members.select("words", "node"), "words").groupBy("node").agg(F.first("shingles").alias("shingles"))
    links = confirmed_edges(whole, members.select("node", "root", "size"), similarity)
    roots = component_roots(links).withColumnRenamed("node", "member")
    classes = nodes.select("node", "words", "first_id").join(roots, nodes.node == roots.member, "left").select("words", F.coalesce("root", "node").alias("root"), "first_id")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select("words", "component_id", F.lit(True).alias("linked"))
    done = marked.select("id", "words", "size").join(named, "words", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    done = done.select(F.col("id").alias(id_column), F.col("size").alias("n_shingles"), component.alias("component_id"))
    return done.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def text_keys(texts: Texts) -> list[bytes]:
    """128 bits of every text's words in their order, by which copies are known."""
    raw = LOWER[texts.data].tobytes()
    cuts = texts.offsets.tolist()
    return [xxhash.xxh3_128_digest(b" ".join(raw[a:b].split())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
