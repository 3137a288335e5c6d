"""SimHash near-duplicates: fingerprints within a few bits, found over shared blocks of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbspark.llm.components import component_roots
from plumbspark.llm.ids import integer_id, quoted
from plumbspark.llm.storage import cut
from plumbspark.llm.text import LOWER, SPACE, Texts, blocks, mixed, words
from plumbspark.llm.windows import window_hashes

#: Blocks that a fingerprint is split into.  Fingerprints within 4 bits share 3 of 7 blocks.
BLOCKS = 7

#: Fingerprints of one block key that are compared in one go; larger keys are dealt out in tiles.
TILE = 16_384


def fingerprints(texts: Texts, width: int) -> np.ndarray:
    """The 64-bit SimHash of every text over its shingles of ``width`` words, repeats included."""
    found = words(texts)
    n = np.diff(found.first)
    blank = SPACE[texts.data]
    kept = ~blank
    spaced = np.where(blank, np.uint8(0x20), LOWER[texts.data])
    # the words of all texts joined by one space, also where two texts meet without one
    lengths = found.end - found.start
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
    joined[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = spaced[kept]
    end = begin + lengths
    last_word = np.repeat(found.first[1:], n) - 1
    index = np.arange(len(lengths))
    starts_here = (index + width - 1 <= last_word) | (index == np.repeat(found.first[:-1], n))
    index = index[starts_here]
    last = np.minimum(index + width - 1, last_word[starts_here])
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], 42) for a, b in zip(begin[index].tolist(), end[last].tolist(), strict=True)), dtype="<u8", count=len(index))
    edge = np.searchsorted(index, found.first)
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(edge[1:] > edge[:-1])
    for low in range(0, len(some), 512):
        rows = some[low : low + 512]
        out[rows] = _majority(hashes[edge[rows[0]] : edge[rows[-1] + 1]], edge[rows] - edge[rows[0]])
    return out


def _majority(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each group of hashes the bits that over half of it have."""
    sizes = np.diff(np.append(begin, len(hashes)))
    out = np.zeros(len(begin), dtype=np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), begin)
        out |= (2 * ones > sizes.astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def _block_keys(fingerprint: Column, shared: int, blocks_of: int) -> Column:
    """One key for each choice of ``shared`` blocks: its number and the chosen bits."""
    edges = [round(64 * i / blocks_of) for i in range(blocks_of + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    chosen = [sum(x) for x in combinations(masks, shared)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chosen]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fingerprint.bitwiseAND(F.lit(x)).alias("bits")) for i, x in enumerate(signed)])


def _links(groups: Iterator[pd.DataFrame], limit: int, least_same: int) -> Iterator[pd.DataFrame]:
    """Edges that connect what is linked within each key with the smallest of it, at most one a node and tile.

    The rows come sorted by key and tile; a group may go on in the next batch.
    """
    rest = pd.DataFrame()
    names = ["choice", "bits", "row_tile", "column_tile"]

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        narrow = frame["fp"].to_numpy().view(np.uint64) if "fp" in frame else None
        sketch = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint8).reshape(len(frame), -1) if "sketch" in frame else None
        node = frame["node"].to_numpy()

        def near(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
            if sketch is not None:
                return (sketch[i] == sketch[j]).sum(axis=1) >= least_same
            return np.bitwise_count(narrow[i] ^ narrow[j]) <= limit

        changed = (frame[names].to_numpy()[1:] != frame[names].to_numpy()[:-1]).any(axis=1)
        begin = np.concatenate([[0], np.flatnonzero(changed) + 1])
        end = np.append(begin[1:], len(node))
        size = end - begin
        pair = begin[size == 2]
        pair = pair[near(pair, pair + 1)]
        left, right = [node[pair]], [node[pair + 1]]
        for a, b in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            open_ = a + np.unique(node[a:b], return_index=True)[1]
            while len(open_) > 1:
                first, frontier, open_ = open_[0], open_[:1], open_[1:]
                while len(frontier) and len(open_):
                    close = near(frontier[0], open_)
                    new = open_[close]
                    left.append(np.full(len(new), node[first]))
                    right.append(node[new])
                    frontier, open_ = np.concatenate([frontier[1:], new]), open_[~close]
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    for frame in groups:
        rest = pd.concat([rest, frame], ignore_index=True) if len(rest) else frame.reset_index(drop=True)
        if not len(rest):
            continue
        last = (rest[names] == rest[names].iloc[-1]).all(axis=1).to_numpy()
        at = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if at:
            yield edges(rest.iloc[:at])
            rest = rest.iloc[at:]
    if len(rest):
        yield edges(rest.reset_index(drop=True))


def near_links(marked: DataFrame, *, limit: int = 4, blocks_of: int = BLOCKS) -> DataFrame:
    """Edges ``a, b`` that connect all nodes with fingerprints within ``limit`` bits.

    ``marked``: distinct ``node, fp``.  Two fingerprints within ``limit`` bits agree in
    ``blocks_of - limit`` whole blocks: each goes to one key for each such choice of blocks.
    """
    keyed = marked.select("*", F.explode(_block_keys(F.col("fp"), blocks_of - limit, blocks_of)).alias("key"))
    return _key_links(keyed.select("node", "fp", "key.choice", "key.bits"), limit=limit)


def fingerprint_links(marked: DataFrame, *, limit: int = 4, blocks_of: int = BLOCKS) -> DataFrame:
    """Edges ``a, b`` that connect all nodes with equal fingerprints, or such within ``limit`` bits.

    ``marked``: one ``node, fp`` each.  Nodes of one fingerprint are linked to the smallest of them, and
    only that meets other fingerprints.
    """
    first = cut(marked.groupBy("fp").agg(F.min("node").alias("first")))
    same = marked.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return same.union(near_links(first.select(F.col("first").alias("node"), "fp"), limit=limit, blocks_of=blocks_of))


def _key_links(keyed: DataFrame, *, limit: int = 0, sketches: DataFrame | None = None, least_same: int = 0) -> DataFrame:
    """Edges ``a, b`` that connect the nodes of every key ``choice, bits`` that are near.

    Near are fingerprints ``fp`` within ``limit`` bits, or, with ``sketches`` (one ``node,
    sketch`` each), sketches with at least ``least_same`` equal bytes.  Within a key linked
    nodes are connected with the smallest of them, not by all their pairs.  A key of more than
    ``TILE`` nodes is dealt out as tiles of ``TILE``, and every two tiles meet in a group of
    their own.
    """
    kept = [x for x in keyed.columns if x not in ("choice", "bits")]
    counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("choice", "bits"))).where("n > 1")
    if sketches is not None:
        # only now, for the few that share a key with another
        counted = counted.join(sketches, "node")
        kept.append("sketch")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    met = counted.select(*kept, "choice", "bits", own.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("with"))
    # the group of two tiles is named by the smaller and the larger of their numbers
    met = met.select(*kept, "choice", "bits", F.least("tile", "with").alias("row_tile"), F.greatest("tile", "with").alias("column_tile"))
    keys = ["choice", "bits", "row_tile", "column_tile"]
    grouped = met.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInPandas(lambda groups: _links(groups, limit, least_same), "a bigint, b bigint")


def simhash_components(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4, limit: int = 4, blocks_of: int = BLOCKS) -> DataFrame:
    """SimHash fingerprint of every document and the smallest id it reaches over links of ``limit`` bits.

    Equal fingerprints are collapsed before anything is joined, so that any number of copies
    costs one fingerprint.  Returns ``id_column, fingerprint, component_id``, one row per
    input row: 16 hexadecimal digits, and the smallest id of the component.  NULL and empty
    texts have fingerprint zero and link like any other.  A NULL id is kept and gets the
    smallest id of its component that is not NULL, if any; ids are whole numbers, or ValueError
    is raised.  Very long texts are read whole, repeated rows give repeated results, an empty
    table gives no rows, and other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints(texts, width).view(np.int64))], names=["id", "fp"])

    kind = documents.schema[id_column].dataType
    picked = documents.select(integer_id(documents, id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    marked = cut(picked.mapInArrow(scan, "id bigint, fp bigint"))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first_id"))
    nodes = distinct.select(F.col("fp").alias("node"), "fp")
    roots = component_roots(near_links(nodes, limit=limit, blocks_of=blocks_of))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    done = marked.join(named, "fp")
    return done.select(F.col("id").cast(kind).alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(kind).alias("component_id"))


#: Distinct shingles on one side of a comparison of whole texts; larger groups are dealt out in tiles.
TILE_SHINGLES = 1 << 20


#: Bytes of texts whose shingles a worker sorts at a time.
SHINGLE_BYTES = 1 << 20


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text's shingles; those of text ``i`` are ``first[i]:first[i + 1]``."""
    found, at, value, _, _ = window_hashes(Texts(LOWER[texts.data], texts.offsets), width)
    owner = np.searchsorted(found.first, at, side="right") - 1
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def text_nodes(texts: Texts) -> np.ndarray:
    """The node of every text: a hash of its words in their order."""
    raw = LOWER[texts.data].tobytes()
    cuts = texts.offsets.tolist()
    nodes = [xxhash.xxh64_intdigest(b" ".join(raw[a:b].split()), 0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.array(nodes, dtype=np.uint64).view(np.int64)


def alike(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Edges that connect the texts of one group whose sets of shingles are ``similarity`` alike, by Jaccard, with the smallest node."""
    group = group.sort_values("node", ignore_index=True)
    node = group["node"].to_numpy()
    sizes = group["shingles"].map(len).to_numpy() // 8
    code = pd.factorize(np.frombuffer(b"".join(group["shingles"]), dtype=np.uint64))[0]
    begin = np.cumsum(sizes) - sizes
    inside = np.zeros(int(code.max(initial=-1)) + 1, dtype=bool)
    left, right = [node[:0]], [node[:0]]
    open_ = np.flatnonzero(sizes)
    rest = code

    def keep(which: np.ndarray) -> None:
        nonlocal open_, rest
        rest = rest[np.repeat(which, sizes[open_])]
        open_ = open_[which]

    while len(open_) > 1:
        first = open_[0]
        frontier = [first]
        keep(np.arange(len(open_)) > 0)
        while frontier and len(open_):
            at = frontier.pop()
            own = code[begin[at] : begin[at] + sizes[at]]
            inside[own] = True
            common = np.add.reduceat(inside[rest], np.cumsum(sizes[open_]) - sizes[open_], dtype=np.int64)
            inside[own] = False
            close = common / (sizes[at] + sizes[open_] - common) >= similarity
            if close.any():
                new = open_[close]
                left.append(np.full(len(new), node[first]))
                right.append(node[new])
                frontier += new.tolist()
                keep(~close)
    return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})


def confirmed_links(texts: DataFrame, candidates: DataFrame, distinct: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """Edges ``a, b`` that connect all nodes of a component of ``candidates`` whose shingles are ``similarity`` alike.

    Components of candidates only say which texts are compared; their whole sets of shingles
    decide.  These sets are read again from ``texts`` (``id, text``), and only those of nodes
    with a candidate; ``distinct`` has each ``node, first_id, size`` and the group ``settled`` that is
    known of it, if any: a component all of one group needs no more links, and is not read.  A
    component of more than ``TILE_SHINGLES`` is dealt out as tiles, and every two tiles meet in a
    group of their own.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in blocks(batches, "text", SHINGLE_BYTES):
            value, first = shingle_sets(found, width)
            sets = [value[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text_nodes(found)), pa.array(sets, type=pa.binary())], names=["member", "shingles"])

    members = component_roots(candidates).join(distinct.select("node", "first_id", "size", "settled"), "node")
    totals = members.groupBy("root").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("tiles"), (F.min("settled") < F.max("settled")).alias("open"))
    members = cut(members.join(totals.where("tiles > 0 and open"), "root"))
    wanted = members.select("first_id").distinct()
    read = texts.join(wanted, texts.id.eqNullSafe(wanted.first_id), "left_semi")
    # of rows with one id several texts may come; nodes tell them apart
    sets = read.select("text").mapInArrow(scan, "member bigint, shingles binary").groupBy("member").agg(F.min("shingles").alias("shingles"))
    tiles = F.col("tiles")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    met = sets.join(members, sets.member == members.node).select("node", "shingles", "root", own.alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("with"))
    keys = ["root", F.least("tile", "with").alias("row_tile"), F.greatest("tile", "with").alias("column_tile")]
    return met.groupBy(*keys).applyInPandas(lambda group: alike(group, similarity), "a bigint, b bigint")


#: Bytes of a sketch of a text's shingles: one byte of the smallest of so many hashes each.
SKETCH = 64

#: Chance with which the sketches of two texts just alike enough may leave the pair out.
LEFT_OUT = 1e-6

#: Documents in which common shingles are looked for, and common shingles at most.
COMMON_DOCUMENTS, COMMON = 10_000, 1 << 17

_SKETCH_ADD, _SKETCH_STEP = np.random.default_rng(21).integers(0, 1 << 63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sketch of every set; two of them have each byte equal with their Jaccard similarity as chance, or a little more."""
    out = np.zeros((len(first) - 1, SKETCH), dtype=np.uint8)
    some = np.flatnonzero(np.diff(first))
    for k in range(SKETCH if len(some) else 0):
        least = np.minimum.reduceat((value ^ _SKETCH_ADD[k]) * _SKETCH_STEP[k], first[some])
        out[some, k] = mixed(least) & np.uint64(0xFF)
    return out


def least_equal(similarity: float, left_out: float) -> int:
    """So many equal bytes have the sketches of texts ``similarity`` alike, but for a chance of ``left_out``."""
    chance = np.cumsum([comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k) for k in range(SKETCH + 1)])
    return int(np.searchsorted(chance, left_out, side="right"))


def prefixes(value: np.ndarray, first: np.ndarray, similarity: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of every set in one order of all shingles, of which two sets ``similarity`` alike share one.

    Such sets share ``similarity`` of the larger; so a set without its last such share, but for one
    shingle, holds the first shingle that both have.  ``common`` shingles, the most common
    last, come after all others, which only makes keys smaller.
    """
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    order = value >> np.uint64(1)
    if len(common):
        by = np.argsort(common)
        at = by[np.minimum(np.searchsorted(common, value, sorter=by), len(common) - 1)]
        order = np.where(common[at] == value, np.uint64(1 << 63) + at.astype(np.uint64), order)
    by = np.lexsort((value, order, owner))
    wanted = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    kept = np.arange(len(value)) - first[:-1][owner] < wanted[owner]
    return value[by][kept], np.concatenate([[0], np.cumsum(np.minimum(wanted, size))])


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that several of about ``COMMON_DOCUMENTS`` texts, picked by a hash, have; the most common last."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in blocks(batches, "text", SHINGLE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(found, width)[0].view(np.int64))], names=["value"])

    share = min(1.0, COMMON_DOCUMENTS / max(texts.count(), 1))
    picked = texts.select("text").where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * share))
    counts = picked.mapInArrow(scan, "value bigint").groupBy("value").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "value").limit(COMMON).select("value").toArrow()
    return top.column(0).to_numpy().view(np.uint64)[::-1].copy()


def _near_classes(picked: DataFrame, *, width: int, similarity: float, left_out: float) -> DataFrame:
    """``id, row, root`` of every row of ``picked`` (``id, row, text``): the class of its near copies.

    SimHash finds the first groups: texts with fingerprints within a few bits, found over shared blocks
    of bits and confirmed by whole sets of shingles.  Texts that are alike but further apart in
    bits share a key of prefixes; whole sets decide on those of different groups.
    """
    common = common_shingles(picked, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text", SHINGLE_BYTES):
            value, first = shingle_sets(texts, width)
            keys, edge = prefixes(value, first, similarity, common)
            keys = pa.ListArray.from_arrays(pa.array(edge, type=pa.int32()), pa.array(keys.view(np.int64)))
            sketch = pa.array([x.tobytes() for x in sketches(value, first)], type=pa.binary())
            marks = [pa.array(text_nodes(texts)), pa.array(fingerprints(texts, width).view(np.int64)), pa.array(np.diff(first)), keys, sketch]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *marks], names=["id", "row", "node", "fp", "size", "keys", "sketch"])

    marked = cut(picked.mapInArrow(scan, "id bigint, row bigint, node bigint, fp bigint, size bigint, keys array<bigint>, sketch binary"))
    least = [F.min(x).alias(x) for x in ("fp", "size", "keys", "sketch")]
    distinct = cut(marked.groupBy("node").agg(F.min("id").alias("first_id"), *least))
    texts = picked.select("id", "text")
    # texts of fewer words than a shingle are like none but their own copies
    close = fingerprint_links(distinct.where("size > 0").select("node", "fp"))
    simhash_links = confirmed_links(texts, close, distinct.withColumn("settled", F.col("node")), width=width, similarity=similarity)
    groups = component_roots(simhash_links).select(F.col("node").alias("a"), F.col("root").alias("b"))
    settled = distinct.join(groups, distinct.node == groups.a, "left").select("node", "first_id", "size", F.coalesce("b", "node").alias("settled"))
    keyed = distinct.select("node", F.lit(0).alias("choice"), F.explode("keys").alias("bits"))
    candidates = _key_links(keyed, sketches=distinct.select("node", "sketch"), least_same=least_equal(similarity, left_out))
    further = confirmed_links(texts, candidates, settled, width=width, similarity=similarity)
    roots = component_roots(groups.union(further)).withColumnRenamed("node", "member")
    classes = distinct.join(roots, distinct.node == roots.member, "left").select("node", F.coalesce("root", "node").alias("root"))
    return marked.select("id", "row", "node").join(classes, "node").select("id", "row", "root")


def near_copies(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8, left_out: float = LEFT_OUT) -> DataFrame:
    """The smallest id among each document's near copies: texts whose ``width``-word shingles are ``similarity`` alike.

    Alike by the Jaccard similarity of the sets of lower-case shingles; near copies of near
    copies are in one group.  SimHash fingerprints of the shingles within 4 bits, found over shared
    blocks of bits, are compared first; whole sets of shingles confirm them.  As texts alike may
    be more bits apart, each text also goes to one key for each of its first shingles in one
    order of all shingles, so that no two texts alike miss each other.  Within a key, sketches
    of 64 bytes leave out pairs clearly less alike (of those alike one in ``left_out`` at most a
    key; with 0 none is left out, and every two texts of a key are compared as whole sets), and the
    whole sets of shingles decide.  Texts with the same words in the same order
    are one node; those of fewer than ``width`` words are like none but their own copies.

    Returns ``id_column, component_id``, one row per input row.  NULL ids are kept, and ids are
    whole numbers, or ValueError is raised; rows with the same id belong to the groups of their own
    texts; NULL and empty texts are copies of each other; very long texts are read whole; an
    empty table gives no rows; other columns are ignored.
    """
    kind = documents.schema[id_column].dataType
    picked = documents.select(integer_id(documents, id_column).alias("id"), F.lit(0).cast("bigint").alias("row"), F.col(text_column).cast("string").alias("text"))
    found = _near_classes(picked, width=width, similarity=similarity, left_out=left_out)
    least = found.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.join(least, "root").select(F.col("id").cast(kind).alias(id_column), F.col("component_id").cast(kind).alias("component_id"))


def keep_first_of_group(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8, left_out: float = LEFT_OUT) -> DataFrame:
    """``documents`` with one row of each group of near copies: that of the smallest id.

    Groups are those of :func:`near_copies`: of SimHash fingerprints within 4 bits first, then of texts
    alike that are further apart in bits, all confirmed by whole sets of shingles.
    Rows are told apart by id and a hash of their columns, so that different texts under one id are
    decided each for itself; of several rows with the smallest id the one with the smallest
    hash stays, and of equal rows one.  Rows without an id take no part and all stay.  Ids are
    whole numbers, or ValueError is raised.  NULL and empty texts are copies of each other, very
    long ones are read whole, an empty table gives no rows, and all columns stay.
    """
    hashed = [f.name for f in documents.schema if not f.dataType.simpleString().count("map<") and not f.dataType.simpleString().count("variant")]
    columns = documents.columns
    rows = documents.withColumns({"__id": integer_id(documents, id_column), "__row": F.xxhash64(*[F.col(quoted(x)) for x in hashed])})
    named = rows.where(F.col("__id").isNotNull())
    picked = named.select(F.col("__id").alias("id"), F.col("__row").alias("row"), F.col(text_column).cast("string").alias("text"))
    found = _near_classes(picked, width=width, similarity=similarity, left_out=left_out)
    first = found.groupBy("root").agg(F.min("id").alias("id")).withColumnRenamed("root", "first_root")
    # of the rows with the smallest id that with the smallest hash, once however often it comes
    winners = found.join(first, (found.root == first.first_root) & (found.id == first.id)).groupBy("root").agg(F.min(found.id).alias("__id"), F.min("row").alias("__row")).drop("root")
    kept = named.join(winners, ["__id", "__row"])
    # equal rows lie together after the join: the first of them stays, without another exchange
    once = Window.partitionBy("__id", "__row").orderBy("__id")
    kept = kept.withColumn("__at", F.row_number().over(once)).where(F.col("__at") == 1)
    return kept.select(*[F.col(quoted(x)) for x in columns]).unionByName(documents.where(F.col(quoted(id_column)).isNull()))
