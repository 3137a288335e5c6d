"""Ranked lexical search: documents with the same bag of query terms are scored once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from plumbspark.llm.storage import cut
from plumbspark.llm.text import LOWER, Texts, blocks, codes, runs

#: Terms of queries, each counted once a query, that are searched for in one pass over the documents.
QUERY_TERMS = 1 << 20

#: One class in so many is scored first, for a score that the best documents reach at least.
SAMPLE = 64

#: Postings that a task scores at a time.
POSTINGS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INSIDE = np.ones(256, dtype=bool)
_INSIDE[:0x80] = [chr(x).isalnum() for x in range(0x80)]


@dataclass
class Queries:
    """Some queries as numbers of terms; the weight of a term is known once documents are counted."""

    terms: list[list[int]]
    vocabulary: dict[bytes, int]


def term_counts(texts: Texts, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    """The number of terms of every text, and its bag: number and count of each term of ``vocabulary``, as bytes."""
    data = LOWER[texts.data]
    found = runs(texts, _INSIDE[data])
    code, distinct, _ = codes(data, found)
    known = np.fromiter((vocabulary.get(x, -1) for x in distinct), dtype=np.int64, count=len(distinct))[code]
    owner = np.searchsorted(found.first, np.flatnonzero(known >= 0), side="right") - 1
    pairs, tf = np.unique(owner * max(1, len(vocabulary)) + known[known >= 0], return_counts=True)
    owner, term = np.divmod(pairs, max(1, len(vocabulary)))
    bag = np.stack([term, tf], axis=1).astype("<u4")
    edge = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return np.diff(found.first), [bag[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]


class Best:
    """The ``limit`` best classes of every query so far: highest score, then smallest first id, NULL last."""

    def __init__(self, n_queries: int, limit: int, floors: np.ndarray):
        self.limit, self.floors = limit, floors.copy()
        self.kept: list[list[tuple]] = [[] for _ in range(n_queries)]

    def add(self, query: int, score: np.ndarray, classes: list, ids: list) -> None:
        good = np.flatnonzero(score >= max(1, self.floors[query]))
        if len(good) > self.limit:
            least = np.partition(score[good], -self.limit)[-self.limit]
            good = good[score[good] >= least]
        if not len(good):
            return
        new = [(-int(score[k]), ids[k] is None, ids[k] if ids[k] is not None else 0, classes[k]) for k in good.tolist()]
        self.kept[query] = sorted(self.kept[query] + new)[: self.limit]
        if len(self.kept[query]) == self.limit:
            self.floors[query] = max(self.floors[query], -self.kept[query][-1][0])


def score_bags(bags: list[bytes], m: np.ndarray, weight: np.ndarray, queries: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each query the score of every bag: the sum of ``w * ((10**9 * tf) div (1000 * tf + 20 * m))``."""
    lengths = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags)) // 8
    flat = np.frombuffer(b"".join(bags), dtype="<u4").reshape(-1, 2)
    owner = np.repeat(np.arange(len(bags)), lengths)
    term, tf = flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
    by = np.argsort(term, kind="stable")
    owner, value = owner[by], value[by]
    edge = np.searchsorted(term[by], np.arange(len(weight) + 1))
    for terms in queries:
        total = np.zeros(len(bags), dtype=np.int64)
        for t in terms.tolist():
            a, b = edge[t], edge[t + 1]
            # a bag holds a term once, so no index comes twice
            total[owner[a:b]] += value[a:b]
        yield total


def _search(documents: DataFrame, asked: Queries, limit: int) -> DataFrame:
    """``query, rank, id, score`` for one block of queries, numbered from 0; ``documents`` has ``id, text``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(asked.vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            n, bags = term_counts(texts, shared.value)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(bags, type=pa.binary())], names=["id", "n", "bag"])

    id_field = documents.schema["id"]
    marked = cut(documents.mapInArrow(scan, StructType([id_field, StructField("n", LongType()), StructField("bag", BinaryType())])))
    shared.unpersist()
    n_docs, n_terms = marked.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L")
    digest = F.unhex(F.md5(F.concat("bag", F.encode(F.col("m").cast("string"), "UTF-8"))))
    bagged = marked.where(F.octet_length("bag") > 0).select("id", "bag", m.alias("m")).withColumn("digest", digest)
    # grouped by the whole bag, so that equal digests alone make no class
    classes = cut(bagged.groupBy("digest", "m", "bag").agg(F.count("*").alias("size"), F.min("id").alias("first_id")).withColumn("class", F.monotonically_increasing_id()))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.vocabulary), dtype=np.int64)
        for batch in batches:
            bags, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags)) // 8
            np.add.at(total, np.frombuffer(b"".join(bags), dtype="<u4").reshape(-1, 2)[:, 0], np.repeat(sizes, lengths))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    df = classes.select("bag", "size").mapInArrow(holders, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(max(1, len(asked.vocabulary)), dtype=np.int64)
    for term, n in df.toArrow().to_pandas().itertuples(index=False):
        weight[term] = floor(1000 * log((2 * n_docs + 2) / (2 * n + 1)))
    weights = spark.sparkContext.broadcast((weight, [np.array(x, dtype=np.int64) for x in asked.terms]))

    def scorer(floors: np.ndarray):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, queries = weights.value
            best = Best(len(queries), limit, floors)
            for batch in batches:
                bags = batch.column(1).to_pylist()
                ends = np.cumsum([len(x) // 8 for x in bags])
                low = 0
                while low < len(bags):
                    high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + POSTINGS, side="right")))
                    part = batch.slice(low, high - low)
                    numbers, ids = part.column(0).to_pylist(), part.column(3).to_pylist()
                    for query, total in enumerate(score_bags(bags[low:high], part.column(2).to_numpy(), weight, queries)):
                        best.add(query, total, numbers, ids)
                    low = high
            rows = [(query, x[3], -x[0], None if x[1] else x[2]) for query, kept in enumerate(best.kept) for x in kept]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = [pa.int64(), pa.int64(), pa.int64(), id_kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["query", "class", "score", "first_id"])

        return score

    narrow = classes.select("class", "bag", "m", "first_id")
    id_kind = to_arrow_type(id_field.dataType)
    schema = StructType([StructField("query", LongType()), StructField("class", LongType()), StructField("score", LongType()), StructField("first_id", id_field.dataType)])
    floors = np.zeros(len(asked.terms), dtype=np.int64)
    # the limit-th best of any classes is reached by the limit-th best of all
    first = narrow.where(F.pmod(F.xxhash64("class"), F.lit(SAMPLE)) == 0).mapInArrow(scorer(floors), schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("first_id"), "class")
    for query, score in first.withColumn("at", F.row_number().over(order)).where(F.col("at") == limit).select("query", "score").collect():
        floors[query] = score
    found = narrow.mapInArrow(scorer(floors), schema)
    winners = cut(found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit).select("query", "class", "score"))

    # members of the classes that won: their smallest ids, as many as can be shown
    won = classes.join(winners.select("class").distinct(), "class", "left_semi")
    alone = classes.groupBy("digest").count().where("count > 1").isEmpty()
    by = ["digest"] if alone else ["digest", "m", "bag"]
    members = bagged.select("id", *by).join(won.select("class", *by), by).select("class", "id")
    smallest = Window.partitionBy("class").orderBy(F.asc_nulls_last("id"))
    members = members.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= limit).drop("at")
    last = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = winners.join(members, "class").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit)
    return ranked.select("query", "rank", "id", "score")


def rank_documents(
    documents: DataFrame, queries: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", query_id: str = "item_id", query_text: str = "text", limit: int = 50, query_terms: int = QUERY_TERMS
) -> DataFrame:
    """The ``limit`` documents of the highest score for each query: ``query_id, rank, id_column, score``.

    Terms are runs of digits, letters and characters from U+0080 of whole texts, A-Z in lower
    case.  A term weighs ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, a document has
    ``m = 50 + (50 * n * N) div L``, and scores the sum of
    ``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` over the query's terms, once each.

    1. Every document is restricted to the terms of any query: its bag is the number and
       count of each of them.
    2. Documents with the same bag and the same ``m`` are one class, told apart by a digest
       and confirmed by the bag itself; a class is scored once, for all queries.
    3. Tasks keep the ``limit`` best classes of each query, by score and smallest id.
    4. Only classes that won are expanded into their members, by ascending id.
    Queries are searched for in blocks of about ``query_terms`` terms, each a pass over the
    documents; what is broadcast is one block.

    Scores above 0 only, equal scores by ascending id, ranks unique from 1.  A NULL id comes
    last among equals; rows with the same id, and queries with the same id, are ranked for
    themselves.  NULL and empty texts have no term: as documents they count nowhere, as
    queries they give no rows.  Very long texts are read whole, empty tables give no rows, and
    other columns are ignored.
    """
    pattern = F.regexp_extract_all(F.translate(F.col(query_text).cast("string"), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    # written once, so that a query keeps its number
    numbered = cut(queries.select(F.col(query_id).alias("name"), F.array_distinct(pattern).alias("terms")).where(F.size("terms") > 0).withColumn("number", F.monotonically_increasing_id()))
    picked = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    n_blocks = (numbered.agg(F.sum(F.size("terms"))).first()[0] or 0) // query_terms + 1
    block = numbered.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n_blocks)))
    done = None
    for k in range(n_blocks):
        own = block.where(F.col("block") == k).select("number", "terms").toArrow().to_pandas()
        if not len(own):
            continue
        distinct = sorted({t for terms in own["terms"] for t in terms})
        at = {t: i for i, t in enumerate(distinct)}
        asked = Queries([[at[t] for t in terms] for terms in own["terms"]], {t.encode(): i for t, i in at.items()})
        names = documents.sparkSession.createDataFrame(pa.table({"query": np.arange(len(own)), "number": own["number"].to_numpy()}))
        found = _search(picked, asked, limit).join(names, "query").select("number", "rank", "id", "score")
        done = found if done is None else done.unionByName(found)
    if done is None:
        done = picked.limit(0).select(F.lit(0).cast("bigint").alias("number"), F.lit(0).alias("rank"), "id", F.lit(0).cast("bigint").alias("score"))
    return done.join(numbered, "number").select(F.col("name").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")
