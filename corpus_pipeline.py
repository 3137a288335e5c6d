"""From raw documents to packed training sequences, stage by stage.

Every stage reads whole texts of any length and takes all columns of documents, also more of
them and such that operators give to their own results; all but the last return the columns
they got.  ``doc_id`` holds whole numbers.  An empty table gives an empty table of the same
columns, and repeated rows are judged alike; what NULLs come to is said by each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.llm.contamination import find_contamination
from plumbspark.llm.packing import pack_documents
from plumbspark.llm.pii import pseudonymize
from plumbspark.llm.queries import PII_KEY, TOKENIZER
from plumbspark.llm.simhash import keep_first_of_group
from plumbspark.llm.storage import cut, ship_package
from plumbspark.llm.toxicity import fit_toxicity, score_toxicity

#: Scores from which on a document is rejected as toxic.
TOXIC = 0.5


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator gives to its own columns."""
    return docs.toDF(*[f"own_{name}" for name in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores as toxic go; it learns from the labels outside the held-out fold.

    A NULL or empty text scores as one without a hit, and stays; a NULL id has no label, and its
    text is judged like any other; without labels all stay.
    """
    ship_package(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(_apart(docs), model, id_column="own_doc_id", text_column="own_text")
    return scored.where(F.col("score") < TOXIC).drop("score", "hits").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    NULL and empty texts are copies of each other.  Documents without an id all stay.  Of rows with
    one id different texts are decided each for itself, and of equal rows one stays.
    """
    ship_package(spark)
    return keep_first_of_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go.

    A NULL or empty text holds nothing, and stays; a NULL id is no reason to go; items without an id
    or a word are not looked for.
    """
    ship_package(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(_apart(docs), bench, id_column="own_doc_id", text_column="own_text", width=10, keep_columns=True)
    return found.where(F.col("n_hit") == 0).drop("n_words", "n_hit", "items", "hits").toDF(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms; ``n_chars`` follows the new text.

    A NULL text stays NULL and an empty one empty, with the ``n_chars`` they had; ids are not read.
    """
    ship_package(spark)
    done = pseudonymize(_apart(docs), PII_KEY, text_column="own_text")
    n_chars = F.when(F.size("pii") > 0, F.length("own_text")).otherwise(F.col("own_n_chars"))
    done = done.withColumn("own_n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return done.drop("pii").toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens that all hold the corpus' mixture of sources.

    A NULL or empty text is its end token alone; NULL and repeated ids are documents of their
    own; NULL is a source.
    """
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), window=4096, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can express neither the learned scores nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result of each but the last is cut from its lineage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
