"""One query per operator over its whole table, in the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.llm.contamination import find_contamination
from plumbspark.llm.lexical import rank_documents
from plumbspark.llm.packing import pack_documents
from plumbspark.llm.pii import pseudonymize
from plumbspark.llm.quality import quality_cascade
from plumbspark.llm.secret_scan import fit_network, scan_secrets
from plumbspark.llm.setsketch import minhash_components
from plumbspark.llm.simhash import simhash_components
from plumbspark.llm.spelling import group_spellings
from plumbspark.llm.storage import ship_package
from plumbspark.llm.tokens import count_tokens
from plumbspark.llm.toxicity import fit_toxicity, held_out, score_toxicity
from plumbspark.llm.urls import judge_urls, url_rules
from plumbspark.llm.windows import drop_repeated_windows

TOKENIZER = "word_bpe_49k.json"

#: The key of pseudonyms made by the registered query; jobs pass one of their own.
PII_KEY = b"key of the registered query"

#: Verdict, host and path of the URL rules.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens that hold the corpus' mixture of sources; a row per piece."""
    done = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), window=4096, end_id=2)
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: base kinds, and what the network adds to them."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = scan_secrets(documents, fit_network(documents))

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    base = F.filter("spans", lambda x: x["kind"] != "model")
    return done.select("doc_id", *counts, F.sha2(F.encode(shown(base), "UTF-8"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text, and whether they are more than 2048."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text, whether a base rule fails it, and whether all rules keep it."""
    done = quality_cascade(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with its personal data as pseudonyms, and where they are."""
    done = pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_pii"), "pii")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every whole text, learned from labels outside the held-out fold."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(documents, _table(spark, sf_dir, "labels"))
    done = score_toxicity(documents, model)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page."""
    return judge_urls(_table(spark, sf_dir, "pages"), url_rules(spark, URL_RULES))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the smallest id that it reaches over links of four bits."""
    return simhash_components(_table(spark, sf_dir, "documents"), width=4, limit=4)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items that these come from."""
    done = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 13 words of an earlier one cover, and what is kept."""
    done = drop_repeated_windows(_table(spark, sf_dir, "documents"), width=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), limit=50)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return group_spellings(_table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles are 0.85 alike."""
    return minhash_components(_table(spark, sf_dir, "documents"), width=3, similarity=0.85)


QUERIES = {
    "op1_mixture_packing": op1_mixture_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

SQL: dict[str, str] = {
    "op7_url_filter": """
        WITH parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fitting AS (
            SELECT p.page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM parts p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY p.page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (page_id)
    """,
    "op11_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        bags AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM bags GROUP BY doc_id),
        totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM bags, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN bags USING (term) JOIN lengths USING (doc_id), totals
            GROUP BY item_id, doc_id)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 50
    """,
}
