"""URL filters: host-suffix and path-prefix expressions joined to rules over short hash prefixes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hexadecimal digits of the digest that rules and expressions are joined on.
PREFIX_DIGITS = 8


def url_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rows as a table that is part of the plan."""
    columns = ("verdict", "host", "path")
    rows = [F.struct(*[F.lit(x).cast("string").alias(c) for x, c in zip(rule, columns, strict=True)]) for rule in rules]
    none = F.array().cast("array<struct<verdict: string, host: string, path: string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else none))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """The rule that fits each url best, and its verdict.

    A rule fits its host and all subdomains where the path starts with the rule's.  The
    longest rule (host and path together) wins, then the longer host, then ``block``.
    Distinct urls are expanded into the host suffixes of as many labels and the path prefixes
    of as many characters as some rule has, so that the number of expressions follows the
    shapes of the rules and not the length of the url.  Expressions meet rules on the first
    hexadecimal digits of their digest; the full digest confirms.  Both sides are plain
    equi-joins: Catalyst broadcasts the rules only if they are as small as its threshold
    asks, and a url with a third of all rows is judged once.

    Returns ``id_column, host, path, rule, verdict``, one row per input row.  NULL urls and
    urls without ``://`` have empty host and path and the default verdict, as have urls that
    no rule fits; their rule is NULL.  Rules with a NULL are left out; repeated rules count
    once.  Other columns are ignored.
    """
    if id_column in ("host", "path", "rule", "verdict", "url"):
        raise ValueError(f"the id column cannot be named {id_column}")
    digest = F.sha2(F.encode(F.concat("host", "path"), "UTF-8"), 256)
    known = rules.select("verdict", "host", "path").dropna().distinct().withColumn("host", F.translate("host", UPPER, LOWER))
    shapes = known.agg(F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    labels, lengths = (F.array(*map(F.lit, sorted(x))).cast("array<int>") for x in shapes)
    precedence = F.struct(F.length("rule_text").alias("length"), F.length("rule_host").alias("host_length"), (F.col("rule_verdict") == "block").alias("blocks"), "rule_text", "rule_verdict")
    keyed_rules = known.select(F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), digest.alias("digest"), F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule_text"), F.col("verdict").alias("rule_verdict"))
    keyed_rules = keyed_rules.select("prefix", "digest", precedence.alias("found"))

    picked = pages.select(F.col(id_column), F.col(url_column).cast("string").alias("url"))
    distinct = picked.where(F.col("url").contains("://")).select("url").distinct()
    parts = distinct.select("url", F.split(url_host(F.col("url")), r"\.").alias("labels"), url_path(F.col("url")).alias("whole"))
    parts = parts.where(F.size("labels") >= F.array_min(labels))
    suffixes = parts.select("url", "whole", "labels", F.explode(F.filter(labels, lambda n: n <= F.size("labels"))).alias("n"))
    suffixes = suffixes.select("url", "whole", F.array_join(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), ".").alias("host"))
    expressions = suffixes.select("url", "host", "whole", F.explode(F.filter(lengths, lambda n: n <= F.length("whole"))).alias("n"))
    expressions = expressions.select("url", "host", F.substring("whole", F.lit(1), F.col("n")).alias("path"))
    keyed = expressions.select("url", F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), digest.alias("full"))
    met = keyed.join(keyed_rules, "prefix").where(F.col("full") == F.col("digest"))
    best = met.groupBy("url").agg(F.max("found").alias("found"))
    done = picked.join(best, "url", "left")
    return done.select(F.col(id_column), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("found.rule_text").alias("rule"), F.coalesce("found.rule_verdict", F.lit(default)).alias("verdict"))
