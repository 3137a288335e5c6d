"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.storage import cut

#: Documents that costs and selectivities are estimated on; they set the order of rules only, never a result.
SAMPLE_ROWS = 1000

#: Times that a rule is evaluated for each sampled document when it is timed, and runs of which the fastest counts.
REPEATS, RUNS = 8, 3

WHITE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over ``text``, ``words`` and the columns of :func:`text_statistics`; NULL passes."""

    name: str
    fails: str


#: Rules beside the base ones.  All hold for prose of any language.
RULES = (
    Rule("word_length", "word_chars NOT BETWEEN 2 * n_words AND 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 2 * n_dup_lines >= n_lines"),
    Rule("few_letters", r"2 * length(regexp_replace(text, '[^\\p{L}]+', '')) < word_chars"),
    Rule("few_distinct_words", "n_words >= 200 AND 20 * size(array_distinct(words)) < n_words"),
    Rule("bullets", r"n_lines >= 10 AND 10 * regexp_count(text, '(?m)^[\\x20\\t]*[-*•]') > 9 * n_lines"),
    Rule("ellipses", r"n_lines >= 10 AND 10 * regexp_count(text, '(?m)(\\.\\.\\.|…)[\\x20\\t]*$') > 5 * n_lines"),
)


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words in windows that the text has twice or more, from the 64-bit hashes of all its windows."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(order: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(order) - 1)
        hit = F.filter(index, lambda k: (F.get(order, k)["h"] == F.get(order, k - 1)["h"]) | (F.get(order, k)["h"] == F.get(order, k + 1)["h"]))
        starts = F.transform(hit, lambda k: F.get(order, k)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    # one sort for each text: its result is the only element of an array
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(F.get(F.transform(F.array(placed), covered), F.lit(0)))


def text_statistics(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, text, words`` and the counts that rules use, for every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``word_chars``: code points in words; ``n_symbols``:
    characters of ``#*$%&|<>``; ``n_lines``: lines with a word; ``n_dup_lines``: those equal to
    an earlier line; ``n_repeat_words``: words in 3-word windows found twice or more, the
    first included.  A NULL text has none.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    split = documents.select(F.col(id_column), text.alias("text")).withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    windows = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda i: F.xxhash64(F.get("words", i - 2), F.get("words", i - 1), F.get("words", i))))
    parts = split.withColumns({"windows": windows, "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeat_words(F.col("words"), F.col("windows")),
    }
    return parts.select(id_column, "text", "words", *[x.cast("bigint").alias(k) for k, x in counts.items()])


def rule_costs(sample: DataFrame, rules: Sequence[Rule]) -> dict[str, float]:
    """Seconds that each rule takes for ``sample`` (of :func:`text_statistics`), besides what a job takes anyway.

    Every rule is compiled by a run that doesn't count, evaluated ``REPEATS`` times a document
    in one task, and timed ``RUNS`` times, in turn with the others; the fastest run counts, less
    that of a rule that has nothing to compute.
    """
    often = sample.coalesce(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("turn"))
    jobs = {"": often.agg(F.count_if(F.col("turn") < 0)), **{r.name: often.agg(F.count_if(F.expr(r.fails))) for r in rules}}
    best = dict.fromkeys(jobs, float("inf"))
    for run in range(RUNS + 1):
        for name, job in jobs.items():
            began = time.perf_counter()
            job.collect()
            if run:
                best[name] = min(best[name], time.perf_counter() - began)
    return {r.name: max(best[r.name] - best[""], 0.0) for r in rules}


def ordered_rules(statistics: DataFrame, rules: Sequence[Rule] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second on a sample, the most first.

    The sample are about ``sample_rows`` documents of the whole table, picked by a hash.  The
    order decides what is evaluated first and never what is kept.
    """
    total = statistics.count()
    share = F.lit(int((1 << 30) * min(1.0, sample_rows / max(total, 1))))
    picked = statistics.where(F.pmod(F.xxhash64("text", "n_words"), F.lit(1 << 30)) < share)
    sample = cut(picked)
    shares = sample.agg(*[F.avg(F.coalesce(F.expr(r.fails), F.lit(False)).cast("int")).alias(r.name) for r in rules]).first()
    costs = rule_costs(sample, rules)
    # what is too cheap to be timed counts as a tenth of a millisecond
    return sorted(rules, key=lambda r: -(shares[r.name] or 0.0) / max(costs[r.name], 1e-4))


def first_failure(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that a row fails; later rules are not evaluated.  NULL if it fails none."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.expr(rule.fails), rule.name).otherwise(verdict)
    return verdict


def quality_cascade(documents: DataFrame, rules: Sequence[Rule] = RULES, *, id_column: str = "doc_id", text_column: str = "text", min_words: int = 50, max_repeat_percent: int = 50, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts of every text, whether a base rule fails it, and whether all rules keep it.

    Base rules come first: their counts are part of the result and so are there anyway.
    What they keep goes through ``rules`` in the order that :func:`ordered_rules` finds, and
    stops at the first failure.  All of it is column expressions in one map-only pass.

    Returns ``id_column``, the counts, ``base_failed``, ``kept`` and ``failed_rule``, one row
    per input row.  NULL and empty texts have no words and fail; very long texts are read
    whole, repeated rows give repeated results, an empty table gives no rows, and other columns
    are ignored.
    """
    statistics = text_statistics(documents, id_column=id_column, text_column=text_column)
    order = ordered_rules(statistics, rules, sample_rows=sample_rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = statistics.withColumn("base_failed", failed)
    judged = judged.withColumn("failed_rule", F.when(F.col("base_failed"), "base").otherwise(first_failure(order)))
    return judged.select(id_column, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")
