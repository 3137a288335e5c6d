"""The whole check, composed: scope, overrides, rules, verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.operators.rules import (
    Rule,
    ScopeRule,
    rule_outcomes,
    scope_conditions,
    unfold_outcomes,
    verdict,
)
from plumbspark.operators.state import known_flag


def conformance_results(
    facts: DataFrame,
    rules: Sequence[Rule],
    scope_rules: Sequence[ScopeRule],
    directives: DataFrame,
    order: str | Sequence[str] = "pos",
    entity: str = "host",
) -> DataFrame:
    """Results of the rules in enabled sections.

    Scope gives the defaults and directives override them, as in
    :func:`plumbspark.operators.resolve_overrides`. The sections are known when the plan is
    made, so the directives fold into one row per entity with a column per section, and
    rules run where the facts lie: one scan of the facts, of which a row of statuses per
    entity is shuffled to meet its overrides. Results unfold after that; texts never move.
    """
    conditions = scope_conditions(scope_rules)
    default = {section: f"__default_{i}" for i, section in enumerate(conditions)}
    override = {section: f"__override_{i}" for i, section in enumerate(conditions)}
    outcomes = rule_outcomes(facts, rules, [entity], {default[s]: c for s, c in conditions.items()})

    at = F.col(order) if isinstance(order, str) else F.struct(*order)
    said = directives.select(
        entity, known_flag(F.col("flag")).alias("__flag"), F.coalesce("sections", F.array().cast("array<string>")).alias("__listed"), at.alias("__at")
    )

    def last(section: str) -> Column:
        listed, flag = F.array_contains("__listed", section), F.col("__flag")
        touched = F.when(flag.isin("only", "all") | listed, F.col("__at"))
        return F.max_by((flag == "all") | (listed & (flag != "skip")), touched)

    folded = said.groupBy(entity).agg(*[last(s).alias(override[s]) for s in conditions])
    enabled = {s: F.coalesce(override[s], default[s]) for s in conditions}
    return unfold_outcomes(outcomes.join(folded, entity, "left"), rules, [entity], enabled)


def conformance_report(
    facts: DataFrame,
    rules: Sequence[Rule],
    scope_rules: Sequence[ScopeRule],
    directives: DataFrame,
    by: Sequence[str] = ("section",),
    order: str | Sequence[str] = "pos",
    entity: str = "host",
) -> DataFrame:
    """Verdict over the results of :func:`conformance_results`, per ``by``."""
    return verdict(conformance_results(facts, rules, scope_rules, directives, order, entity), by)
