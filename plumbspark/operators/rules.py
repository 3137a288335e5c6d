"""Applicability, rule evaluation, verdicts and classification."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbspark.functions.lines import line_regex_column, text_lines
from plumbspark.sources.storage import cut
from plumbspark.sources.tables import small_table

ANY = "*"
EFFECTS = ("include", "exclude")
STATUSES = ("fail", "pass", "skip")

#: Probes, or pairs of prerequisites, up to which they are sent to every task instead of being shuffled.
SENT_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """One check, as an expression over a row of facts.

    ``check`` and ``applies`` are Columns or SQL text. ``requires`` names rules
    without whose success this rule is not evaluated at all.
    """

    rule_id: str
    check: Column | str
    section: str = ""
    applies: Column | str | None = None
    requires: tuple[str, ...] = ()
    on_pass: str = ""
    on_fail: str = ""
    on_skip: str = ""


@dataclass(frozen=True)
class ScopeRule:
    """Section ``section`` is on (include) or off (exclude) where attribute = value."""

    section: str
    attribute: str = ANY
    value: str = ANY
    effect: str = "include"


def evaluate_rules(facts: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One row per entity and rule: ``(keys, section, rule_id, status, message)``.

    Status is ``skip`` where the rule does not apply, else ``pass`` or ``fail``;
    an unknown (NULL) outcome fails. A rule with a failed prerequisite, direct or
    through others, gives no row. ``facts`` has one row per entity.

    The rules are part of the plan: every row unfolds into its results with no
    join and no shuffle, and rule texts compile once.
    """
    return unfold_outcomes(rule_outcomes(facts, rules, keys), rules, keys)


def rule_outcomes(
    facts: DataFrame, rules: Sequence[Rule], keys: Sequence[str], carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """One narrow row per entity: ``keys``, the status of every rule, and the columns of ``carry``."""
    _require_valid(rules)
    carried = [column.alias(name) for name, column in (carry or {}).items()]
    statuses = [_status(rule).alias(name) for rule, name in zip(rules, _status_names(rules), strict=True)]
    return facts.select(*keys, *carried, *statuses)


def unfold_outcomes(
    outcomes: DataFrame, rules: Sequence[Rule], keys: Sequence[str], enabled: Mapping[str, Column] | None = None
) -> DataFrame:
    """The results of :func:`evaluate_rules` from :func:`rule_outcomes`.

    With ``enabled``, a condition per section, rules of a section where it doesn't hold give
    no row, and neither do sections that it doesn't name.
    """
    by_id = {rule.rule_id: rule for rule in rules}
    column = dict(zip(by_id, _status_names(rules), strict=True))
    results = []
    for rule in rules:
        status = F.col(column[rule.rule_id])
        result = F.struct(
            F.lit(rule.section).alias("section"),
            F.lit(rule.rule_id).alias("rule_id"),
            status.alias("status"),
            F.when(status == "pass", rule.on_pass)
            .when(status == "fail", rule.on_fail)
            .otherwise(rule.on_skip)
            .alias("message"),
        )
        conditions = [F.col(column[name]) != "fail" for name in _all_required(rule.rule_id, {r.rule_id: r.requires for r in rules})]
        if enabled is not None:
            conditions.append(enabled.get(rule.section, F.lit(False)))
        results.append(F.when(reduce(and_, conditions), result) if conditions else result)
    rows = outcomes.select(*keys, F.explode(F.array(*results)).alias("__result"))
    if enabled is not None or any(rule.requires for rule in rules):
        rows = rows.filter(F.col("__result").isNotNull())
    return rows.select(*keys, "__result.*")


def _status_names(rules: Sequence[Rule]) -> list[str]:
    return [f"__status_{i}" for i in range(len(rules))]


def check_rules(
    pairs: DataFrame,
    rules: DataFrame,
    inventory: DataFrame | None = None,
    docs: DataFrame | None = None,
    prerequisites: DataFrame | Sequence[tuple[str, str]] | None = None,
    entity: str = "host",
) -> DataFrame:
    """Rules given as a table: ``(entity, section, rule_id, status, message)``.

    - ``pairs``: ``(entity, section)`` to check, as from :func:`applicable`; with a
      boolean ``applies`` column, pairs where it is false are skipped.
    - ``rules``: ``(rule_id, section, kind, target, pattern, message)``, one row per
      probe. A probe with a ``pattern`` holds if some line of document ``target``
      matches; one without holds if the inventory has ``(kind, name = target)``. A rule
      with several rows holds if any of its probes does, however many it has. Optional
      columns: ``mode``, one of :data:`plumbspark.functions.lines.LINE_MODES` or ``suffix``
      (NULL: ``regex``); ``ignore_case``; ``max_count``, with which a probe holds as long
      as no more lines, or distinct inventory entries, match: 0 asks for their absence,
      also from a missing document.
    - ``inventory``: ``(entity, kind, name)``; ``docs``: ``(entity, path, text)``.
    - ``prerequisites``: ``(rule_id, requires)``, of any number and depth; a rule with a
      failed requirement, direct or through others, gives no row. A rule that requires
      itself, directly or through others, raises ValueError.

    There is one row per entity and rule. Its message is that of the rule's first probe,
    by kind, target, pattern, mode, ``ignore_case``, ``max_count`` and message. A rule whose
    probes name several sections is in all of them: its result is for the first of these
    that the entity has, and is a skip if none of those that it has applies.

    A document meets all probes of its path as one array, and is split once; each probe
    that is found becomes one small row. Pairs and what was found are dealt by entity, before
    pairs unfold into their rules, to as many tasks as ``spark.sql.shuffle.partitions``, and
    meet in one aggregation by entity and rule; messages are added to its result. Rules are
    counted first: up to ``SENT_RULES`` are broadcast, whatever table they come from, so that
    pairs, inventory and documents never are, nothing else is shuffled and no task holds all
    rows of a section or a rule. More of them meet the rows in shuffled equi-joins.
    """
    if "applies" not in pairs.columns:
        pairs = pairs.withColumn("applies", F.lit(True))
    optional = {"mode": "string", "ignore_case": "boolean", "max_count": "bigint"}
    given = [F.col(c).cast(t).alias(c) if c in rules.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    probes = rules.select("rule_id", "section", "kind", "target", "pattern", "message", *given)
    bounded = "max_count" in rules.columns
    if bounded:
        # the place of a probe in its rule tells those with a max_count apart
        order = Window.partitionBy("rule_id").orderBy("kind", "target", "pattern", "mode", "ignore_case", "max_count")
        probes = probes.withColumn("probe", F.when(F.col("max_count").isNotNull(), F.row_number().over(order)))
    else:
        probes = probes.withColumn("probe", F.lit(None).cast("int"))
    described = F.struct("kind", "target", "pattern", "mode", "ignore_case", "max_count", "message")
    sections = F.sort_array(F.collect_set("section"))
    rule_table = probes.groupBy("rule_id").agg(F.count("probe").alias("n_bounded"), F.min(described)["message"].alias("message"), sections.alias("sections"))
    sent = _sent(rules.count())

    # A probe is found if it has a match; one with max_count if it has too many.
    places = rule_table.select(F.col("rule_id").alias("asked"), F.posexplode("sections").alias("place", "section"))
    unfound = [F.lit(None).cast(probes.schema["rule_id"].dataType).alias("rule_id"), F.lit(False).alias("found"), F.lit(None).cast("int").alias("probe")]
    facts = pairs.select(entity, "section", "applies", *unfound)
    least = F.coalesce("max_count", F.lit(0))
    unasked = [F.lit(None).cast(pairs.schema["section"].dataType).alias("section"), F.lit(None).cast("boolean").alias("applies")]
    evidence = [entity, *unasked, "rule_id", F.lit(True).alias("found"), "probe"]
    if inventory is not None:
        wanted = probes.filter(F.col("pattern").isNull()).select("rule_id", "probe", least.alias("least"), "kind", F.col("target").alias("name"))
        # An entry is there or not: one is its greatest count.
        present = inventory.select(entity, "kind", "name").join(sent(wanted.filter("least < 1")), ["kind", "name"])
        facts = facts.unionByName(present.select(*evidence))
    if docs is not None:
        facts = facts.unionByName(_found_in_docs(docs, probes.withColumn("least", least), entity, sent).select(*evidence))
    facts = _dealt(facts, entity).join(sent(places), "section", "left").withColumn("rule_id", F.coalesce("asked", "rule_id")).filter(F.col("rule_id").isNotNull())

    # Numbers and flags, which aggregate in place; only a max_count needs the set of probes.
    holds = F.col("plain")
    counted = []
    if bounded:
        counted = [F.size(F.collect_set("probe")).alias("too_many")]
        holds = holds | (F.col("too_many") < F.col("n_bounded"))
    results = facts.groupBy(entity, "rule_id").agg(
        F.bool_or("applies").alias("applies"), F.min("place").alias("place"), F.bool_or(F.col("found") & F.col("probe").isNull()).alias("plain"), *counted
    )
    results = results.filter(F.col("applies").isNotNull())
    if bounded:
        results = results.join(sent(rule_table.select("rule_id", "n_bounded")), "rule_id")
    status = F.when(~F.col("applies"), STATUSES.index("skip")).when(holds, STATUSES.index("pass")).otherwise(STATUSES.index("fail"))
    results = results.select(entity, "rule_id", "place", status.alias("status"))
    if prerequisites is not None:
        results = _drop_blocked(results, _hops(results.sparkSession, prerequisites), entity)
    named = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("status") + 1)
    return results.join(sent(rule_table.select("rule_id", "sections", "message")), "rule_id").select(
        entity, F.get("sections", "place").alias("section"), "rule_id", named.alias("status"), "message"
    )


def _sent(n: int) -> Callable[[DataFrame], DataFrame]:
    """What to do to a table of ``n`` rules before a join: broadcast it, or leave it as it is."""
    return F.broadcast if n <= SENT_RULES else lambda table: table


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in a given number of tasks, which would else be merged by the bytes of rows that have yet to unfold."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _found_in_docs(docs: DataFrame, probes: DataFrame, entity: str, sent: Callable[[DataFrame], DataFrame] = F.broadcast) -> DataFrame:
    """``(entity, rule_id, probe)`` of each probe of lines that a document of its path has a match for, or too many."""
    regex = line_regex_column("pattern", "mode", "ignore_case").alias("regex")
    by_path = (
        probes.filter(F.col("pattern").isNotNull())
        .groupBy(F.col("target").alias("path"))
        .agg(F.collect_list(F.struct("rule_id", "probe", "least", regex)).alias("probes"))
    )

    # regexp_instr keeps its compiled pattern from line to line; rlike with a pattern
    # column compiles it anew each time.
    def found(lines: Column, probe: Column) -> Column:
        hit = lambda line: F.regexp_instr(line, probe["regex"]) > 0
        return F.when(probe["least"] == 0, F.exists(lines, hit)).otherwise(F.size(F.filter(lines, hit)) > probe["least"])

    # An array of one, so that a text is split once for all its probes.
    lines = F.array(text_lines("text"))
    hits = F.flatten(F.transform(lines, lambda x: F.filter("probes", lambda probe: found(x, probe))))
    present = docs.select(entity, "path", "text").join(sent(by_path), "path").filter(F.col("text").isNotNull())
    return present.select(entity, F.inline(hits)).select(entity, "rule_id", "probe")


def applicable(
    entities: DataFrame,
    scope_rules: Sequence[ScopeRule] | DataFrame,
    keys: Sequence[str] = ("host",),
    keep_all: bool = False,
    attributes: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs of entity and section that apply: ``(keys, section)``.

    A section applies where an include rule matches and no exclude rule does; a
    rule matches an entity whose attribute has its value, ``*`` matches all.

    Scope rules given as a list become part of the plan (map-only). With
    ``keep_all`` every pair is returned with a boolean ``applies``. Scope rules
    given as a table ``(section, attribute, value, effect)`` name their columns in
    ``attributes``. Each attribute is one equi-join of entities with the sets of sections
    that its values include and exclude; those of wildcard rules are a constant of the
    plan. Sections unfold at the end, so that no section of an entity is shuffled.
    ``entities`` has one row per ``keys``. An effect that is neither ``include`` nor
    ``exclude`` fails.
    """
    keys = list(keys)
    if isinstance(scope_rules, DataFrame):
        if keep_all:
            raise ValueError("keep_all needs scope rules given as a list")
        if attributes is None:
            raise ValueError("scope rules given as a table need attributes, the columns they speak of")
        return _applicable_by_table(entities, scope_rules, keys, list(attributes))
    pairs = [F.struct(F.lit(s).alias("section"), c.alias("applies")) for s, c in scope_conditions(scope_rules).items()]
    unfolded = entities.select(*keys, F.explode(F.array(*pairs)).alias("__pair")).select(*keys, "__pair.*")
    return unfolded if keep_all else unfolded.filter("applies").drop("applies")


def scope_conditions(scope_rules: Sequence[ScopeRule]) -> dict[str, Column]:
    """For every section whether it applies to a row of entities."""
    if not scope_rules:
        raise ValueError("scope_rules is empty")
    for rule in scope_rules:
        _in_scope(rule)
    sections = list(dict.fromkeys(rule.section for rule in scope_rules))
    conditions = {}
    for section in sections:
        includes, excludes = ([_in_scope(r) for r in scope_rules if (r.section, r.effect) == (section, e)] for e in EFFECTS)
        conditions[section] = reduce(or_, includes, F.lit(False)) & ~reduce(or_, excludes, F.lit(False))
    return conditions


def verdict(results: DataFrame, by: Sequence[str] = (), entities: DataFrame | None = None) -> DataFrame:
    """Counts per status and ``failed``, for each group of ``by`` or overall.

    A group fails if any check in it fails; skips never fail, and no checks at
    all is not a failure. ``entities`` holds the ``by`` columns of groups that
    must be reported even if they have no results.
    """
    by = list(by)
    if entities is not None:
        empty = entities.select(*by, F.lit(None).cast("string").alias("status"))
        results = results.select(*by, "status").unionByName(empty)
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "fail", "skip")]
    failed = F.coalesce(F.bool_or(F.col("status") == "fail"), F.lit(False)).alias("failed")
    return results.groupBy(*by).agg(*counts, failed)


def classify(
    df: DataFrame,
    cases: Sequence[tuple[str, Column | str]],
    default: str = "unknown",
    output: str = "label",
) -> DataFrame:
    """Add the label of the first case whose predicate holds, else ``default``."""
    if not cases:
        raise ValueError("cases is empty")
    (label, predicate), *rest = cases
    chain = F.when(_expr(predicate), F.lit(label))
    for label, predicate in rest:
        chain = chain.when(_expr(predicate), F.lit(label))
    return df.withColumn(output, chain.otherwise(F.lit(default)))


def _applicable_by_table(entities: DataFrame, scope_rules: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    effect = F.col("effect")
    message = F.concat(F.lit("unknown effect: "), F.coalesce(effect, F.lit("NULL")))
    on = F.when(effect.isin(*EFFECTS), effect == "include").otherwise(F.raise_error(message).cast("boolean"))
    effects = scope_rules.select("attribute", "value", "section", on.alias("__on"))
    sets = [F.collect_set(F.when(c, F.col("section"))).alias(n) for n, c in (("on", F.col("__on")), ("off", ~F.col("__on")))]
    # One row of two arrays: as long as there are sections, and no longer with more entities.
    everywhere = effects.filter(F.col("attribute") == ANY).agg(F.struct(*sets).alias("sets")).scalar()
    # Each attribute adds its value's sections to the row of the entity.
    found = entities.select(*keys, *[F.col(a).cast("string").alias(f"__value_{i}") for i, a in enumerate(attributes)])
    for i, attribute in enumerate(attributes):
        special = effects.filter(F.col("attribute") == attribute).groupBy(F.col("value").alias(f"__value_{i}"))
        found = found.join(special.agg(F.struct(*sets).alias(f"__sets_{i}")), f"__value_{i}", "left")
    nothing = F.array().cast("array<string>")

    def all_of(name: str) -> Column:
        return F.concat(everywhere[name], *[F.coalesce(F.col(f"__sets_{i}")[name], nothing) for i in range(len(attributes))])

    # Applies if something includes it and nothing excludes it.
    return found.select(*keys, F.explode(F.array_except(all_of("on"), all_of("off"))).alias("section"))


def _hops(spark: SparkSession, prerequisites: DataFrame | Sequence[tuple[str, str]]) -> list[DataFrame]:
    """``(dependent, requirement)`` tables, the ``k``-th of all pairs ``2**k`` steps apart.

    Every distance is a sum of some of these, so that following each of them once follows
    any chain; a table is made by joining the one before it with itself. Where rules don't
    require themselves a walk has no more steps than there are rules, and the last table is
    empty; a longer one is a circle.
    """
    names = ["__dependent", "__requires"]
    if not isinstance(prerequisites, DataFrame):
        pairs, hops = set(prerequisites), []
        rules = {rule_id for pair in pairs for rule_id in pair}
        while pairs:
            if 2 ** len(hops) > len(rules):
                raise ValueError(f"rule {min(pairs)[0]!r} requires itself, directly or through others")
            hops.append(small_table(spark, sorted(pairs), "__dependent string, __requires string"))
            after: dict[str, list[str]] = {}
            for rule_id, required in pairs:
                after.setdefault(rule_id, []).append(required)
            pairs = {(rule_id, name) for rule_id, required in pairs for name in after.get(required, ())}
        return hops
    hop = cut(prerequisites.select("rule_id", "requires").dropna().distinct().toDF(*names))
    n_rules = hop.select(F.explode(F.array(*names))).distinct().count()
    hops = []
    while not hop.isEmpty():
        if 2 ** len(hops) > n_rules:
            raise ValueError(f"rule {hop.agg(F.min(names[0])).first()[0]!r} requires itself, directly or through others")
        hops.append(_sent(hop.count())(hop))
        after = hop.toDF("__requires", "__further")
        hop = cut(hop.join(after, "__requires").select("__dependent", F.col("__further").alias("__requires")).distinct())
    return hops


def _drop_blocked(results: DataFrame, hops: Sequence[DataFrame], entity: str) -> DataFrame:
    """``results`` without rules that a failed one stands behind.

    A failed or blocked rule blocks those that require it, ``2**k`` steps on in the ``k``-th
    pass. A pass is one aggregation; results are computed once. Each pass deals its rows anew,
    so that no task holds the tables of more than one aggregation.
    """
    fails = F.col("status") == STATUSES.index("fail")
    marked = results.select(entity, "rule_id", "place", "status", F.lit(False).alias("blocked"))
    for hop in hops:
        behind = marked.join(hop, (F.col("rule_id") == F.col("__requires")) & (F.col("blocked") | fails), "left")
        said = F.struct("rule_id", "place", "status", "blocked")
        unsaid = F.lit(None).cast("int")
        further = F.struct(F.col("__dependent").alias("rule_id"), unsaid.alias("place"), unsaid.alias("status"), F.lit(True).alias("blocked"))
        unfolded = behind.select(entity, F.inline(F.array(said, further))).filter(F.col("rule_id").isNotNull())
        marked = (
            _dealt(unfolded, entity, "rule_id")
            .groupBy(entity, "rule_id")
            .agg(F.max("place").alias("place"), F.max("status").alias("status"), F.bool_or("blocked").alias("blocked"))
        )
    return marked.filter(F.coalesce(~F.col("blocked"), F.lit(False)) & F.col("status").isNotNull()).select(entity, "rule_id", "place", "status")


def _status(rule: Rule) -> Column:
    outcome = F.when(_expr(rule.check), "pass").otherwise("fail")
    if rule.applies is None:
        return outcome
    return F.when(_expr(rule.applies), outcome).otherwise("skip")


def _in_scope(rule: ScopeRule) -> Column:
    if rule.effect not in EFFECTS:
        raise ValueError(f"effect must be one of {EFFECTS}, got {rule.effect!r}")
    if rule.attribute == ANY:
        return F.lit(True)
    return F.coalesce(F.col(rule.attribute).cast("string") == F.lit(rule.value), F.lit(False))


def _require_valid(rules: Sequence[Rule]) -> None:
    if not rules:
        raise ValueError("rules is empty")
    names = [rule.rule_id for rule in rules]
    if len(set(names)) != len(names):
        raise ValueError("rule_id is not unique")
    for rule in rules:
        unknown = set(rule.requires) - set(names)
        if unknown:
            raise ValueError(f"rule {rule.rule_id!r} requires unknown rules {sorted(unknown)}")


def _all_required(rule_id: str, requires: Mapping[str, Sequence[str]]) -> list[str]:
    found: list[str] = []
    todo = list(requires.get(rule_id, ()))
    while todo:
        name = todo.pop()
        if name == rule_id:
            raise ValueError(f"rule {name!r} requires itself")
        if name not in found:
            found.append(name)
            todo.extend(requires.get(name, ()))
    return found


def _expr(predicate: Column | str) -> Column:
    return F.expr(predicate) if isinstance(predicate, str) else predicate
