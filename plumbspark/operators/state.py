"""Desired against actual state: plans, validation, overrides, snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESET_FLAGS = ("only", "all")
LISTING_FLAGS = ("only", "skip", "enable")
FLAGS = ("only", "skip", "enable", "all")


def known_flag(flag: Column) -> Column:
    """``flag`` itself; a query that meets an unknown or NULL one fails when it runs."""
    message = F.concat(F.lit("unknown flag: "), F.coalesce(flag, F.lit("NULL")))
    return F.when(flag.isin(*FLAGS), flag).otherwise(F.raise_error(message).cast("string"))


def plan_missing(
    desired: DataFrame,
    actual: DataFrame | Sequence[DataFrame],
    key: str | Sequence[str],
    presence: str = "any",
) -> DataFrame:
    """Plan per distinct desired key: ``(key, action)``, ``ok`` or ``install``.

    A key is present if it is in ``any`` (or in ``all``) of the actual tables.
    Nothing is applied; the plan is the dry run.

    All tables go through one aggregation by key. Equal keys collapse before the
    shuffle on every side, however often one of them occurs, and no side has to
    be small.
    """
    if presence not in ("any", "all"):
        raise ValueError(f"presence must be 'any' or 'all', got {presence!r}")
    keys = [key] if isinstance(key, str) else list(key)
    sources = [actual] if isinstance(actual, DataFrame) else list(actual)
    if not sources:
        raise ValueError("actual is empty")
    # Source 0 is the desired state.
    tagged = [
        df.select(*keys, F.lit(i).alias("__source")) for i, df in enumerate([desired, *sources])
    ]
    seen = [F.bool_or(F.col("__source") == i).alias(f"__in_{i}") for i in range(len(tagged))]
    in_source = [F.col(f"__in_{i}") for i in range(1, len(tagged))]
    present = reduce(or_ if presence == "any" else and_, in_source)
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy(*keys)
        .agg(*seen)
        .filter("__in_0")
        .select(*keys, F.when(present, "ok").otherwise("install").alias("action"))
    )


def missing_items(
    desired: DataFrame,
    actual: DataFrame | Sequence[DataFrame],
    key: str | Sequence[str],
    presence: str = "any",
) -> DataFrame:
    """The gap only: the desired keys that :func:`plan_missing` would install."""
    return plan_missing(desired, actual, key, presence).filter(F.col("action") == "install").drop("action")


def unknown_values(df: DataFrame, column: str, allowed: Sequence | DataFrame) -> DataFrame:
    """Values of ``column`` outside ``allowed``, with counts: ``(column, n_rows)``.

    ``allowed`` is a list, or a table with a column of the same name. NULL is
    unknown unless the list holds None or the table NULL.
    """
    if isinstance(allowed, DataFrame):
        counts = df.groupBy(column).agg(F.count("*").alias("n_rows"))
        known = allowed.select(F.col(column).alias("__allowed"))
        return counts.join(known, F.col(column).eqNullSafe(F.col("__allowed")), "left_anti")
    unknown = ~F.col(column).isin([v for v in allowed if v is not None])
    if None not in allowed:
        unknown = unknown | F.col(column).isNull()
    return df.filter(unknown).groupBy(column).agg(F.count("*").alias("n_rows"))


def require_known(
    df: DataFrame, column: str, allowed: Sequence | DataFrame, allow_empty: bool = False, shown: int = 20
) -> None:
    """Raise ValueError if ``df`` holds unknown values, or no rows at all.

    This runs the check. The message shows at most ``shown`` of the values.
    """
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no values given for {column!r}")
    found = unknown_values(df, column, allowed).orderBy(F.desc("n_rows"), column).limit(shown + 1).collect()
    if found:
        values = ", ".join(repr(row[column]) for row in found[:shown])
        more = ", ..." if len(found) > shown else ""
        raise ValueError(f"unknown values in {column!r}: {values}{more}")


def resolve_overrides(
    defaults: DataFrame,
    directives: DataFrame,
    order: str | Sequence[str],
    entity: str = "host",
    key: str = "section",
    enabled: str = "enabled",
    flag: str = "flag",
    listed: str = "sections",
) -> DataFrame:
    """Fold ordered directives over the defaults: ``(entity, key, enabled)``.

    ``defaults`` has one row per entity and key. Directives apply in ``order``,
    unique per entity, and the last one to touch a key wins: ``only`` turns the
    listed keys on and all others off, ``skip`` turns the listed ones off,
    ``enable`` the listed ones on, ``all`` everything on; any other flag fails the
    query. Listed keys without a default are ignored; :func:`unknown_values` finds them.

    The effect of ``only`` and ``all`` on unlisted keys depends on the entity
    alone, so the directives are never multiplied by the keys: a key compares
    its own last mention with the last reset of its entity. That join is on the
    entity, with neither side small.
    """
    at = F.col(order) if isinstance(order, str) else F.struct(*order)
    said = directives.select(
        entity, known_flag(F.col(flag)).alias("__flag"), F.col(listed).alias("__listed"), at.alias("__at")
    )

    mentions = said.filter(F.col("__flag").isin(*LISTING_FLAGS)).select(
        entity,
        F.explode("__listed").alias(key),
        F.lit(None).cast("boolean").alias("__default"),
        "__at",
        (F.col("__flag") != "skip").alias("__on"),
    )
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in mentions.schema if f.name in ("__at", "__on")}
    known = defaults.select(entity, key, F.col(enabled).alias("__default"), none["__at"], none["__on"])
    last = (
        known.unionByName(mentions)
        .groupBy(entity, key)
        .agg(
            F.bool_or("__default").alias("__default"),
            F.max("__at").alias("__at"),
            F.max_by("__on", "__at").alias("__on"),
        )
        .filter(F.col("__default").isNotNull())
    )
    resets = (
        said.filter(F.col("__flag").isin(*RESET_FLAGS))
        .groupBy(entity)
        .agg(F.max("__at").alias("__reset_at"), F.max_by(F.col("__flag") == "all", "__at").alias("__reset"))
    )
    later_reset = F.col("__reset").isNotNull() & (F.col("__at").isNull() | (F.col("__at") < F.col("__reset_at")))
    return last.join(resets, entity, "left").select(
        entity,
        key,
        F.when(later_reset, F.col("__reset")).otherwise(F.coalesce("__on", "__default")).alias(enabled),
    )


def diff_snapshots(
    source: DataFrame,
    target: DataFrame,
    key: str | Sequence[str],
    content: str,
    repeated_keys: bool = True,
) -> DataFrame:
    """Compare two keyed snapshots: ``(key, status, action)`` per key of either.

    ``same`` needs nothing, ``different`` and ``missing`` (source only) are to be
    deployed, ``extra`` (target only) is reported as ``warn``. NULL content means
    the entry does not exist. If a key occurs more than once, its contents are
    compared as a bag.

    Only the key and a SHA-256 of the content are shuffled, in hash aggregations
    that collapse equal rows first. Where keys occur once on each side,
    ``repeated_keys=False`` needs one of them instead of two.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def digests(df: DataFrame, side: int) -> DataFrame:
        digest = F.unhex(F.sha2(F.col(content), 256))
        return df.select(*keys, digest.alias("__digest"), F.lit(side).alias("__side"))

    # NULL digests are told apart in the aggregation: a filter would move below it
    # and compute an edited text once more.
    exists = F.col("__digest").isNotNull()
    in_source, in_target, differs = F.col("__in_source"), F.col("__in_target"), F.col("__differs")
    status = (
        F.when(~in_target, "missing")
        .when(~in_source, "extra")
        .when(differs, "different")
        .otherwise("same")
    )
    action = F.when(~in_source, "warn").when(~in_target | differs, "deploy").otherwise("none")
    both = digests(source, 1).unionByName(digests(target, -1))
    if not repeated_keys:
        sides = {name: F.max(F.when(F.col("__side") == i, F.col("__digest"))) for name, i in (("__a", 1), ("__b", -1))}
        compared = both.groupBy(*keys).agg(*[digest.alias(name) for name, digest in sides.items()])
        in_source, in_target = F.col("__a").isNotNull(), F.col("__b").isNotNull()
        flags = [in_source.alias("__in_source"), in_target.alias("__in_target"), (F.col("__a") != F.col("__b")).alias("__differs")]
        return (
            compared.filter(in_source | in_target)
            .select(*keys, *flags)
            .select(*keys, status.alias("status"), action.alias("action"))
        )
    return (
        both.groupBy(*keys, "__digest")
        .agg(
            F.bool_or(exists & (F.col("__side") > 0)).alias("__in_source"),
            F.bool_or(exists & (F.col("__side") < 0)).alias("__in_target"),
            F.sum("__side").alias("__surplus"),
        )
        .groupBy(*keys)
        .agg(
            F.bool_or("__in_source").alias("__in_source"),
            F.bool_or("__in_target").alias("__in_target"),
            F.bool_or(exists & (F.col("__surplus") != 0)).alias("__differs"),
        )
        .filter(in_source | in_target)
        .select(*keys, status.alias("status"), action.alias("action"))
    )


#: Buckets of keys that :func:`diff_by_buckets` compares first.
BUCKETS = 4096


def diff_by_buckets(
    source: DataFrame,
    target: DataFrame,
    key: str | Sequence[str],
    content: str,
    buckets: int = BUCKETS,
) -> DataFrame:
    """What :func:`diff_snapshots` reports apart from ``same``, shuffling only keys near a change.

    Keys are dealt into ``buckets`` by a hash. A first pass folds each bucket of either side
    into one digest: how many entries it has, and sums and exclusive ors of parts of their
    SHA-256, over key and content. Only buckets whose digests differ send their keys to be
    compared one by one, so that what is shuffled falls with the share of buckets without a
    change: with ``c`` changes and many more keys, about ``c / buckets`` of them at most.
    Choose more buckets for snapshots with more changes; a task sends one row of numbers for each.

    Returns ``(key, status, action)`` as there: NULL content means the entry does not exist,
    contents of a key that occurs more than once are compared as a bag, and NULL is a key
    like any other. Both sides are read twice, and neither has to be small.
    """
    if buckets < 1:
        raise ValueError(f"buckets must be 1 or more, got {buckets!r}")
    keys = [key] if isinstance(key, str) else list(key)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    named = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})

    def folded(df: DataFrame, side: int) -> DataFrame:
        digest = F.sha2(F.concat(named, F.lit("\n"), F.sha2(F.col(content), 256)), 256)
        parts = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"p{i}") for i in range(4)]
        rows = df.filter(F.col(content).isNotNull()).select(bucket.alias("bucket"), digest.alias("digest")).select("bucket", *parts)
        sums = [F.sum(F.col(f"p{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in (0, 1)]
        return rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.bit_xor(f"p{i}").alias(f"x{i}") for i in range(4)], *sums).withColumn("side", F.lit(side))

    both = folded(source, 1).unionByName(folded(target, 2))
    digests = [c for c in both.columns if c not in ("bucket", "side")]
    # equal buckets have two rows with the same digests
    unequal = both.groupBy("bucket").agg(F.count("*").alias("sides"), *[(F.min(c) != F.max(c)).alias(f"differs_{c}") for c in digests])
    changed = unequal.filter((F.col("sides") == 1) | reduce(or_, [F.col(f"differs_{c}") for c in digests])).select(F.col("bucket").alias("__bucket"))

    def near(df: DataFrame) -> DataFrame:
        return df.join(changed, bucket == F.col("__bucket"), "left_semi")

    return diff_snapshots(near(source), near(target), key, content).filter(F.col("status") != "same")


def override_state(
    directives: DataFrame,
    order: str | Sequence[str],
    entity: str = "host",
    flag: str = "flag",
    listed: str = "sections",
) -> DataFrame:
    """What later days need of ``directives``: ``(entity, key, at, on)``.

    One row per entity and key with its last mention, and one with a NULL key for the
    entity's last reset (``only`` or ``all``), without mentions that the reset makes void.
    States of any split of the directives merge to that of all of them
    (:func:`merge_override_states`), and :func:`apply_override_state` gives what
    :func:`resolve_overrides` does. Places in the order are unique per entity, as there; two
    outcomes for one key at the same place, and unknown flags, fail the query.
    """
    at = F.struct(*([order] if isinstance(order, str) else order))
    known = directives.select(entity, known_flag(F.col(flag)).alias("__flag"), F.col(listed).alias("__listed"), at.alias("at"))
    empty = F.array().cast("array<string>")
    mentioned = F.when(F.col("__flag") == "all", empty).otherwise(F.coalesce(F.array_distinct("__listed"), empty))
    own = F.transform(mentioned, lambda k: F.struct(k.alias("key"), (F.col("__flag") != "skip").alias("on")))
    said = F.filter(own, lambda x: x["key"].isNotNull())
    reset = F.array(F.struct(F.lit(None).cast("string").alias("key"), (F.col("__flag") == "all").alias("on")))
    rows = known.select(entity, "at", F.inline(F.when(F.col("__flag").isin(*RESET_FLAGS), F.concat(reset, said)).otherwise(said)))
    return merge_override_states([rows], entity)


def merge_override_states(states: Sequence[DataFrame], entity: str = "host") -> DataFrame:
    """The state of all directives from those of any split of them, in any order."""
    if not states:
        raise ValueError("states is empty")
    rows = reduce(DataFrame.unionByName, [s.select(entity, "key", "at", "on") for s in states])
    # the same outcome at the same place may come from a state that is merged twice
    last = rows.groupBy(entity, "key").agg(F.max(F.struct("at", "on")).alias("last"), F.max(F.struct("at", (~F.col("on")).alias("off"))).alias("other"))
    message = F.concat(F.lit("directives at the same place: "), F.coalesce(F.col(entity).cast("string"), F.lit("NULL")))
    on = F.when(F.col("last.on") == F.col("other.off"), F.raise_error(message).cast("boolean")).otherwise(F.col("last.on"))
    merged = last.select(entity, "key", F.col("last.at").alias("at"), on.alias("on"))
    # all mentions of an entity are next to its reset, which a window finds without a join
    reset_at = F.max(F.when(F.col("key").isNull(), F.col("at"))).over(Window.partitionBy(entity))
    # a reset that lists keys has them at its own place
    kept = merged.withColumn("__reset_at", reset_at).filter(F.col("__reset_at").isNull() | (F.col("at") >= F.col("__reset_at")))
    return kept.select(entity, "key", "at", "on")


def apply_override_state(
    defaults: DataFrame, state: DataFrame, entity: str = "host", key: str = "section", enabled: str = "enabled"
) -> DataFrame:
    """:func:`resolve_overrides` from a state instead of the directives: ``(entity, key, enabled)``."""
    mentions = state.filter(F.col("key").isNotNull()).select(F.col(entity).alias("__e"), F.col("key").alias("__k"), "at", "on")
    resets = state.filter(F.col("key").isNull()).select(F.col(entity).alias("__r"), F.col("at").alias("__reset_at"), F.col("on").alias("__reset"))
    known = defaults.select(entity, key, enabled)
    joined = known.join(mentions, (F.col(entity) == F.col("__e")) & (F.col(key) == F.col("__k")), "left").join(resets, F.col(entity) == F.col("__r"), "left")
    later_reset = F.col("__reset").isNotNull() & (F.col("at").isNull() | (F.col("at") < F.col("__reset_at")))
    return joined.select(entity, key, F.when(later_reset, F.col("__reset")).otherwise(F.coalesce("on", enabled)).alias(enabled))
