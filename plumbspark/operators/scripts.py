"""Edit scripts given as a table: each document runs the steps of its own path, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.lines import join_lines, line_regex_of, text_lines
from plumbspark.operators.rewrite import SCOPES, TRAILING_WHITESPACE

KINDS = ("rewrite", "append")

#: Columns of a script and their defaults; those without one have to be given.
STEP_COLUMNS = {
    "pattern": ("string", None),
    "replacement": ("string", ""),
    "scope": ("string", "first_per_line"),
    "literal": ("boolean", False),
    "unless": ("string", None),
    "marker": ("string", None),
    "marker_mode": ("string", "fixed"),
    "block": ("string", ""),
    "on_missing": ("string", "create"),
    "trim_end": ("boolean", False),
}

#: Stands around what a match is replaced with; noncharacters, which no text holds.
_MARK = "￿﷐￿"


def run_edit_scripts(docs: DataFrame, scripts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``docs`` after the steps that ``scripts`` has for their path; sets ``changed``.

    ``scripts`` is ``(path, step, kind, ...)``: the steps of a path run by ascending ``step``,
    each on the outcome of the last. ``step`` is unique within a path, or the query fails. The other
    columns are optional, and NULL stands for the default:

    - ``rewrite``: ``pattern``, ``replacement``, ``scope``, ``literal`` and ``unless`` as in
      :class:`plumbspark.operators.Rewrite`. A pattern has to be given.
    - ``append``: ``marker``, ``block``, ``marker_mode``, ``on_missing`` and ``trim_end`` as in
      :func:`plumbspark.operators.append_if_absent`. A marker has to be given.

    Unknown kinds, scopes, modes and values of ``on_missing`` fail the query. Documents of
    paths without a script, and rewrites of missing (NULL) documents, change nothing.
    ``changed`` says whether the text is another one than before, and stays true where an
    earlier edit set it.

    The steps of a path become one array, which documents meet in one equi-join on the
    path: a document is one row throughout, whatever the number of its steps.
    """
    given = {f.lower(): f for f in scripts.columns}
    columns = []
    for name, (kind, default) in STEP_COLUMNS.items():
        column = F.col(given[name]).cast(kind) if name in given else F.lit(None).cast(kind)
        columns.append(F.coalesce(column, F.lit(default).cast(kind)).alias(name))
    steps = scripts.select(F.col("path").alias("__path"), F.struct("step", "kind", *columns).alias("s"))
    by_path = steps.groupBy("__path").agg(F.sort_array(F.collect_list("s")).alias("__steps"), F.count_distinct("s.step").alias("__distinct"))
    several = F.raise_error(F.concat(F.lit("a step occurs twice: "), "__path")).cast("array<string>")
    twice = F.when(F.size("__steps") > F.col("__distinct"), several).isNotNull()
    by_path = by_path.select("__path", F.when(~twice, F.col("__steps")).alias("__steps"))

    old = F.col(text)
    new = F.when(F.col("__steps").isNull(), old).otherwise(F.aggregate("__steps", old.cast("string"), _step))
    edited = docs.join(by_path, F.col(path) == F.col("__path"), "left").withColumn("__new", new)
    changed = ~old.eqNullSafe(F.col("__new"))
    if "changed" in docs.columns:
        changed = changed | F.coalesce(F.col("changed").cast("boolean"), F.lit(False))
    kept = [F.col("__new").alias(text) if c == text else F.col(c) for c in docs.columns if c != "changed"]
    return edited.select(*kept, changed.alias("changed"))


def _step(text: Column, s: Column) -> Column:
    return (
        F.when(s["kind"] == "rewrite", F.when(text.isNotNull(), _rewrite(text, s)))
        .when(s["kind"] == "append", _append(text, s))
        .otherwise(_refuse("unknown kind of step", s["kind"]))
    )


def _refuse(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value, F.lit("NULL")))).cast("string")


def _append(text: Column, s: Column) -> Column:
    regex = line_regex_of(s["marker"], s["marker_mode"], F.lit(False))
    holds = F.when(s["marker_mode"] == "fixed", text.contains(s["marker"])).otherwise(
        F.exists(text_lines(text), lambda line: F.regexp_instr(line, regex) > 0)
    )
    missing = F.when(s["on_missing"] == "create", s["block"]).when(s["on_missing"] != "skip", _refuse("unknown on_missing", s["on_missing"]))
    kept = F.when(s["trim_end"], F.rtrim(text, F.lit(TRAILING_WHITESPACE))).otherwise(text)
    return (
        F.when(F.coalesce(s["marker"], F.lit("")) == "", _refuse("a step without a marker appends", s["block"]))
        .when(text.isNull(), missing)
        .when(holds, text)
        .otherwise(F.concat(kept, s["block"]))
    )


def _rewrite(text: Column, s: Column) -> Column:
    scope, literal = s["scope"], s["literal"]
    regex = F.concat(F.lit("(?sd)"), s["pattern"])
    lines = lambda edit: join_lines(F.transform(text_lines(text), edit), text)
    new = (
        F.when(literal & (scope == "all"), F.replace(text, s["pattern"], s["replacement"]))
        .when(literal & (scope == "first_per_line"), lines(lambda line: _replace_literal(line, s)))
        .when(literal & (scope == "first_per_doc"), _replace_literal(text, s))
        .when(scope == "all", lines(lambda line: F.regexp_replace(line, regex, s["replacement"])))
        .when(scope == "first_per_line", lines(lambda line: _replace_match(line, regex, s["replacement"])))
        .when(scope == "first_per_doc", _replace_in_first_line(text, regex, s["replacement"]))
        .otherwise(_refuse(f"scope must be one of {SCOPES}, got", scope))
    )
    return (
        F.when(F.coalesce(s["pattern"], F.lit("")) == "", _refuse("an empty pattern cannot be replaced", scope))
        .when(F.coalesce(text.contains(s["unless"]), F.lit(False)), text)
        .otherwise(new)
    )


def _replace_literal(text: Column, s: Column) -> Column:
    at = F.position(s["pattern"], text)
    rest = F.substr(text, at + F.length(s["pattern"]))
    return F.when(at > 0, F.concat(F.left(text, at - 1), s["replacement"], rest)).otherwise(text)


def _replace_match(line: Column, regex: Column, replacement: Column) -> Column:
    """Replace the first match of a line by ``replacement``, in which ``$1`` and the like stand for groups.

    All matches are replaced by marked texts; the first of these is taken, and what follows
    the first match comes from the line itself.
    """
    mark = F.lit(_MARK)
    parts = F.split(F.regexp_replace(line, regex, F.concat(mark, replacement, mark)), _MARK, 3)

    def edited(found: Column) -> Column:
        before = F.get(found, F.lit(0))
        rest = F.substr(line, F.length(before) + F.coalesce(F.length(F.regexp_substr(line, regex)), F.lit(0)) + 1)
        return F.concat(before, F.get(found, F.lit(1)), rest)

    refused = _refuse("a line holds the noncharacters that mark a match", line)
    one = F.get(F.transform(F.array(parts), edited), F.lit(0))
    return F.when(F.regexp_instr(line, regex) == 0, line).when(line.contains(_MARK), refused).otherwise(one)


def _replace_in_first_line(text: Column, regex: Column, replacement: Column) -> Column:
    def edit(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda line: F.regexp_instr(line, regex) > 0), True).cast("int")
        edited = lambda at: F.concat(
            F.slice(lines, 1, at - 1), F.array(_replace_match(F.get(lines, at - 1), regex, replacement)), F.slice(lines, at + 1, F.size(lines))
        )
        return F.get(F.transform(F.array(at), lambda at: F.when(at > 0, edited(at)).otherwise(lines)), F.lit(0))

    # Arrays of one, so that lines and position are computed once.
    return join_lines(F.get(F.transform(F.array(text_lines(text)), edit), F.lit(0)), text)
