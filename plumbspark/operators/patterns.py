"""Tables of globs, line patterns and classes, each row found by a literal that it requires."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.lines import line_regex_column, text_lines
from plumbspark.functions.paths import basename

#: Characters of a literal by which a pattern without a literal beginning or end is looked up.
GRAM = 3

#: Ids of one glob that meet its paths in one group; more are dealt out in tiles.
TILE_IDS = 1024

#: Line patterns that one pass over the documents searches for.
BLOCK_PATTERNS = 10_000

#: Literals up to which a document is searched for each of them; more are looked up by their first characters.
FEW_LITERALS = 500

#: A class of a glob; a "]" right after its beginning is a member.
_CLASS = r"\[!?\]?[^\]]*\]"


def glob_regex(glob: Column) -> Column:
    """Java regex of shell globs (``*``, ``?``, ``[..]``, ``[!..]``) that fits a whole text."""

    def token(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r"^\[!?", ""), r"\]$", "")
        members = F.regexp_replace(inner, r"([\\\[\]^&])", r"\\$1")
        quoted = F.regexp_replace(x, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
        return (
            F.when(x == "*", ".*")
            .when(x == "?", ".")
            .when(F.length(x) > 1, F.concat(F.lit("["), F.when(x.startswith("[!"), "^").otherwise(""), members, F.lit("]")))
            .otherwise(quoted)
        )

    tokens = F.regexp_extract_all(glob, F.lit(f"(?s){_CLASS}|."), F.lit(0))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, token), ""), F.lit(r"\z"))


def _anchors(globs: DataFrame) -> DataFrame:
    """Each glob with what a path that fits it needs, and the key that it is looked up by.

    ``__begin``, ``__end``, ``__piece`` are literals, ``__least`` the characters at least, ``__size`` their
    number if there is no ``*``, else -1. ``__regex`` is NULL where these say all. The key is
    a hash of ``__side``, ``__literal`` and ``__size``.
    """
    plain = F.regexp_replace("glob", _CLASS, "*")
    begin, end = F.regexp_extract(plain, r"^[^*?]*", 0), F.regexp_extract(plain, r"[^*?]*$", 0)
    pieces = F.regexp_extract_all(plain, F.lit(r"[^*?]+"), F.lit(0))
    piece = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("size"), x.alias("text"))))["text"]
    side = F.when(F.length(begin) >= F.greatest(F.length(end), F.lit(1)), "begin").when(F.length(end) > 0, "end").when(piece.isNotNull(), "piece")
    # a class is one character, as "?" is
    tokens = F.regexp_replace("glob", _CLASS, "?")
    stars = F.length(tokens) - F.length(F.replace(tokens, F.lit("*"), F.lit("")))
    around = (stars == 2) & tokens.startswith("*") & tokens.endswith("*") & (F.length(tokens) > 2)
    simple = ~tokens.contains("?") & ((stars < 2) | around)
    # of the powers of two the largest that is no longer than the piece
    size = F.pow(F.lit(2), F.floor(F.log2(F.length(piece)))).cast("int")
    literal = F.when(side == "begin", begin).when(side == "end", end).otherwise(F.left(piece, size))
    needs = [begin.alias("__begin"), end.alias("__end"), piece.alias("__piece"), (F.length(tokens) - stars).alias("__least")]
    found = globs.select("glob", *needs, F.when(~simple, glob_regex(F.col("glob"))).alias("__regex"), side.alias("__side"), literal.alias("__literal"), F.when(stars == 0, F.length(tokens)).otherwise(-1).alias("__size"))
    return found.withColumn("__key", F.xxhash64("__side", "__literal", "__size"))


def _fits(subject: Column) -> Column:
    """Whether a path fits the glob beside it; the regex comes last, for what is left."""
    length = F.length(subject)
    literals = subject.startswith(F.col("__begin")) & subject.endswith(F.col("__end")) & F.coalesce(subject.contains(F.col("__piece")), F.lit(True))
    sized = (length >= F.col("__least")) & ((F.col("__size") < 0) | (length == F.col("__size")))
    return F.when(literals & sized, F.coalesce(F.regexp_like(subject, F.col("__regex")), F.lit(True))).otherwise(False)


def _pieces(text: Column, size: Column) -> Column:
    """All distinct pieces of ``size`` characters of ``text``."""
    return F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1)))


def match_globs(files: DataFrame, globs: DataFrame, path: str = "path", mode: str = "name") -> DataFrame:
    """Rows of ``files`` with every ``glob_id`` of ``globs`` (``glob_id, glob``) that fits them.

    ``mode="name"`` tests the last component of ``path``, ``"path"`` the whole of it; globs are
    those of :func:`plumbspark.operators.select_paths`, and a file gives a row for each that fits.
    NULL paths and globs fit nothing.

    Equal globs are one until the end. Each is looked up by its literal beginning or end, whichever is
    longer, else by the beginning of its longest literal piece, as many characters of it as a
    power of two; a glob without ``*`` also by the length that it asks for. A path is
    unfolded into hashes of its beginnings, ends and pieces of the lengths that occur among
    the globs, and meets the globs in one equi-join. Literals and lengths confirm, and a regex only
    where these don't say all. Globs without any literal are tested against each path as an
    array, as they fit most of them. Rows of a glob with many ids are dealt out in tiles of
    ``TILE_IDS`` ids, so that many ids on many paths are many tasks; the rows that come out
    are all pairs, however many these are.
    """
    if mode not in ("name", "path"):
        raise ValueError(f"mode must be 'name' or 'path', got {mode!r}")
    given = globs.select("glob_id", "glob").filter(F.col("glob").isNotNull())
    tiles = given.groupBy("glob").agg(F.ceil(F.count("*") / TILE_IDS).cast("int").alias("__tiles"))
    anchors = _anchors(tiles)
    subject = basename(path) if mode == "name" else F.col(path)
    keyed = anchors.filter(F.col("__side").isNotNull())
    sizes = keyed.select(F.col("__side").alias("side"), F.length("__literal").alias("size"), (F.col("__size") >= 0).alias("whole"))
    known = sizes.agg(F.collect_set(F.struct("side", "size", "whole"))).scalar().alias("__known")
    nothing = F.array().cast("array<string>")

    def keys(x: Column) -> Column:
        size = x["size"]
        cut = F.when(x["side"] == "begin", F.array(F.left("__subject", size))).when(x["side"] == "end", F.array(F.right("__subject", size)))
        cut = F.when(F.length("__subject") < size, nothing).otherwise(cut.otherwise(_pieces(F.col("__subject"), size)))
        return F.transform(cut, lambda literal: F.xxhash64(x["side"], literal, F.when(x["whole"], F.length("__subject")).otherwise(-1)))

    named = files.withColumn("__subject", subject).filter(F.col("__subject").isNotNull())
    # a constant of the plan has to be a column before a function of arrays can take it
    looked_up = named.select("*", known).select(*named.columns, F.explode(F.array_distinct(F.flatten(F.transform("__known", keys)))).alias("__key"))
    found = looked_up.join(keyed, "__key").filter(_fits(F.col("__subject"))).select(*files.columns, "glob")
    bare = anchors.filter(F.col("__side").isNull()).agg(F.collect_list(F.struct("glob", glob_regex(F.col("glob")).alias("regex")))).scalar().alias("__bare")
    fitting = F.filter("__bare", lambda g: F.regexp_like("__subject", g["regex"]))
    rest = named.select("*", bare).select(*files.columns, F.explode(F.transform(fitting, lambda g: g["glob"])).alias("glob"))
    return _with_ids(found.unionByName(rest).withColumnRenamed("glob", "__glob"), given.withColumnRenamed("glob", "__glob"), tiles.withColumnRenamed("glob", "__glob"), files.columns)


def _with_ids(found: DataFrame, given: DataFrame, tiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``found`` (``columns, __glob``) with each ``glob_id`` of its glob."""
    dealt = given.join(tiles, "__glob").select("__glob", "glob_id", F.pmod(F.xxhash64("glob_id"), "__tiles").cast("int").alias("__tile"))
    met = found.join(tiles, "__glob").select(*columns, "__glob", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)).alias("__tile"))
    # a number, as tasks would be merged by the bytes of rows that have yet to multiply
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, "__glob", "__tile").join(dealt, ["__glob", "__tile"]).select(*columns, "glob_id")


def required_literal(pattern: Column, mode: Column, ignore_case: Column) -> Column:
    """A text that every line holds which matches, by the pattern's own letters; NULL if it is hard to tell.

    Fixed texts are their own literal. Of a regex it is the longest run of ordinary characters outside of
    groups, classes, escapes and quantified characters. Alternatives, flags, lookarounds, numeric
    or quoted escapes, and patterns that ignore case give NULL.
    """
    hard = pattern.rlike(r"\||\(\?|\\[xupPkQEcN0]")
    # from the first bracket to the last, so that nested ones need no care
    body = F.regexp_replace(pattern, r"(?s)\\[0-9]+|\\.", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)\(.*\)", "\n"), r"(?s)\[.*\]", "\n")
    body = F.regexp_replace(body, r"[^\n](?:[?*]|\{[^}]*\})", "\n")
    runs = F.split(F.regexp_replace(body, r"[.^$+?*{}()\[\]]", "\n"), "\n", -1)
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("size"), x.alias("text"))))["text"]
    how = F.coalesce(mode, F.lit("regex"))
    literal = F.when(how.isin("fixed", "fixed_line", "suffix"), pattern).when(~hard, longest)
    return F.when(~F.coalesce(ignore_case, F.lit(False)), F.nullif(literal, F.lit("")))


def match_line_patterns(
    docs: DataFrame,
    patterns: DataFrame,
    keys: Sequence[str] = ("host", "path"),
    text: str = "text",
    block: int = BLOCK_PATTERNS,
) -> DataFrame:
    """Matching lines of every document and pattern: ``(keys, pattern_id, n_lines, first_line_no)``.

    ``patterns`` is ``(pattern_id, pattern)`` with optional ``mode`` and ``ignore_case`` as in
    :func:`plumbspark.operators.check_rules`; each counts as in :func:`plumbspark.operators.match_lines`,
    and pairs without a matching line give no row. NULL texts and patterns match nothing.

    A regex is run only over documents that hold its :func:`required_literal`. Up to
    ``FEW_LITERALS`` patterns a document is searched for each literal; of more only for those
    whose first three characters it has, by the pieces that document and literals have in common.
    Patterns without a literal of three characters run over every document. A document's lines are split once for all patterns, and nothing is shuffled.
    The patterns are a constant of the plan, ``block`` of them at a time; with more each block
    is a pass of its own.
    """
    optional = {"mode": "string", "ignore_case": "boolean"}
    given = [F.col(c).cast(t).alias(c) if c in patterns.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    named = patterns.filter(F.col("pattern").isNotNull()).select("pattern_id", "pattern", *given)
    literal = required_literal(F.col("pattern"), F.col("mode"), F.col("ignore_case"))
    table = named.select("pattern_id", line_regex_column("pattern", "mode", "ignore_case").alias("regex"), literal.alias("literal"))
    table = table.withColumn("gram", F.when(F.length("literal") >= GRAM, F.left("literal", F.lit(GRAM))))
    count = named.count()
    n_blocks = max(1, -(-count // block))
    dealt = [table.filter(F.pmod(F.xxhash64("pattern_id"), F.lit(n_blocks)) == k) for k in range(n_blocks)]
    return reduce(DataFrame.unionByName, [_match_block(docs, part, list(keys), text, min(count, block) <= FEW_LITERALS) for part in dealt])


def _match_block(docs: DataFrame, table: DataFrame, keys: list[str], text: str, few: bool) -> DataFrame:
    pattern = F.struct("pattern_id", "regex", "literal")
    known = table.filter(F.col("gram").isNotNull())
    grams = known.groupBy("gram").agg(F.collect_list(pattern).alias("patterns"))
    index = known.agg(F.collect_list(pattern)).scalar().alias("__index") if few else grams.agg(F.map_from_entries(F.collect_list(F.struct("gram", "patterns")))).scalar().alias("__index")
    bare = table.filter(F.col("gram").isNull()).agg(F.collect_list(pattern)).scalar().alias("__bare")
    body = F.col(text)

    def looked_up(index: Column) -> Column:
        if few:
            return F.filter(index, lambda p: body.contains(p["literal"]))
        held = F.array_intersect(_pieces(body, F.lit(GRAM)), F.map_keys(index))
        near = F.flatten(F.transform(held, lambda gram: F.element_at(index, gram)))
        return F.filter(near, lambda p: body.contains(p["literal"]))

    def counted(lines: Column, p: Column) -> Column:
        # regexp_instr keeps its compiled pattern from line to line, unlike rlike
        hits = F.transform(lines, lambda line: F.regexp_instr(line, p["regex"]) > 0)

        def found(hits: Column) -> Column:
            return F.struct(p["pattern_id"].alias("pattern_id"), F.size(F.filter(hits, lambda hit: hit)).cast("bigint").alias("n_lines"), F.array_position(hits, True).alias("first_line_no"))

        return F.get(F.transform(F.array(hits), found), F.lit(0))

    # Arrays of one, so that lines and hits are computed once.
    asked = docs.filter(body.isNotNull()).select(*keys, body, bare, index)
    asked = asked.select(*keys, text, F.concat("__bare", looked_up(F.col("__index"))).alias("__asked"))
    every = F.transform(F.array(text_lines(text)), lambda lines: F.transform("__asked", lambda p: counted(lines, p)))
    found = F.filter(F.flatten(every), lambda x: x["n_lines"] > 0)
    return asked.select(*keys, F.inline(found))


CLASS_KINDS = ("equals", "begins", "ends", "regex")


def classify_by_table(
    df: DataFrame, rules: DataFrame, keys: Sequence[str], attributes: Sequence[str], default: str = "unknown", output: str = "label"
) -> DataFrame:
    """``(keys, label)``: the label of the first rule that holds for each row, else ``default``.

    ``rules`` is ``(rank, label, attribute, kind, value)``: a rule holds where ``attribute``, one of
    ``attributes``, ``equals`` the value, ``begins`` or ``ends`` with it, or holds a match of it as a
    ``regex``. The smallest rank is first; of equal ranks the smallest label. Conditions on several
    attributes go into a column of their own first. ``df`` has one row per ``keys``; NULL
    attributes fit no rule, and another kind fails the query.

    Values, beginnings and ends of the lengths that occur among the rules meet them in one
    equi-join, and one aggregation by ``keys`` takes the first; the regexes, which no key can
    find, are tested in each row as a constant array.
    """
    message = F.concat(F.lit("unknown kind of class: "), F.coalesce("kind", F.lit("NULL")))
    kind = F.when(F.col("kind").isin(*CLASS_KINDS), F.col("kind")).otherwise(F.raise_error(message).cast("string"))
    known = rules.select(F.struct("rank", "label").alias("said"), "attribute", kind.alias("kind"), "value")
    sizes = known.filter(F.col("kind") != "regex").select("attribute", "kind", F.when(F.col("kind") != "equals", F.length("value")).alias("size"))
    probes = sizes.agg(F.collect_set(F.struct("attribute", "kind", "size"))).scalar().alias("__probes")
    tests = known.filter(F.col("kind") == "regex").agg(F.collect_list(F.struct("said", "attribute", "value"))).scalar().alias("__tests")
    values = F.create_map(*[x for a in attributes for x in (F.lit(a), F.col(a).cast("string"))])

    def probe(x: Column) -> Column:
        value = F.element_at("__values", x["attribute"])
        part = F.when(x["kind"] == "equals", value).when(x["kind"] == "begins", F.left(value, x["size"])).otherwise(F.right(value, x["size"]))
        return F.struct(x["attribute"].alias("attribute"), x["kind"].alias("kind"), part.alias("value"))

    # constants of the plan have to be columns before a function of arrays can take them
    held = df.select(*keys, values.alias("__values"), probes, tests)
    looked_up = held.select(*keys, F.inline(F.transform("__probes", probe))).join(known, ["attribute", "kind", "value"]).select(*keys, "said")
    fits = F.filter("__tests", lambda t: F.coalesce(F.regexp_like(F.element_at("__values", t["attribute"]), t["value"]), F.lit(False)))
    first = F.array_min(F.transform(fits, lambda t: t["said"]))
    found = looked_up.unionByName(held.select(*keys, first.alias("said")))
    return found.groupBy(*keys).agg(F.coalesce(F.min("said")["label"], F.lit(default)).alias(output))
