"""Turn manifests, file inventories and documents into rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.lines import line_predicate, text_lines
from plumbspark.functions.paths import basename, glob_match


def manifest_items(
    manifests: DataFrame,
    token: str = "first",
    comment: str = "col0",
    strip_nul: bool = False,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Items of line-list manifests: ``(source, line_no, item)``, lines from 1.

    ``manifests`` holds whole texts in column ``text``, or, if it has a
    ``line_no`` column as from :func:`plumbspark.sources.number_lines`, one line
    per row.

    ``token="first"`` keeps the part of each line before its first space,
    ``"all"`` every whitespace-separated token. ``comment="col0"`` drops lines
    with ``#`` in the first column, ``"indented"`` also those with blanks before
    it; a ``#`` further right is an ordinary token. Empty items are dropped.
    """
    if token not in ("first", "all"):
        raise ValueError(f"token must be 'first' or 'all', got {token!r}")
    if comment not in ("col0", "indented"):
        raise ValueError(f"comment must be 'col0' or 'indented', got {comment!r}")
    body = F.replace(F.col(text), F.lit("\0"), F.lit("")) if strip_nul else F.col(text)
    if "line_no" in manifests.columns:
        lines = manifests.select(source, "line_no", body.alias("line"))
    else:
        lines = manifests.select(source, F.posexplode(text_lines(body)).alias("pos", "line")).select(
            source, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
        )
    is_comment = F.col("line").startswith("#") if comment == "col0" else F.col("line").rlike(r"^\s*#")
    lines = lines.filter(~is_comment)
    if token == "first":
        item = F.substring_index("line", " ", 1)
    else:
        # white space becomes blanks, at which a line is cut without a regex; empty items go below
        item = F.explode(F.split(F.translate("line", "\t\n\x0b\f\r", "     "), " "))
    return lines.select(source, "line_no", item.alias("item")).filter(F.col("item") != "")


def select_paths(
    files: DataFrame,
    include_globs: Sequence[str],
    exclude_substrings: Sequence[str] = (),
    exclude_suffixes: Sequence[str] = (),
    max_depth: int | None = None,
    mode: str = "name",
    kind: str | None = None,
    root: str | None = None,
    path: str = "path",
) -> DataFrame:
    """Rows of a file inventory whose path fits any glob and no exclusion.

    ``mode="name"`` tests the last path component, ``"path"`` the whole path.
    ``max_depth`` counts components below ``root`` (below the start of the path
    if there is none). ``kind`` is ``"file"`` or ``"dir"`` and reads the
    ``is_dir`` column. Map-only; plain globs and exclusions push down to the scan.
    """
    if mode not in ("name", "path"):
        raise ValueError(f"mode must be 'name' or 'path', got {mode!r}")
    if kind not in (None, "file", "dir"):
        raise ValueError(f"kind must be 'file', 'dir' or None, got {kind!r}")
    if not include_globs:
        raise ValueError("include_globs is empty")
    subject = basename(path) if mode == "name" else F.col(path)
    keep = reduce(or_, [glob_match(subject, glob) for glob in include_globs])
    if mode == "name":
        # Implied by the name test, and can be checked by the scan itself.
        endings = [_literal_ending(glob) for glob in include_globs]
        if all(endings):
            keep = reduce(or_, [F.col(path).endswith(e) for e in endings]) & keep
    for part in exclude_substrings:
        keep = keep & ~F.col(path).contains(part)
    for part in exclude_suffixes:
        keep = keep & ~F.col(path).endswith(part)
    if kind is not None:
        keep = keep & (F.col("is_dir") == F.lit(kind == "dir"))
    below = F.regexp_replace(path, "^/+", "")
    if root is not None:
        prefix = root.rstrip("/") + "/"
        keep = keep & F.col(path).startswith(prefix)
        below = F.substring(path, len(prefix) + 1, 2**31 - 1)
    if max_depth is not None:
        keep = keep & (F.size(F.split(below, "/")) <= max_depth)
    return files.filter(keep)


def match_lines(
    docs: DataFrame,
    pattern: str,
    mode: str = "regex",
    keys: Sequence[str] = ("host", "path"),
    ignore_case: bool = False,
    invert: bool = False,
    text: str = "text",
) -> DataFrame:
    """Documents with a matching line: ``(keys, n_lines, first_line_no)``.

    ``n_lines`` counts the matching lines and ``first_line_no`` is the first of
    them, from 1; ``keys`` are the columns to keep. Map-only: each document
    unfolds into one row, or none.
    """
    test = line_predicate(pattern, mode, ignore_case, invert)
    hits = docs.select(*keys, F.transform(text_lines(text), test).alias("__hits"))
    found = F.struct(
        F.size(F.filter("__hits", lambda hit: hit)).cast("bigint").alias("n_lines"),
        F.array_position("__hits", True).alias("first_line_no"),
    )
    return hits.select(*keys, F.inline(F.when(F.array_contains("__hits", True), F.array(found))))


def _literal_ending(glob: str) -> str:
    if "[" in glob or "]" in glob:
        return ""
    return glob.replace("?", "*").rsplit("*", 1)[-1]
