"""Operators whose globs, patterns, classes, days or buckets are tables, against their list forms."""

import random

import pytest
from pyspark.sql import functions as F

from plumbspark.functions.paths import glob_match
from plumbspark.operators import (
    apply_override_state,
    classify,
    classify_by_table,
    diff_by_buckets,
    diff_snapshots,
    match_globs,
    match_line_patterns,
    match_lines,
    merge_override_states,
    override_state,
    resolve_overrides,
)
from plumbspark.operators.patterns import required_literal
from plumbspark.sources import read_marked_lines


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


GLOBS = ["*", "?", "a*", "*.py", "a?c", "[ab]*", "[!a]*", "*mid*", "*x?z*", "a.b", "[]x]y", "*[0-9].txt", "ab[c", "a[!b]*d", "", "**", "*é*", "a\\*", "*$", "(x)*", "*[a-c]mid[d-f]*", "*m*", "[a]"]
NAMES = ["", "a", "b", "abc", "a.b", "x.py", "amidb", "1mide", "cmidd", "xyz", "0xqz1", "]y", "xy", "f7.txt", "ab[c", "acd", "a\\", "a\\b", "é", "x$", "(x)", "m", "ab\nc", "py", ".py"]


@pytest.mark.parametrize("mode", ["name", "path"])
def test_globs_as_one_by_one(spark, mode):
    files = spark.createDataFrame([(f"/d/{x}" if mode == "name" else x, i) for i, x in enumerate(NAMES)] + [(None, 99)], "path string, regex int")
    globs = spark.createDataFrame([*enumerate(GLOBS), (77, None)], "glob_id int, glob string")
    got = rows(match_globs(files, globs, mode=mode))
    subject = F.element_at(F.split("path", "/"), -1) if mode == "name" else F.col("path")
    expected = [(r.path, r.regex, i) for i, glob in enumerate(GLOBS) for r in files.filter(glob_match(subject, glob)).collect()]
    assert got == sorted(expected, key=repr)


def test_equal_globs_meet_paths_in_tiles(spark, monkeypatch):
    monkeypatch.setattr("plumbspark.operators.patterns.TILE_IDS", 2, raising=False)
    paths = [f"/d/{i % 7}/page.html" for i in range(40)] + ["page.html", "html", ""]
    files = spark.createDataFrame([(x, i) for i, x in enumerate(paths)], "path string, __n int")
    texts = ["*page.html", "*page.html", "/d/?/page.html", "*/3/p*", "*", "*l", "page.html", "*page*html", "*page.htmlx*", "?"] * 3
    ids = [None if i % 5 == 0 else i % 11 for i in range(len(texts))]
    globs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "glob_id int, glob string")
    found = match_globs(files, globs, mode="path")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a path meets an equal glob once, and all its ids only in tasks dealt by glob and tile
    assert "__tile" in plan and "REPARTITION_BY_NUM" in plan
    expected = [(r.path, r["__n"], i) for i, glob in zip(ids, texts, strict=True) for r in files.filter(glob_match(F.col("path"), glob)).collect()]
    assert rows(found) == sorted(expected, key=repr)


def test_thousands_of_globs_without_a_nested_loop(spark):
    globs = spark.range(6000).selectExpr("id AS glob_id", "CASE id % 3 WHEN 0 THEN concat('f', id, '.*') WHEN 1 THEN concat('*_', id, '.txt') ELSE concat('*[x-z]q', id, 'q*') END AS glob")
    files = spark.range(9000).selectExpr("CASE id % 3 WHEN 0 THEN concat('f', id, '.md') WHEN 1 THEN concat('n_', id, '.txt') ELSE concat('ayq', id, 'q.c') END AS path")
    found = match_globs(files, globs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 6000


PATTERNS = ["the", "lic[eé]ns", "a+bc", "ab?cd", "(foo)?bar", "x|y", "^end$", r"\bword\b", r"\x41bc", r"a\.b", "ab{2}c", "colou?r", "ü", "a.c", "(?i)abc", r"(\w)\1\1", "[abc]def", "ab+?cd", "ab*?cd", "q??rst", r"\d+ items", "a(b(c)d)e", "[[a]b]cde", "", r"tab\tend", r"\Qa+b\E"]
MODES = ["regex", "regex", "word", "fixed", "fixed_line", "suffix", "regex_line"]
LINES = ["the end", "license", "aabc abcd acd", "bar foobar", "x", "end", "a word here", "Abc ABC", "a.b", "abbc", "color colour", "ü", "aaa", "bdef", "abbbcd", "rst", "12 items", "abcde", "acde", "", "tab\tend", "a+b", "colou?r", "the"]


@pytest.mark.parametrize("few", [500, 0])
def test_patterns_as_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr("plumbspark.operators.patterns.FEW_LITERALS", few)
    rng = random.Random(3)
    texts = ["\n".join(rng.choices(LINES, k=rng.randint(0, 9))) + rng.choice(["", "\n"]) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    asked = [(f"{i}/{mode}/{ignore}", p, mode, ignore) for i, p in enumerate(PATTERNS) for mode, ignore in ((rng.choice(MODES), False), ("regex", None), ("regex", True), ("fixed", False))]
    table = spark.createDataFrame(asked, "pattern_id string, pattern string, mode string, ignore_case boolean")
    expected = []
    for name, pattern, mode, ignore in asked:
        if mode == "suffix":
            pattern, mode = "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in pattern) + "$", "regex"
        expected += [(r.id, name, r.n_lines, r.first_line_no) for r in match_lines(docs, pattern, mode, ["id"], bool(ignore)).collect()]
    for block in (10_000, 30):
        assert rows(match_line_patterns(docs, table, ["id"], block=block)) == sorted(expected, key=repr)
    assert match_line_patterns(docs, table.limit(0), ["id"]).count() == 0


def test_literals(spark):
    frame = spark.createDataFrame([("abc.*defg",), ("ab+cde",), ("ab?cdef{2}",), ("x(abcdef)?yz",), (r"\d\dabc",), ("a|bcd",)], "p string")
    found = [r[0] for r in frame.select(required_literal(F.col("p"), F.lit("regex"), F.lit(False))).collect()]
    assert found == ["defg", "cde", "cde", "yz", "abc", None]


def test_classes_as_by_cases(spark):
    frame = spark.createDataFrame([(1, "darwin23", "a"), (2, "linux-gnu", "b"), (3, "linux-musl", None), (4, None, "b"), (5, "bsd", "x9"), (6, "", "")], "id int, os string, kind string")
    cases = [("mac", "startswith(os, 'darwin')"), ("musl", "endswith(os, 'musl')"), ("b", "kind = 'b'"), ("linux", "startswith(os, 'linux')"), ("digit", "rlike(kind, '[0-9]')")]
    table = [(1, "mac", "os", "begins", "darwin"), (2, "musl", "os", "ends", "musl"), (3, "b", "kind", "equals", "b"), (4, "linux", "os", "begins", "linux"), (5, "digit", "kind", "regex", "[0-9]"), (5, "z", "kind", "regex", "x")]
    rules = spark.createDataFrame(table, "rank int, label string, attribute string, kind string, value string")
    got = classify_by_table(frame, rules, ["id"], ["os", "kind"])
    assert rows(got) == rows(classify(frame, cases).select("id", "label"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.label for r in classify_by_table(frame, rules.limit(0), ["id"], ["os"], default="none").collect()} == {"none"}
    with pytest.raises(Exception, match="unknown kind"):
        classify_by_table(frame, rules.withColumn("kind", F.lit("like")), ["id"], ["os"]).collect()


def test_states_of_any_split(spark):
    rng = random.Random(5)
    keys = ["a", "b", "c"]
    said = []
    for h in range(15):
        for pos in rng.sample(range(50), rng.randint(0, 12)):
            flag = rng.choice(["only", "skip", "enable", "enable", "skip", "all"])
            said.append((f"h{h}", pos, pos % 3, flag, None if flag == "all" else rng.sample([*keys, "unheard"], rng.randint(0, 3))))
    schema = "host string, pos int, day int, flag string, sections array<string>"
    directives = spark.createDataFrame(said, schema)
    defaults = spark.createDataFrame([(f"h{h}", k, k == "a") for h in range(16) for k in keys], "host string, section string, enabled boolean")
    expected = rows(resolve_overrides(defaults, directives, "pos"))
    days = [override_state(directives.filter(F.col("day") == d), "pos") for d in (2, 0, 1)]
    assert rows(apply_override_state(defaults, override_state(directives, "pos"))) == expected
    stored = merge_override_states([merge_override_states(days[:2]), days[2], days[0]])
    assert rows(apply_override_state(defaults, stored)) == expected
    assert stored.count() <= 15 * 5
    for bad, message in (([("h", 1, 0, "only", ["a"]), ("h", 1, 0, "skip", ["a"])], "same place"), ([("h", 1, 0, "onyl", ["a"])], "unknown flag")):
        with pytest.raises(Exception, match=message):
            override_state(spark.createDataFrame(bad, schema), "pos").collect()


@pytest.mark.parametrize("buckets", [1, 64])
def test_buckets_tell_what_snapshots_do(spark, buckets):
    rng = random.Random(9)
    source = [(i % 400, "k", f"t{i}") for i in range(500)] + [(900, "k", None), (None, "k", "x"), (None, None, "x")]
    target = [(i, k, t if rng.random() < 0.97 else t and t + "!") for i, k, t in source if rng.random() < 0.98] + [(901, "k", "new"), (902, "k", None)]
    one, two = (spark.createDataFrame(x, "id long, part string, body string") for x in (source, target))
    expected = [r for r in rows(diff_snapshots(one, two, ["id", "part"], "body")) if r[2] != "same"]
    assert expected and rows(diff_by_buckets(one, two, ["id", "part"], "body", buckets)) == expected
    assert rows(diff_by_buckets(one, one.orderBy(F.rand(3)), ["id", "part"], "body", buckets)) == []


def test_only_changed_buckets_are_shuffled(spark):
    source = spark.range(20_000).selectExpr("id", "cast(id AS string) AS body")
    target = source.withColumn("body", F.when(F.col("id") == 7, "other").otherwise(F.col("body")))
    changed = diff_by_buckets(source, target, "id", "body", 256)
    assert rows(changed) == [(7, "different", "deploy")]

    def shuffled(frame):
        """The most records that any exchange of the plan that ran has written."""
        frame.collect()
        todo, most = [frame._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            if name.endswith("QueryStageExec"):
                todo.append(node.plan())
            if name == "ShuffleExchangeExec":
                most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return most

    assert shuffled(diff_snapshots(source, target, "id", "body")) >= 20_000
    assert shuffled(diff_by_buckets(source, target, "id", "body", 256)) <= 256 * 2 * 16


def test_files_with_a_byte_order_mark(spark, tmp_path):
    text = "Ubuntu-22.04\r\nDebian é\n\nend"
    lines = ["Ubuntu-22.04", "Debian é", "", "end"]
    files = {
        "le": b"\xff\xfe" + text.encode("utf-16-le"),
        "be": b"\xfe\xff" + text.encode("utf-16-be"),
        "utf8": b"\xef\xbb\xbf" + text.encode(),
        "bare": text.encode("utf-16-le"),
        "odd": b"\xff\xfe" + (text + "\n").encode("utf-16-le") + b"x",
        "cr": b"\xff\xfe" + "a\r\rb\r".encode("utf-16-le"),
        "none": b"",
        "mark": b"\xfe\xff",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in read_marked_lines(spark, str(tmp_path)).orderBy("line_no").collect():
        got.setdefault(r.source.rsplit("/", 1)[1], []).append(r.text)
    assert got == {**dict.fromkeys(("le", "be", "utf8", "bare", "odd"), lines), "cr": ["a\r\rb"]}
    kept = read_marked_lines(spark, str(tmp_path / "le"), keep_cr=True).orderBy("line_no").first()
    assert (kept.line_no, kept.text) == (1, "Ubuntu-22.04\r")
