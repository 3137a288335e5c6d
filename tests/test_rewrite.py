"""Literal cases of the text edits."""

import random
import re

import pytest

from plumbspark.operators import Rewrite, append_if_absent, rewrite_lines


def edit(spark, text, *rewrites, **more):
    docs = spark.createDataFrame([(text,)], "text string")
    return rewrite_lines(docs, rewrites, **more).first()


@pytest.mark.parametrize("scope", ["all", "first_per_line", "first_per_doc"])
@pytest.mark.parametrize(
    ("pattern", "replacement", "text", "expected"),
    [
        ("the", "[$0]", "x the y", "x [the] y"),
        (r"(\d)", "$10", "ab5", "ab50"),
        (r"(\d)", "$1$10", "ab5", "ab550"),
        (r"(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)", "$10-$1", "abcdefghij", "j-a"),
        (r"(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)\10", "$0!", "abcdefghijj", "abcdefghijj!"),
        (r"(a)\10", "x", "aa0", "x"),
        (r"(.)\1", "<$1>", "abbc", "ab<b>c".replace("ab<", "a<")),
        (r"[(](x)\1", "$1", "(xx)", "x)"),
        (r"(?<n>a)(?:b)(c)", "${n}$2", "abc", "ac"),
        (r"\Q(\E(a)", "$1", "(a", "a"),
        ("a", "1", "ba", "b1"),
        ("a", r"\$1\\", "ba", "b$1\\"),
        (r"(?<=b)a", "c", "aba", "abc"),
        (r"^a", "c", "aa", "ca"),
        (r"\ba\b", "c", "ba a", "ba c"),
        ("none", "c", "aba", "aba"),
    ],
)
def test_groups(spark, scope, pattern, replacement, text, expected):
    row = edit(spark, text, Rewrite(pattern, replacement, scope))
    assert row.text == expected
    assert row.changed == (text != expected)


@pytest.mark.parametrize(
    ("scope", "expected"),
    [("first_per_line", "X a b\nX\n\nX"), ("first_per_doc", "X a b\na  b\n\na b"), ("all", "X X\nX\n\nX")],
)
def test_scopes(spark, scope, expected):
    assert edit(spark, "a b a b\na  b\n\na b", Rewrite(r"a\s+b", "X", scope)).text == expected


def test_first_in_document_stays_in_a_line(spark):
    assert edit(spark, "a\nb a b\na b\n", Rewrite(r"a\s+b", "X", "first_per_doc")).text == "a\nb X\na b\n"


def test_nothing_to_edit(spark):
    for text in (None, "", "\n", "no hit\r"):
        row = edit(spark, text, Rewrite(r"a\s", "X", "first_per_doc"), Rewrite("q", "r"))
        assert row.text == text and row.changed is False


def test_twice_is_once(spark):
    docs = spark.createDataFrame([("a=1\nb=2\n",), ("b",), (None,)], "text string")
    rewrites = [Rewrite(r"^a=.*$", "a=3"), Rewrite("b", "c", "first_per_doc", literal=True)]
    once = rewrite_lines(docs, rewrites).drop("changed")
    again = rewrite_lines(once, rewrites)
    assert [tuple(r) for r in again.collect()] == [(r.text, False) for r in once.collect()]
    block = append_if_absent(docs, "# marker", "# marker\nx=1\n").drop("changed")
    again = append_if_absent(block, "# marker", "# marker\nx=1\n").collect()
    assert [r.text for r in again] == ["a=1\nb=2\n# marker\nx=1\n", "b# marker\nx=1\n", "# marker\nx=1\n"]
    assert not any(r.changed for r in again)


def test_missing_documents(spark):
    docs = spark.createDataFrame([(None,), ("x \n ",)], "text string")
    made = append_if_absent(docs, "m", "m", trim_end=True).collect()
    assert [tuple(r) for r in made] == [("m", True), ("xm", True)]
    kept = append_if_absent(docs, "m", "m", on_missing="skip").collect()
    assert [tuple(r) for r in kept] == [(None, False), ("x \n m", True)]


def test_edits_follow_each_other(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b # m"), (3, "c"), (4, "c # m")], "id long, text string")
    steps = [lambda d: append_if_absent(d, "# m", " # m"), lambda d: rewrite_lines(d, [Rewrite("b", "B")])]
    for order in (steps, steps[::-1]):
        done = docs
        for step in order:
            done = step(done)
        assert sorted(done.columns) == ["changed", "id", "text"]
        assert {r.id: (r.text, r.changed) for r in done.collect()} == {1: ("a # m", True), 2: ("B # m", True), 3: ("c # m", True), 4: ("c # m", False)}


def test_random_edits_agree_with_python(spark):
    """Patterns of groups and back references over random texts, in all scopes."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("aab \n") for _ in range(rng.randint(0, 25))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for _ in range(12):
        groups = rng.randint(1, 3)
        parts = [rng.choice(["(a+)", "(b|ab)", "([ab])", "( ?a)"]) for _ in range(groups)]
        pattern = "".join(parts) + rng.choice(["", rf"\{rng.randint(1, groups)}", "(?:b|$)", r"\b"])
        number = rng.randint(0, groups)
        for scope in ("first_per_line", "first_per_doc", "all"):
            got = {r.id: r.text for r in rewrite_lines(docs, [Rewrite(pattern, f"<${number}>0", scope)]).collect()}
            for i, text in enumerate(texts):
                lines = text.split("\n")
                hit = next((k for k, line in enumerate(lines) if re.search(pattern, line)), None)
                edited = [
                    line if scope == "first_per_doc" and k != hit else re.sub(pattern, rf"<\g<{number}>>0", line, count=scope != "all")
                    for k, line in enumerate(lines)
                ]
                assert got[i] == "\n".join(edited), (pattern, scope, text)
