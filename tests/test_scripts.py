"""Edit scripts as a table against the same edits as a list."""

import random

import pytest
from pyspark.sql import functions as F

from plumbspark.operators import Rewrite, append_if_absent, rewrite_lines, run_edit_scripts

COLUMNS = "path string, step int, kind string, pattern string, replacement string, scope string, literal boolean, unless string, marker string, marker_mode string, block string, on_missing string, trim_end boolean"
TEXTS = ["", "a", "ab ab\naab\n", "b\n\nx a$b\\ 1\r\n a", "aaa\nbab\tb ", "ab", " a b\n \n", "é a\nbé", "x" * 50 + "\nab" * 20, None]
PATTERNS = ["a", "(a)(b)", "(a)b|(b)", "^a", r"(?<=a)b", "b$", r"(\w)\1", "a*", "[ab]+", r"(?<n>a)b", "é", r"\s", "(?=b)"]
REPLACEMENTS = {0: ["x", "", "$0$0", "-"], 1: ["<$1>", "$1$0", r"\$1"], 2: ["$2$1", "$1.$2"]}
GROUPS = {"(a)(b)": 2, "(a)b|(b)": 1, r"(\w)\1": 1, r"(?<n>a)b": 1}


def step(rng):
    if rng.random() < 0.3:
        mode = rng.choice(["fixed", "fixed_line", "regex", "regex_line", "word"])
        return ("append", None, None, None, None, None, rng.choice(["a", "ab", "end", "b"]), mode, rng.choice(["\nend", "end\n", "ab", ""]), rng.choice(["create", "skip"]), rng.random() < 0.5)
    literal = rng.random() < 0.4
    pattern = rng.choice(["a", "ab", "a$b\\", "b\n", " "]) if literal else rng.choice(PATTERNS)
    replacement = rng.choice(["$1", "x\\", "y\nz", ""]) if literal else rng.choice(REPLACEMENTS[rng.randint(0, GROUPS.get(pattern, 0))])
    return ("rewrite", pattern, replacement, rng.choice(["first_per_line", "first_per_doc", "all"]), literal, rng.choice([None, None, "x", "end"]), None, None, None, None, None)


def by_list(docs, steps):
    for kind, pattern, replacement, scope, literal, unless, marker, mode, block, on_missing, trim in steps:
        if kind == "append":
            docs = append_if_absent(docs, marker, block, on_missing, mode, trim)
        else:
            docs = rewrite_lines(docs, [Rewrite(pattern, replacement, scope, literal, unless)])
    return docs


def test_random_scripts_agree_with_the_list_form(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    scripts = {f"p{k}": [step(rng) for _ in range(rng.randint(1, 4))] for k in range(40)}
    table = spark.createDataFrame([(p, 3 * i, *s) for p, steps in scripts.items() for i, s in enumerate(steps)], COLUMNS)
    paths = spark.createDataFrame([(p,) for p in [*scripts, "none"]], "path string")
    done = run_edit_scripts(docs.crossJoin(paths), table.orderBy(F.rand(1)))
    got = {(r.id, r.path): (r.text, r.changed) for r in done.collect()}
    assert len(got) == len(TEXTS) * 41
    for path, steps in scripts.items():
        for r in by_list(docs, steps).collect():
            assert got[r.id, path] == (r.text, r.text != TEXTS[r.id]), (steps, TEXTS[r.id])
    assert all(got[i, "none"] == (t, False) for i, t in enumerate(TEXTS))


def test_running_twice_changes_nothing_more(spark):
    docs = spark.createDataFrame([("f", t) for t in TEXTS], "path string, text string")
    script = spark.createDataFrame(
        [("f", 2, "append", None, "# end", "\n# end\n", None), ("f", 1, "rewrite", "a", None, None, "A"), ("f", 3, "rewrite", "^b", None, None, "B")],
        "path string, step int, kind string, pattern string, marker string, block string, replacement string",
    )
    once = run_edit_scripts(docs, script)
    # only the first hit of a line goes, so that a line is done after its last
    while once.where("changed").count():
        before = once
        once = run_edit_scripts(before.drop("changed"), script)
    assert [r.text for r in run_edit_scripts(once, script).collect()] == [r.text for r in once.collect()]
    kept = run_edit_scripts(docs.withColumn("changed", F.lit(True)).withColumn("step", F.lit(9)), script.limit(0))
    assert kept.columns == ["path", "text", "step", "changed"] and {r.changed for r in kept.collect()} == {True}


@pytest.mark.parametrize(
    ("row", "message"),
    [
        (("f", 1, "rewite", "a", "first_per_line", None), "unknown kind"),
        (("f", 1, "rewrite", "a", "often", None), "scope must be"),
        (("f", 1, "rewrite", None, "all", None), "empty pattern"),
        (("f", 1, "append", None, None, None), "without a marker"),
    ],
)
def test_bad_steps_fail(spark, row, message):
    docs = spark.createDataFrame([("f", "abc")], "path string, text string")
    script = spark.createDataFrame([row], "path string, step int, kind string, pattern string, scope string, marker string")
    with pytest.raises(Exception, match=message):
        run_edit_scripts(docs, script).collect()
    twice = spark.createDataFrame([("f", 1, "rewrite", "a"), ("f", 1, "rewrite", "b")], "path string, step int, kind string, pattern string")
    with pytest.raises(Exception, match="occurs twice"):
        run_edit_scripts(docs, twice).collect()


def test_a_document_is_one_row_and_stays_where_it_is(spark):
    docs = spark.createDataFrame([("f", "abc")], "path string, text string")
    script = spark.createDataFrame([("f", i, "rewrite", f"{i}") for i in range(60)], "path string, step int, kind string, pattern string")
    plan = run_edit_scripts(docs, script)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
