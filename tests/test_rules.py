"""Literal cases of rules, scopes, verdicts, classes and overrides."""

import random

import pytest
from pyspark.sql import functions as F

from plumbspark.functions import has_line
from plumbspark.operators import (
    Rule,
    ScopeRule,
    applicable,
    check_rules,
    classify,
    diff_snapshots,
    evaluate_rules,
    latest_matching,
    manifest_items,
    require_known,
    resolve_overrides,
    select_paths,
    verdict,
)
from plumbspark.operators.rules import _found_in_docs
from plumbspark.plans import conformance_results
from plumbspark.sources import small_table

RULES = "rule_id string, section string, kind string, target string, pattern string, message string"


@pytest.fixture(params=["broadcast", "shuffle"])
def join_kind(spark, request):
    """Every table join once with the rules broadcast and once without."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old if request.param == "broadcast" else "-1")
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*(columns or frame.columns)).collect()), key=repr)


def test_chains_agree_with_the_list_form(spark, join_kind):
    inventory = spark.createDataFrame([("h1", "p", "b"), ("h1", "p", "c"), ("h2", "p", "a"), ("h2", "p", "b"), ("h2", "p", "b")], "host string, kind string, name string")
    hosts = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "host string")
    rules = small_table(spark, [(x, "s", "p", x, None, f"m{x}") for x in "abc"], RULES)
    needs = [("b", "a"), ("c", "b")]
    pairs = hosts.select("host", F.lit("s").alias("section"))
    got = check_rules(pairs, rules, inventory, prerequisites=needs)
    facts = hosts.join(inventory.groupBy("host").agg(F.collect_set("name").alias("names")), "host", "left")
    listed = [Rule(x, f"array_contains(names, '{x}')", "s", requires=tuple(n for r, n in needs if r == x), on_pass=f"m{x}", on_fail=f"m{x}") for x in "abc"]
    expected = evaluate_rules(facts, listed, ["host"])
    names = ["host", "section", "rule_id", "status", "message"]
    assert rows(got, *names) == rows(expected, *names)
    assert [(r[0], r[2], r[3]) for r in rows(got, *names)] == [("h1", "a", "fail"), ("h2", "a", "pass"), ("h2", "b", "pass"), ("h2", "c", "fail"), ("h3", "a", "fail")]
    table = spark.createDataFrame(needs, "rule_id string, requires string")
    assert rows(check_rules(pairs, rules, inventory, prerequisites=table), *names) == rows(got, *names)


def test_random_chains_agree_with_the_list_form(spark):
    rng = random.Random(7)
    names = [f"r{i}" for i in range(12)]
    for _ in range(4):
        needs = [(b, a) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.2]
        facts = spark.createDataFrame([(f"h{h}", [x for x in names if rng.random() < 0.8]) for h in range(12)], "host string, names array<string>")
        scopes = [ScopeRule("s"), ScopeRule("t", "host", "h3", "exclude"), ScopeRule("t")]
        sections = {x: rng.choice("st") for x in names}
        rules = small_table(spark, [(x, sections[x], "p", x, None, "") for x in names], RULES)
        inventory = facts.select("host", F.lit("p").alias("kind"), F.explode("names").alias("name"))
        table = spark.createDataFrame(needs, "rule_id string, requires string")
        listed = [Rule(x, f"array_contains(names, '{x}')", sections[x], "host <> 'h3'" if sections[x] == "t" else None, tuple(a for b, a in needs if b == x)) for x in names]
        expected = rows(evaluate_rules(facts, listed, ["host"]), "host", "section", "rule_id", "status")
        for given in (needs, table):
            got = check_rules(applicable(facts, scopes, keep_all=True), rules, inventory, prerequisites=given)
            assert rows(got, "host", "section", "rule_id", "status") == expected


def test_a_long_chain(spark):
    count = 2000
    rules = spark.range(count).selectExpr("concat('r', id) AS rule_id", "'s' AS section", "'p' AS kind", "cast(id AS string) AS target", "cast(NULL AS string) AS pattern", "'' AS message")
    hosts = spark.createDataFrame([("h1",), ("h2",)], "host string")
    inventory = spark.range(count).where("id <> 1500").selectExpr("'h1' AS host", "'p' AS kind", "cast(id AS string) AS name")
    inventory = inventory.unionByName(inventory.limit(0)).unionByName(spark.range(count).selectExpr("'h2' AS host", "'p' AS kind", "cast(id AS string) AS name"))
    needs = [(f"r{i + 1}", f"r{i}") for i in range(count - 1)]
    for given in (needs, spark.createDataFrame(needs, "rule_id string, requires string")):
        got = check_rules(hosts.withColumn("section", F.lit("s")), rules, inventory, prerequisites=given)
        assert rows(got.groupBy("host", "status").count()) == [("h1", "fail", 1), ("h1", "pass", 1500), ("h2", "pass", count)]


def test_a_cycle_is_refused(spark):
    rules = small_table(spark, [("a", "s", "p", "a", None, "")], RULES)
    pairs = spark.createDataFrame([("h", "s")], "host string, section string")
    with pytest.raises(ValueError, match="requires itself"):
        check_rules(pairs, rules, pairs.select("host", F.lit("p").alias("kind"), F.lit("a").alias("name")), prerequisites=[("a", "b"), ("b", "a")])
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "rule_id string, requires string")
    with pytest.raises(ValueError, match="requires itself"):
        check_rules(pairs, rules, pairs.select("host", F.lit("p").alias("kind"), F.lit("a").alias("name")), prerequisites=table)


def test_one_row_for_a_rule_of_many_probes(spark, join_kind):
    pairs = spark.createDataFrame([("h1", "s"), ("h1", "t"), ("h2", "t"), ("h3", "u"), ("h4", "s")], "host string, section string")
    inventory = spark.createDataFrame([("h1", "file", "/a"), ("h2", "file", "/b"), ("h2", "file", "/b")], "host string, kind string, name string")
    rules = small_table(
        spark,
        [("r", "s", "file", "/a", None, "a missing"), ("r", "t", "file", "/b", None, "b missing"), ("other", "u", "file", "/a", None, "x"), ("other", "u", "file", "/a", None, "w")],
        RULES,
    )
    got = rows(check_rules(pairs, rules, inventory), "host", "section", "rule_id", "status", "message")
    assert got == [("h1", "s", "r", "pass", "a missing"), ("h2", "t", "r", "pass", "a missing"), ("h3", "u", "other", "fail", "w"), ("h4", "s", "r", "fail", "a missing")]
    skipped = check_rules(pairs.withColumn("applies", F.col("section") != "s"), rules, inventory)
    assert rows(skipped, "host", "status") == [("h1", "pass"), ("h2", "pass"), ("h3", "fail"), ("h4", "skip")]


@pytest.mark.parametrize("greatest", [None, 0])
def test_a_hundred_alternatives(spark, greatest):
    pairs = spark.createDataFrame([(f"h{i}", "s") for i in range(4)], "host string, section string")
    docs = spark.createDataFrame(
        [("h0", "f", "x97 \nx3 \n"), ("h1", "f", "none\n"), ("h2", "f", None), ("h3", "f", "".join(f"x{i} \n" for i in range(100)))], "host string, path string, text string"
    )
    rules = small_table(spark, [("r", "s", "line", "f", f"x{i} ", "") for i in range(100)], RULES)
    if greatest is not None:
        rules = rules.withColumn("max_count", F.lit(greatest))
    got = rows(check_rules(pairs, rules, docs=docs), "host", "status")
    found = ["pass", "fail", "fail", "pass"] if greatest is None else ["pass", "pass", "pass", "fail"]
    assert got == [(f"h{i}", s) for i, s in enumerate(found)]


def test_probes_of_a_path_meet_its_document_once(spark):
    docs = spark.createDataFrame([("h", "f", "a b c")], "host string, path string, text string")
    rules = small_table(spark, [(f"r{i}", "s", "line", "f", "a", "") for i in range(50)], RULES)
    joined = _found_in_docs(docs, rules.selectExpr("*", "'fixed' AS mode", "false AS ignore_case", "cast(NULL AS int) AS probe", "0L AS least"), "host")
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "Generate" in plan[: plan.index("Join")] and "Generate" not in join
    assert plan.count("split(") == 1


def test_wildcard_sections_stay_out_of_exchanges(spark):
    hosts = spark.createDataFrame(HOSTS, "host string, os string, distro string")
    table = small_table(spark, [(s.section, s.attribute, s.value, s.effect) for s in SCOPES], "section string, attribute string, value string, effect string")
    done = applicable(hosts, table, attributes=["os", "distro"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    main = plan[: plan.index("Subqueries")] if "Subqueries" in plan else plan
    exchanged = [x for x in main.split("\n") if "Exchange hashpartitioning" in x and "host" in x]
    assert not exchanged


def test_modes_absence_and_alternatives(spark, join_kind):
    docs = spark.createDataFrame([("h1", "f", "the end\nx THE\na.b\n"), ("h2", "f", "théorie\n/bin/zsh2\n"), ("h3", "f", None)], "host string, path string, text string")
    hosts = spark.createDataFrame([("h1",), ("h2",), ("h3",), ("h4",)], "host string")
    more = RULES + ", mode string, ignore_case boolean, max_count int"
    rules = small_table(
        spark,
        [
            ("word", "s", "line", "f", "th", "", "word", None, None),
            ("the", "s", "line", "f", "the", "", "word", True, None),
            ("two", "s", "line", "f", "the", "", "word", True, 1),
            ("none", "s", "line", "f", "zsh", "", "fixed", None, 0),
            ("whole", "s", "line", "f", "/bin/zsh", "", "fixed_line", None, None),
            ("dot", "s", "line", "f", ".b", "", "suffix", None, None),
            ("any", "s", "line", "f", "nothing", "", "fixed", None, None),
            ("any", "s", "line", "f", "a[.]b", "", "regex_line", None, None),
            ("any", "s", "pkg", "zsh", None, "", None, None, None),
            ("unpacked", "s", "pkg", "zsh", None, "", None, None, 0),
        ],
        more,
    )
    inventory = spark.createDataFrame([("h4", "pkg", "zsh"), ("h4", "pkg", "zsh")], "host string, kind string, name string")
    got = check_rules(hosts.select("host", F.lit("s").alias("section")), rules, inventory, docs)
    passed = {}
    for host, rule, status in rows(got, "host", "rule_id", "status"):
        passed.setdefault(host, set()).update({rule} if status == "pass" else set())
    assert got.count() == 4 * 8
    assert passed == {"h1": {"the", "none", "dot", "any", "unpacked"}, "h2": {"two", "unpacked"}, "h3": {"two", "none", "unpacked"}, "h4": {"two", "none", "any"}}
    with pytest.raises(Exception, match="unknown mode"):
        check_rules(hosts.select("host", F.lit("s").alias("section")), rules.withColumn("mode", F.lit("globb")), docs=docs).collect()


SCOPES = [
    *[ScopeRule(s) for s in ("packages", "tmux", "zsh", "vim", "alacritty", "python", "fonts")],
    ScopeRule("fonts", "distro", "arch", "exclude"),
    ScopeRule("gnubin", "os", "macos"),
    ScopeRule("wsl", "os", "wsl"),
    ScopeRule("keyd", "os", "linux"),
    ScopeRule("auto_cpufreq", "os", "linux"),
]
HOSTS = [("m", "macos", None), ("w", "wsl", "debian"), ("a", "linux", "arch"), ("l", "linux", "debian"), ("u", None, None)]
EVERYWHERE = {"packages", "tmux", "zsh", "vim", "alacritty", "python"}
EXPECTED_SCOPES = {
    "m": EVERYWHERE | {"fonts", "gnubin"},
    "w": EVERYWHERE | {"fonts", "wsl"},
    "a": EVERYWHERE | {"keyd", "auto_cpufreq"},
    "l": EVERYWHERE | {"fonts", "keyd", "auto_cpufreq"},
    "u": EVERYWHERE | {"fonts"},
}


def scopes_of(frame):
    found = {}
    for host, section in rows(frame, "host", "section"):
        found.setdefault(host, set()).add(section)
    return found


def test_scopes_of_lists_and_tables(spark, join_kind):
    hosts = spark.createDataFrame(HOSTS, "host string, os string, distro string")
    assert scopes_of(applicable(hosts, SCOPES)) == EXPECTED_SCOPES
    table = small_table(spark, [(s.section, s.attribute, s.value, s.effect) for s in SCOPES], "section string, attribute string, value string, effect string")
    scoped = applicable(hosts.withColumn("text", F.lit("long")), table, attributes=["os", "distro"])
    assert scopes_of(scoped) == EXPECTED_SCOPES
    assert "Cartesian" not in scoped._jdf.queryExecution().toString() and "NestedLoop" not in scoped._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        applicable(hosts, table)
    with pytest.raises(ValueError):
        applicable(hosts, [])
    with pytest.raises(Exception, match="unknown effect"):
        applicable(hosts, table.withColumn("effect", F.lit("inclde")), attributes=["os"]).collect()


DIRECTIVES = [
    ("h1", 1, "only", ["zsh"]), ("h1", 2, "enable", ["copilot", "unheard"]),
    ("h2", 1, "skip", ["zsh"]), ("h2", 2, "only", ["zsh"]),
    ("h3", 1, "only", ["zsh"]), ("h3", 2, "skip", ["zsh"]),
    ("h4", 1, "all", None),
]
EXPECTED_SETTINGS = {"h1": (True, False, True), "h2": (True, False, False), "h3": (False, False, False), "h4": (True, True, True), "h5": (True, True, False)}


def test_overrides(spark, join_kind):
    hosts = spark.createDataFrame([(f"h{i}",) for i in range(1, 6)], "host string")
    defaults = hosts.join(small_table(spark, [("zsh", True), ("vim", True), ("copilot", False)], "section string, enabled boolean"))
    directives = spark.createDataFrame(DIRECTIVES, "host string, pos int, flag string, sections array<string>")
    for order in ("pos", ["pos", "flag"]):
        done = resolve_overrides(defaults, directives, order)
        got = {(r.host, r.section): r.enabled for r in done.collect()}
        assert got == {(h, s): x for h, v in EXPECTED_SETTINGS.items() for s, x in zip(("zsh", "vim", "copilot"), v, strict=True)}
    assert "Generate explode(sequence" not in done._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="unknown flag"):
        resolve_overrides(defaults, directives.withColumn("flag", F.lit("skp")), "pos").collect()


def test_report_folds_like_the_operators(spark):
    facts = spark.createDataFrame([(f"h{i}", i) for i in range(1, 6)], "host string, n int")
    scopes = [ScopeRule("zsh"), ScopeRule("vim"), ScopeRule("copilot", "host", "nobody")]
    rules = [Rule(f"r_{s}", "n > 2", s) for s in ("zsh", "vim", "copilot", "other")]
    directives = spark.createDataFrame(DIRECTIVES, "host string, pos int, flag string, sections array<string>")
    done = conformance_results(facts, rules, scopes, directives)
    expected = {(h, f"r_{s}", "pass" if int(h[1]) > 2 else "fail") for h, v in EXPECTED_SETTINGS.items() for s, x in zip(("zsh", "vim", "copilot"), v, strict=True) if x}
    assert set(rows(done, "host", "rule_id", "status")) == expected
    with pytest.raises(Exception, match="unknown flag"):
        conformance_results(facts, rules, scopes, directives.withColumn("flag", F.lit(None).cast("string"))).collect()


def test_verdicts(spark):
    results = spark.createDataFrame([("a", "pass"), ("a", "skip"), ("b", "pass"), ("b", "fail")], "host string, status string")
    hosts = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    assert rows(verdict(results, ["host"], hosts), "host", "failed") == [("a", False), ("b", True), ("c", False)]
    assert verdict(results.limit(0)).first().failed is False


def test_classes(spark):
    raw = spark.createDataFrame(
        [("darwin23", "", ["brew"]), ("linux-gnu", "x Microsoft y", ["apt-get", "dnf"]), ("linux-gnu", "", ["dnf", "yum"]), ("linux-gnu", None, ["yum"]), ("freebsd", "", []), ("linux-gnu", "", ["pacman"])],
        "ostype string, proc_version string, commands array<string>",
    )
    systems = [("macos", "startswith(ostype, 'darwin')"), ("wsl", "startswith(ostype, 'linux') AND contains(proc_version, 'Microsoft')"), ("linux", "startswith(ostype, 'linux')")]
    managers = [(d, f"array_contains(commands, '{c}')") for d, c in (("debian", "apt-get"), ("rhel", "dnf"), ("rhel-old", "yum"), ("arch", "pacman"))]
    done = classify(classify(raw, systems, output="os"), managers, output="distro")
    assert [(r.os, r.distro) for r in done.collect()] == [("macos", "unknown"), ("wsl", "debian"), ("linux", "rhel"), ("linux", "rhel-old"), ("unknown", "unknown"), ("linux", "arch")]


def test_latest(spark):
    lines = ["Ubuntu-20.04", "Ubuntu-23.04", "Ubuntu-24.10", "Ubuntu-22.04", "Debian"]
    args = (r"^Ubuntu-(\d+)\.(\d+)$", {"year": (1, "int"), "month": (2, "int")}, "month = 4 AND year % 2 = 0", ["year", "month"], "line", "Ubuntu-24.04")
    for given, expected in ((lines, "Ubuntu-22.04"), (["Debian"], "Ubuntu-24.04")):
        assert latest_matching(spark.createDataFrame([(x,) for x in given], "line string"), "line", *args).first().latest == expected


def test_manifests(spark):
    text = "a b\n\n# c\n  # d\ne # note\nla\0st"
    docs = spark.createDataFrame([("m", text), ("n", None), ("o", "")], "source string, text string")
    assert [r.item for r in manifest_items(docs, strip_nul=True).orderBy("line_no").collect()] == ["a", "e", "last"]
    every = manifest_items(docs, token="all", comment="indented", strip_nul=True).orderBy("line_no")
    assert [(r.line_no, r.item) for r in every.collect()] == [(1, "a"), (1, "b"), (5, "e"), (5, "#"), (5, "note"), (6, "last")]


def test_paths(spark):
    files = spark.createDataFrame(
        [("/r/p/x.pyc", False), ("/r/p/.git/y.pyc", False), ("/r/p/q/__pycache__/z.pyc", False), ("/r/p/w.py", False), ("/r/p/q/__pycache__", True), ("/r/p/.github/__pycache__", True), ("/other/x.pyc", False)],
        "path string, is_dir boolean",
    )
    kept = select_paths(files, ["*.pyc"], exclude_substrings=["/.git"], kind="file", root="/r")
    assert rows(kept, "path") == [("/r/p/q/__pycache__/z.pyc",), ("/r/p/x.pyc",)]
    folders = select_paths(files, ["__pycache__"], exclude_substrings=["/.git"], kind="dir", root="/r/p/", max_depth=2)
    assert rows(folders, "path") == [("/r/p/q/__pycache__",)]


def test_lines(spark):
    cases = [
        ("x\nset -g prefix C-a", "^set -g prefix C-a", "regex", True),
        ("ssh() {", r"^ssh\(\)", "regex", True),
        ("sshd", r"^ssh\(\)", "regex", False),
        ("/bin/zsh2\n", "/bin/zsh", "fixed_line", False),
        ("a keyd b", "keyd", "word", True),
        ("keydé", "keyd", "word", False),
        ("théorie", "th", "word", False),
        ("éth", "th", "word", False),
        (None, "x", "regex", False),
        ("", "", "regex", False),
    ]
    for text, pattern, mode, expected in cases:
        got = spark.createDataFrame([(text,)], "text string").select(has_line("text", pattern, mode)).first()[0]
        assert got is expected, (text, pattern, mode)


def test_snapshots(spark, join_kind):
    source = spark.createDataFrame([("same", "x"), ("differs", "x"), ("missing", "x"), ("gone", None), (None, "k")], "path string, content string")
    target = spark.createDataFrame([("same", "x"), ("differs", "y"), ("extra", "x"), ("gone", None), (None, "k")], "path string, content string")
    expected = [("differs", "different", "deploy"), ("extra", "extra", "warn"), ("missing", "missing", "deploy"), ("same", "same", "none"), (None, "same", "none")]
    for repeated in (True, False):
        done = diff_snapshots(source, target, "path", "content", repeated_keys=repeated)
        assert rows(done) == sorted(expected, key=repr)
    doubled = diff_snapshots(source.unionByName(source.limit(1)), target, "path", "content")
    assert ("same", "different", "deploy") in rows(doubled)


def test_unknown_values_are_refused(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    require_known(frame, "x", ["a", "b", None])
    with pytest.raises(ValueError, match="unknown values"):
        require_known(frame, "x", ["a"])
    with pytest.raises(ValueError, match="no values"):
        require_known(frame.limit(0), "x", ["a"])


def test_texts_stay_where_they_are(spark):
    docs = spark.createDataFrame([("h", "f", "x")], "host string, path string, text string")
    rules = small_table(spark, [("r", "s", "line", "f", "x", "")], RULES)
    plan = check_rules(docs.select("host", F.lit("s").alias("section")), rules, docs=docs)._jdf.queryExecution().executedPlan().toString()
    exchanged = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert exchanged and not any("text" in x for x in exchanged)


def test_pairs_are_never_broadcast(spark):
    # rules from a table that Catalyst takes for larger than the pairs, all of one section
    pairs = spark.range(300).select(F.col("id").alias("host"), F.lit("all").alias("section"))
    kinds = spark.range(20_000).select((F.col("id") % 5).cast("string").alias("target")).distinct()
    rules = kinds.select(
        F.concat(F.lit("rule "), "target").alias("rule_id"), F.lit("all").alias("section"), F.lit("kind").alias("kind"),
        "target", F.lit(None).cast("string").alias("pattern"), F.lit("").alias("message"),
    )
    inventory = spark.range(3000).select((F.col("id") % 300).alias("host"), F.lit("kind").alias("kind"), (F.col("id") % 7).cast("string").alias("name"))
    needs = kinds.filter("target > '0'").select(F.concat(F.lit("rule "), "target").alias("rule_id"), F.concat(F.lit("rule "), (F.col("target").cast("int") - 1).cast("string")).alias("requires"))
    for sent in (100_000, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr("plumbspark.operators.rules.SENT_RULES", sent, raising=False)
            results = check_rules(pairs, rules, inventory, prerequisites=needs)
            if sent:
                plan = results._jdf.queryExecution().executedPlan().toString()
                assert "BuildRight" in plan and "BuildLeft" not in plan
            got = {(r.host, r.rule_id): r.status for r in results.collect()}
        expected = {}
        for host in range(300):
            names = {str(i % 7) for i in range(host, 3000, 300)}
            for k in range(5):
                expected[host, f"rule {k}"] = "pass" if str(k) in names else "fail"
                if str(k) not in names:
                    break
        assert got == expected
