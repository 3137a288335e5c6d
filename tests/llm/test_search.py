import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from conftest_helpers import WORD, low

from plumbspark.llm.contamination import find_contamination
from plumbspark.llm.quality import RULES, Rule, first_failure, ordered_rules, quality_cascade, text_statistics
from plumbspark.llm.urls import judge_urls, url_rules

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contamination(rows, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = TERM.findall(low(t or ""))
        for k in range(max(1, len(w) - width + 1) if w and i is not None else 0):
            windows[tuple(w[k : k + width])].add(str(i))
    out = []
    for i, t in rows:
        w, found = TERM.findall(low(t or "")), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    found |= names
                    hit[k : k + n] = [1] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "one"), (2, "two Three"), (3, None), (4, "..."), (None, "never"), (10, "Beta gamma delta epsilon zeta eta theta iota kappa LAMBDA mu")]
TEXTS = [(1, "Alpha, beta gamma delta epsilon zeta eta theta iota kappa; lambda mu"), (2, "two three two three ONE"), (3, None), (4, ""), (5, "never mind"), (5, "never mind"), (None, "one"), (6, "x " * 30_000 + "two\nthree"), (7, "beta gamma delta epsilon zeta eta theta iota kappa")]


@pytest.mark.parametrize("block_windows", [100_000, 1])
def test_contamination(llm, block_windows):
    docs = llm.createDataFrame([(i, t, "mine", 9) for i, t in TEXTS], "doc_id long, text string, items string, n_hit int")
    bench = llm.createDataFrame(ITEMS, "item_id long, text string")
    got = find_contamination(docs, bench, block_windows=block_windows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute_contamination(TEXTS, ITEMS)
    assert all(sum(h.end - h.start for h in r.hits) == r.n_hit for r in got)
    kept = find_contamination(docs, bench, keep_columns=True)
    assert kept.columns == ["doc_id", "text", "n_words", "n_hit", "items", "hits"]


def test_many_blocks_are_one_pass(llm):
    """Fifty blocks: the worker of a task loads one after the other and keeps none."""
    docs = llm.createDataFrame([(i, f"x w{i} y{i} z") for i in range(60)], "doc_id long, text string")
    bench = llm.createDataFrame([(i, f"w{i} y{i}") for i in range(0, 50)], "item_id long, text string")
    found = find_contamination(docs, bench, block_windows=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert {r.doc_id: r["items"] for r in found.collect()} == {i: [str(i)] if i < 50 else [] for i in range(60)}


def test_contamination_of_the_tables(llm, small):
    bench = llm.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute_contamination([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = find_contamination(small, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == expected


def test_contamination_of_nothing(llm, odd, empty):
    bench = llm.createDataFrame(ITEMS, "item_id long, text string")
    assert find_contamination(empty, bench).count() == 0
    assert [r.n_hit for r in find_contamination(odd, bench.limit(0)).collect()] == [0] * odd.count()


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def test_quality(llm, small, odd):
    docs = small.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    got = quality_cascade(docs).collect()
    assert len(got) == len(rows)
    expected = sorted(((r.doc_id, *brute_quality(r.text)) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed_rule is None) and not (r.base_failed and r.kept)


def brute_rules(text):
    """The rules beside the base ones that a text fails, each counted in plain Python."""
    text = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, _ = brute_quality(text)
    words = WORD.findall(text)
    n_lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    ended = re.split("\r\n|[\n\r\u0085\u2028\u2029]", text)
    fails = {
        "word_length": not 2 * n_words <= word_chars <= 15 * n_words,
        "symbols": 10 * n_symbols > n_words,
        "repeated_lines": n_dup_lines >= 3 and 2 * n_dup_lines >= n_lines,
        "few_letters": 2 * sum(unicodedata.category(c)[0] == "L" for c in text) < word_chars,
        "few_distinct_words": n_words >= 200 and 20 * len(set(words)) < n_words,
        "bullets": n_lines >= 10 and 10 * sum(x.lstrip(" \t")[:1] in ("-", "*", "•") for x in ended) > 9 * n_lines,
        "ellipses": n_lines >= 10 and 10 * sum(x.rstrip(" \t").endswith(("...", "…")) for x in ended) > 5 * n_lines,
    }
    return {name for name, failed in fails.items() if failed}


ODD_QUALITY = [
    "a b c " * 40, "internationalisations " * 60, "word # word * " * 60, "one line here\n" * 30 + "and more words " * 40, "1234 5678 90 " * 60,
    "same few words again " * 70, "".join(f"- item number {i} of many\n" for i in range(40)), "".join(f"sentence number {i} goes on...\n" for i in range(40)),
    "".join(f"\t• item {i} and {i + 1}\r\n" for i in range(40)), "".join(f"words {i} trail off… \n" for i in range(40)), "слово за словом идёт дальше " * 3 + " ".join(f"слово{i}" for i in range(80)),
    " ".join(f"word{i}" for i in range(90)), "...\n" * 60 + " ".join(f"w{i}" for i in range(60)),
]


def test_kept_as_by_plain_python(llm, small):
    rows = [(i, t) for i, t in enumerate(ODD_QUALITY)] + [(1000 + r.doc_id, r.text) for r in small.collect()]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.failed_rule) for r in quality_cascade(docs).collect()}
    seen = set()
    for i, text in rows:
        n_words, *_, n_repeat = brute_quality(text)
        base, failed = n_words < 50 or 100 * n_repeat > 50 * n_words, brute_rules(text)
        assert got[i][0] == (not base and not failed), (text[:60], failed, got[i])
        assert got[i][1] in ({"base"} if base else failed or {None})
        seen |= failed
    assert seen == {r.name for r in RULES}


def test_a_rule_made_slow_moves_back(llm, small):
    statistics = text_statistics(small)
    fast = Rule("fast", "10 * n_symbols > n_words")
    slow = Rule("slow", r"10 * n_symbols > n_words AND length(regexp_replace(repeat(text, 10), '[^\\p{L}]+', '')) >= 0")
    wrong = Rule("slow", r"length(regexp_replace(repeat(text, 10), '[^\\p{L}]+', '')) >= 0 AND 10 * n_symbols > n_words")
    for rules in ([wrong, fast], [fast, wrong]):
        assert [r.name for r in ordered_rules(statistics, rules)] == ["fast", "slow"]
    assert {r.name for r in ordered_rules(statistics, [slow, fast])} == {"fast", "slow"}


def test_quality_order_changes_no_verdict(llm, small):
    statistics = text_statistics(small)
    order = ordered_rules(statistics)
    assert sorted(r.name for r in order) == sorted(r.name for r in RULES)
    verdicts = [{(r[0], r[1] is None) for r in statistics.select("doc_id", first_failure(x)).collect()} for x in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]


def test_quality_is_native(llm, small, empty, odd):
    plan = quality_cascade(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality_cascade(empty).count() == 0
    assert quality_cascade(odd).count() == odd.count()


RULES_TABLE = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute_url(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[3], max(fit)[4]) if fit else (None, "allow")))


URLS = ["http://A.Example.NET/en/1?x=/de/", "https://net/", "http://x.net", "http://x.net?/", "ftp://w.example.com/de/", "http://example.com/DE/", "x", "", None, "a://b://c.org/fr/", "http://u@x.org/fr/#a", "http://notexample.com/de/", "http://x.net:80/", "//x.net/", "http://x.net\n/a", "http://é.org/fr/é", "http://net./", "http://" + "a." * 500 + "net/" + "b/" * 5000]


def test_urls(llm, empty):
    pages = llm.createDataFrame([(i % 12, u, "html", "mine") for i, u in enumerate([*URLS, *URLS[:2]])], "page_id long, url string, html string, verdict string")
    got = judge_urls(pages, url_rules(llm, RULES_TABLE))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r.page_id, *brute_url(r.url, RULES_TABLE)) for r in pages.collect()), key=repr)
    more = [*RULES_TABLE, ("block", "a.example.net", "/e"), ("allow", "net", "/"), ("block", None, "/"), ("block", "net", "/"), ("block", "com", "")]
    got = judge_urls(pages, url_rules(llm, more))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r.page_id, *brute_url(r.url, [x for x in more if x[1]])) for r in pages.collect()), key=repr)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert judge_urls(pages.limit(0), url_rules(llm, RULES_TABLE)).count() == 0
    assert {r.verdict for r in judge_urls(pages, url_rules(llm, RULES_TABLE).limit(0)).collect()} == {"allow"}
