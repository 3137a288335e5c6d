import math
import re
from collections import Counter

import pytest
from conftest_helpers import low

from plumbspark.llm import lexical
from plumbspark.llm.lexical import rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(rows, items, limit=50):
    bags = [(i, Counter(TERM.findall(low(t or "")))) for i, t in rows]
    bags = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    df = Counter(t for _, bag, _ in bags for t in bag)
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            terms = set(TERM.findall(low(text or ""))) & set(bag)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in terms)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:limit], 1)]
    return sorted(out, key=repr)


def ranks(docs, items, **options):
    return sorted((tuple(r) for r in rank_documents(docs, items, **options).collect()), key=repr)


ITEMS = [(1, "same words here"), (1, "naïve café CAFÉ 中文"), (2, None), (3, ""), (4, "no such thing anywhere 12"), (None, "one two row id"), (5, "end x" + "x" * 60_000)]


@pytest.mark.parametrize("query_terms", [1 << 20, 3])
def test_odd_rows_as_by_brute_force(llm, odd, query_terms):
    items = llm.createDataFrame([(i, t, "mine", 3) for i, t in ITEMS], "item_id long, text string, term string, rank int")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ranks(odd, items, limit=3, query_terms=query_terms)
    assert got == brute_ranks(rows, ITEMS, 3) and got


def test_many_copies_and_ties(llm, monkeypatch):
    monkeypatch.setattr(lexical, "SAMPLE", 2)
    rows = [(k, f"common w{k % 7} w{k % 5} filler{k}") for k in range(400)] + [(1000 + k, "common w1 w1 rare") for k in range(300)] + [(None, "common w1 w1 rare")] * 3
    items = [(k, f"w{k % 7} w{k % 5} common") for k in range(10)] + [(99, "rare")]
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(7)
    asked = llm.createDataFrame(items, "item_id long, text string")
    for limit in (1, 50, 350):
        assert ranks(docs, asked, limit=limit) == brute_ranks(rows, items, limit)


def test_equal_digests_are_told_apart(llm, monkeypatch):
    rows = [(k, f"a{k % 4} b{k % 3}") for k in range(60)]
    items = [(1, "a1 b1"), (2, "a2 b0 a0")]
    monkeypatch.setattr(lexical.F, "md5", lambda column: lexical.F.lit("00" * 16))
    docs, asked = llm.createDataFrame(rows, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string")
    assert ranks(docs, asked, limit=9) == brute_ranks(rows, items, 9)


def test_string_ids_and_nothing(llm, odd, empty):
    docs = llm.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "name string, body string")
    asked = llm.createDataFrame([("q", "x")], "q string, t string")
    got = rank_documents(docs, asked, id_column="name", text_column="body", query_id="q", query_text="t").collect()
    assert [(r.q, r.rank, r.name) for r in sorted(got, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    for docs, asked in ((empty, items), (odd, items.limit(0))):
        none = rank_documents(docs, asked)
        assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
