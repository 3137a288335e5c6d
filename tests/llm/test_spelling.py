import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_helpers import low
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbspark.llm import spelling
from plumbspark.llm.spelling import followed_by, group_spellings, near_words, single_edits

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, least=7, times=2):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= times}


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``, tried one by one."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(counts):
    by_size = defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    near = {a: [b for n in (len(a) - 1, len(a), len(a) + 1) for b in by_size[n] if one_edit(a, b)] for a in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def variants():
    """Words with all their edits, in several sizes of counts, so that forms follow each other."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghiéÿ")
    words = ["".join(rng.choice(letters, n)) for n in (7, 8, 9, 12, 20)]
    rows, doc = [], 0
    for w in words:
        chain = [w, w[:3] + "z" + w[3:], w[:3] + "zz" + w[3:], w[:-1], w[1:] + "q"]
        for times, x in zip((3000, 250, 20, 2, 30), chain):
            rows.append((doc, f"{x} " * times))
            doc += 1
    return rows


def as_rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("tile", [4096, 3])
def test_words_as_by_brute_force(llm, small, odd, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    made = llm.createDataFrame(variants(), "doc_id long, text string")
    rows = variants() + [(r.doc_id, r.text) for r in odd.collect()]
    docs = made.unionByName(odd.select("doc_id", "text"))
    if tile > 3:
        rows += [(r.doc_id, r.text) for r in small.limit(60).collect()]
        docs = docs.unionByName(llm.createDataFrame(small.limit(60).select("doc_id", "text").collect(), "doc_id long, text string"))
    expected = brute_groups(brute_counts(rows))
    assert any(r[1] is not None and r[1] != r[2] for r in expected)
    assert as_rows(group_spellings(docs.withColumn("word", F.lit(1)).withColumn("n", F.lit("x")))) == expected


@pytest.mark.parametrize("tile", [4096, 8])
def test_words_with_one_beginning(llm, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(6)
    words = {"hotkey" + "".join(rng.choice(list("abc"), n)) for n in (1, 2, 3, 4, 5, 6) for _ in range(40)}
    counts = {w: int(rng.integers(2, 400)) for w in words}
    got = near_words(llm.createDataFrame(list(counts.items()), "word string, n long")).collect()
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    best = {a: min(x, key=lambda b: (-counts[b], b)) for a, x in near.items() if x}
    assert {r.word: (r.n_near, r.best, r.best_n) for r in got} == {a: (len(near[a]), b, counts[b]) for a, b in best.items()}


def test_no_words(empty, odd):
    assert group_spellings(empty).count() == 0
    assert group_spellings(odd.selectExpr("cast(doc_id AS string) AS doc_id", "cast(NULL AS string) AS text")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab:1é", max_size=6), st.integers(0, 300).map(lambda n: "xyé" * n)), min_size=1, max_size=6))
def test_checksums_of_joined_bytes(pairs):
    parts = sorted({b.encode() for _, b in pairs})
    before = np.array([zlib.crc32(a.encode()) for a, _ in pairs], dtype=np.uint32)
    code = np.array([parts.index(b.encode()) for _, b in pairs])
    got = followed_by(before, np.arange(len(pairs)), parts, code)
    assert got.tolist() == [zlib.crc32((a + b).encode()) for a, b in pairs]


@settings(max_examples=300, deadline=None)
@given(st.text("abÿ", min_size=5, max_size=7), st.text("abÿ", min_size=5, max_size=7))
def test_prefix_and_suffix_find_single_edits(a, b):
    longest = max(len(a), len(b))
    if a == b or abs(len(a) - len(b)) > 1:
        return
    near, _ = single_edits([a, b], longest, np.array([0]), np.array([1]))
    assert near[0] == one_edit(a, b)
