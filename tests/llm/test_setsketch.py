from collections import defaultdict

import numpy as np
import pytest
from conftest_helpers import WORD, low
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbspark.llm import setsketch
from plumbspark.llm.setsketch import likely_alike, likely_jaccard, minhash_components, registers


def shingle_set(text, width=3):
    w = WORD.findall(low(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def brute_components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, found in enumerate(sets):
        for j in {j for g in found for j in holders[g]}:
            if 100 * len(found & sets[j]) >= percent * len(found | sets[j]):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
        for g in found:
            holders[g].append(k)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    out = [(i, len(sets[k]), min(ids[find(k)], default=None)) for k, (i, _) in enumerate(rows)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=repr)


def texts_around_the_limit():
    """Pairs just above and below the limit, chains, a family from one template, and tiny texts."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    texts = []
    for length, edits in [(8, 1), (20, 1), (41, 1), (42, 1), (100, 2), (100, 3), (300, 7), (300, 8), (300, 9), (900, 20), (900, 30)] * 5:
        base = [word() for _ in range(length)]
        other = list(base)
        for k in rng.choice(np.arange(2, length - 2, 3), min(edits, (length - 4) // 3 + 1), replace=False):
            other[k] = word()
        texts += [" ".join(base), " ".join(other), " ".join(base[: max(1, int(length * 0.86))]), " ".join(base).upper()]
    template = [word() for _ in range(300)]
    for _ in range(60):
        made = list(template)
        for k in rng.choice(300, 5, replace=False):
            made[k] = word()
        texts.append(" ".join(made))
    chain = [word() for _ in range(400)]
    for k in range(12):
        chain = chain[8:] + [word() for _ in range(8)]
        texts.append(" ".join(chain))
    return [(7 * k % 1009, t) for k, t in enumerate([*texts, "one", "One", "one two", "one  two", "one two three", "", None])]


@pytest.mark.parametrize(("tile", "key_nodes"), [(1 << 20, 16_384), (2500, 4)])
def test_components_as_by_brute_force(llm, monkeypatch, tile, key_nodes):
    monkeypatch.setattr(setsketch, "TILE_SHINGLES", tile)
    monkeypatch.setattr(setsketch, "KEY_NODES", key_nodes)
    rows = texts_around_the_limit()
    brute = brute_components(rows)
    assert 60 < sum(not kept for *_, kept in brute) < len(rows) - 60
    got = minhash_components(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute


def test_odd_rows(odd, empty):
    done = minhash_components(odd)
    assert done.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, done.collect()), key=repr) == sorted(((i, n, c, k or (i is None and c is None)) for i, n, c, k in brute_components(rows)), key=repr)
    assert minhash_components(empty).count() == 0


def test_string_and_missing_ids(llm):
    big = 2**53
    rows = [(big + 1, "a b c d"), (big, "A b c d"), (None, "a b c d"), (None, "e f g"), (None, "")]
    got = minhash_components(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(big + 1, 2, big, False), (big, 2, big, True), (None, 2, big, False), (None, 1, None, True), (None, 0, None, True)], key=repr)
    names = minhash_components(llm.createDataFrame([("y", "a b c d"), ("x", "a b c d")], "name string, t string"), id_column="name", text_column="t")
    assert sorted(map(tuple, names.collect())) == [("x", 2, "x", True), ("y", 2, "x", False)]


def two_sets(rng, size, jaccard):
    common = round(2 * size * jaccard / (1 + jaccard))
    value = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
    return np.sort(value[:size]), np.sort(value[size - common :])


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    for size in (30, 3000):
        for wanted in (0.3, 0.6, 0.9):
            close = []
            for _ in range(20):
                a, b = two_sets(rng, size, wanted)
                both = np.union1d(a, b)
                one, other, union = (registers(x, np.array([0, len(x)]))[0] for x in (a, b, both))
                assert (np.maximum(one, other) == union).all()
                true = len(np.intersect1d(a, b)) / len(both)
                sizes = np.array([len(a)]), np.array([len(b)])
                close.append(likely_jaccard(one[None], other[None], *sizes)[0] - true)
                assert likely_alike(one[None], other[None], *sizes, true)[0]
                assert not likely_alike(one[None], other[None], *sizes, 0.999)[0] or true > 0.7
            assert abs(np.mean(close)) < 0.03 and np.std(close) < 0.06


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.integers(0, 200), st.integers(0, 200))
def test_sign_of_the_slope_is_that_of_the_estimate(common, left, right):
    rng = np.random.default_rng(common * 40_401 + left * 201 + right)
    value = rng.integers(0, 1 << 63, common + left + right, dtype=np.uint64)
    a, b = np.sort(value[: common + left]), np.sort(value[left:])
    one, other = (registers(x, np.array([0, len(x)])) for x in (a, b))
    sizes = np.array([len(a)]), np.array([len(b)])
    least = 0.85 - setsketch.DEVIATIONS * np.sqrt(0.85 * 0.15 / setsketch.REGISTERS)
    if min(len(a), len(b)) >= 0.85 * max(len(a), len(b)):
        estimate = likely_jaccard(one, other, *sizes)[0]
        if abs(estimate - least) > 1e-6:
            assert likely_alike(one, other, *sizes, 0.85)[0] == (estimate > least)
