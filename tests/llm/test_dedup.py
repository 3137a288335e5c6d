from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest_helpers import WORD, low
from pyspark.sql import functions as F

from plumbspark.llm.components import component_roots
from plumbspark.llm.simhash import keep_first_of_group, near_copies, simhash_components
from plumbspark.llm.windows import drop_repeated_windows, sent_rows


def brute_windows(rows, width=13):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, t in order:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes", [6 << 20, 20_000])
def test_windows(llm, small, odd, part_bytes):
    docs = small.select("doc_id", "text").unionByName(odd.select("doc_id", "text").selectExpr("doc_id + 100000 AS doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = drop_repeated_windows(docs, part_bytes=part_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_windows(rows)
    assert all(sum(e - s for s, e in r.removed) == r.n_removed for r in got)


@pytest.mark.parametrize("ranges", [2048, 5, 1])
def test_ranges_of_buckets_change_nothing(llm, small, odd, monkeypatch, ranges):
    from plumbspark.llm import windows

    monkeypatch.setattr(windows, "RANGES", ranges)
    docs = llm.createDataFrame(small.select("doc_id", "text").limit(60).collect(), "doc_id long, text string")
    docs = docs.unionByName(docs.selectExpr("doc_id + 5000", "text").toDF("doc_id", "text")).unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = drop_repeated_windows(docs, part_bytes=10_000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_windows(rows)


def test_rows_that_a_part_sends_are_bounded():
    rng = np.random.default_rng(9)
    value = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    rank = np.arange(len(value))
    parts = 10_000
    each = sent_rows(3, value, rank, parts, 1)
    assert len(each) > 3000 and each["to"].max() < parts
    ranged = sent_rows(3, value, rank, parts, -(-parts // 64))
    assert len(ranged) <= 64 and set(ranged["part"]) == {3}
    assert sum(map(len, ranged["hashes"])) == 8 * len(value)


def test_windows_of_clashing_columns_and_nothing(odd, empty):
    assert drop_repeated_windows(odd).count() == odd.count()
    assert drop_repeated_windows(empty).count() == 0


def brute_simhash(rows, width=4, limit=4):
    prints = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        shingles = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    values = np.array(prints, dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= limit):
            a, b = find(k), find(k + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, f"{prints[k]:016x}", min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows)), key=repr)


def test_simhash(llm, small, odd):
    docs = small.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash_components(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == brute_simhash(rows)


def test_simhash_edges(odd, empty):
    assert simhash_components(odd).count() == odd.count()
    assert simhash_components(empty).count() == 0
    assert near_copies(empty).count() == 0


def test_components_of_a_long_chain(llm):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000), (2000, 2001), (2001, 2000)]
    roots = {r.node: r.root for r in component_roots(llm.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 2000: 2000, 2001: 2000}


def test_stars_need_no_round_and_rounds_deal_edges_out_once(llm, monkeypatch):
    from plumbspark.llm import components

    written, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(real(df)) or written[-1])
    star = [(0, i) for i in range(1, 30)] + [(100, 101)] * 3
    got = sorted(map(tuple, component_roots(llm.createDataFrame(star, "a long, b long")).collect()))
    assert got == [(i, 0) for i in range(30)] + [(100, 100), (101, 100)]
    assert len(written) == 1
    # a round's tasks: no exchange is read from two copies of the edges
    context = llm.sparkContext
    chain = llm.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    written.clear()
    monkeypatch.setattr(components, "cut", lambda df: written.append(real(df.repartition(40))) or written[-1])
    context.setJobGroup("components", "")
    try:
        roots = component_roots(chain).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {x for job in tracker.getJobIdsForGroup("components") for x in tracker.getJobInfo(job).stageIds}
    most = max(info.numTasks for info in map(tracker.getStageInfo, stages) if info)
    assert {tuple(r) for r in roots} == {(i, 0) for i in range(10)} and len(written) > 1 and most == 40


def test_links_lead_to_the_smallest_of_a_key():
    import pandas as pd

    from plumbspark.llm.simhash import _links, alike

    sets = [np.arange(k, k + 30, dtype=np.uint64).tobytes() for k in (9, 0, 3, 6)]
    chain = alike(pd.DataFrame({"node": [9, 5, 3, 6], "shingles": sets}), 0.8)
    # one step away each: 5 - 3 - 6 - 9
    assert sorted(map(tuple, chain.to_numpy().tolist())) == [(3, 5), (3, 6), (3, 9)]
    rows = pd.DataFrame({"node": [1, 2, 3, 4], "fp": [0b0, 0b1, 0b11, 0b111], "choice": 0, "bits": 0, "row_tile": 0, "column_tile": 0})
    near = pd.concat(_links(iter([rows]), 1, 0))
    assert sorted(map(tuple, near.to_numpy().tolist())) == [(1, 2), (1, 3), (1, 4)]


def test_tiles_lose_no_link(llm, monkeypatch):
    from plumbspark.llm import simhash

    rows = [(i, f"{'word ' * 60}{i % 7}") for i in range(40)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, simhash_components(docs).collect()))
    monkeypatch.setattr(simhash, "TILE", 2)
    assert sorted(map(tuple, simhash_components(docs).collect())) == whole == sorted(brute_simhash(rows))


def test_one_of_each_group_stays(llm):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(30)]
    near = []
    for t in texts[:10]:
        w = t.split()
        w[50], w[120] = "changed", "altered"
        near.append(" ".join(w))
    rows = [*enumerate(texts), *[(100 + i, t.upper()) for i, t in enumerate(texts[:10])], *[(200 + i, t) for i, t in enumerate(near)], (5, texts[5]), (None, texts[6]), (300, ""), (301, None)]
    docs = llm.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept_id string")
    kept = keep_first_of_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*range(30), 300, None], key=repr)


def shingles(text, width=5):
    w = WORD.findall(low(text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def brute_copies(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    same = [" ".join(WORD.findall(low(t or ""))) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            if same[i] == same[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, rows[find(k)][0]) for k, (i, _) in enumerate(rows))


def texts_of_similarity():
    """Pairs at 0.70, 0.76, 0.796, 0.81 and 0.86, and a family made from one template, mostly 0.7 to 0.8 alike."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 8))

    def edited(base, at):
        return [word() if k in at else x for k, x in enumerate(base)]

    rows = []
    for edits in [14, 11, 9, 8, 6] * 4:
        base = [word() for _ in range(400)]
        # every edit changes five shingles of 396 on both sides
        rows += [" ".join(base), " ".join(edited(base, {20 + 9 * k for k in range(edits)}))]
    template = [word() for _ in range(400)]
    rows += [" ".join(edited(template, set(rng.choice(400, 7, replace=False).tolist()))) for _ in range(50)]
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [1 << 20, 4000])
def test_only_texts_alike_are_copies(llm, monkeypatch, tile):
    from plumbspark.llm import simhash

    rows = texts_of_similarity()
    monkeypatch.setattr(simhash, "TILE_SHINGLES", tile, raising=False)
    got = {r.doc_id: r.component_id for r in near_copies(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    brute = dict(brute_copies(rows))
    assert len({c for i, c in brute.items() if i >= 40}) > 40
    assert [i for i, c in got.items() if c != i and brute[i] != c] == []


def test_no_copy_is_missed(llm):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 8))
    rows = []
    for length, edits in [(9, 0), (14, 1), (30, 1), (50, 1), (90, 1), (90, 2), (200, 4), (400, 8), (900, 19)] * 6:
        base = [word() for _ in range(length)]
        # scattered edits, and one run of words exchanged at the end
        other = [word() if k % 9 == 4 and k // 9 < edits else x for k, x in enumerate(base)]
        run = max(1, (length - 4) // 9 - 1)
        rows += [" ".join(base), " ".join(other), " ".join(base[:-run] + [word() for _ in range(run)]), " ".join(base[:-1])]
    rows += ["a b c d", "A  b c d", "a b c", "", None]
    got = near_copies(llm.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    brute = brute_copies(list(enumerate(rows)))
    assert sum(i != c for i, c in brute) > 120
    assert sorted(map(tuple, got)) == brute


BIG = 2**53


def test_windows_of_large_and_missing_ids(llm):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(BIG + 1, text), (BIG, text), (None, text), (None, text + " more"), (BIG + 3, "x " * 20), (BIG + 2, "y " * 20)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    for part_bytes in (6 << 20, 10):
        got = drop_repeated_windows(docs, part_bytes=part_bytes).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_windows(rows)


def test_ids_that_are_no_numbers_are_refused(llm):
    docs = llm.createDataFrame([("a", "x")], "doc_id string, text string")
    for operator in (drop_repeated_windows, simhash_components, near_copies, keep_first_of_group):
        with pytest.raises(ValueError, match="whole numbers"):
            operator(docs)


def test_a_third_without_an_id_is_dealt_over_parts(llm):
    rows = [(None if i % 3 == 0 else BIG + i, " ".join(f"w{i % 11} {k}" for k in range(20))) for i in range(300)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = drop_repeated_windows(docs, part_bytes=2000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_windows(rows)


def test_different_texts_under_one_id_stay(llm):
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 8)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a + " end", "x"), (3, c, "y"), (3, c + " end", "z"), (BIG + 1, "q", "x"), (BIG, "r", "x"), (None, a, "x")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, `a b` string").withColumn("s", F.struct(F.lit(1).alias("a b")))
    for left_out in (1e-6, 0):
        kept = keep_first_of_group(docs, left_out=left_out)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
        assert len(got) == 6 and [x for x in got if x[0] not in (3,)] == sorted([(1, a), (1, b), (BIG + 1, "q"), (BIG, "r"), (None, a)], key=repr)
        again = keep_first_of_group(docs.orderBy(F.rand(5)).repartition(3), left_out=left_out).collect()
        assert sorted(((r.doc_id, r.text) for r in again), key=repr) == got


def test_without_sketches_the_copies_are_the_same(llm):
    rows = texts_of_similarity()
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_copies(docs, left_out=0).collect())) == brute_copies(rows)


def test_simhash_links_near_copies(llm, monkeypatch):
    from plumbspark.llm import simhash

    rng = np.random.default_rng(12)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 8)) for _ in range(n))
    rows = [(i, text(400)) for i in range(12)]
    rows += [(100 + i, f"{t} and more") for i, t in rows]
    # one line repeated makes their fingerprints equal or nearly so, but not their sets of shingles
    lines = "one two three four five " * 300
    rows += [(200 + i, lines + text(30)) for i in range(4)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    bits = {r.doc_id: int(r.fingerprint, 16) for r in simhash_components(docs, width=5).collect()}
    close = [i for i in range(12) if (bits[i] ^ bits[100 + i]).bit_count() <= 4]
    assert len(close) > 9 and all((bits[200] ^ bits[200 + i]).bit_count() <= 4 for i in range(4))
    real = simhash._key_links
    # without the keys of prefixes SimHash is left to find copies
    monkeypatch.setattr(simhash, "_key_links", lambda keyed, **given: real(keyed, **given).where(F.lit("sketches" not in given)))
    kept = {r.doc_id for r in keep_first_of_group(docs).collect()}
    assert kept == {i for i, _ in rows} - {100 + i for i in close}
    monkeypatch.undo()
    assert {r.doc_id for r in keep_first_of_group(docs).collect()} == {i for i, _ in rows if not 100 <= i < 200}
