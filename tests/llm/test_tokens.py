import pickle
import random
import sys
import time
import tracemalloc
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbspark.llm import text
from plumbspark.llm.packing import Schedule, pack_documents
from plumbspark.llm.tokens import WordTokenizer, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def awkward(n, seed=1):
    rng = random.Random(seed)
    letters = "aZ9é#'.,\u0301\u0300 \n\tß中×ʰİͅσΣς\xa0\u200b٣½"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*texts, "it's <|endoftext|> here", "<|startoftext|>", "x \x00\x01 y"]


def test_counts_are_the_library_s(llm, odd, small, library):
    texts = [(i, t) for i, t in enumerate(awkward(400))]
    docs = llm.createDataFrame(texts, "doc_id long, text string").unionByName(small.select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    expected = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    got = count_tokens(docs, PATH, limit=100).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_counts_of_nothing(empty):
    assert count_tokens(empty, PATH).count() == 0


@pytest.mark.parametrize("targets", [None, {"src0": 0.5, "src1": 0.3, "src7": 0.002}, {"src0": 0.6, "src3": 0.4}])
def test_packing_round_trip(llm, small, odd, library, targets):
    docs = small.unionByName(odd.select(small.columns).where("doc_id > 3").withColumn("doc_id", F.col("doc_id") + 10**6).dropDuplicates(["doc_id"]).withColumn("source", F.lit(None).cast("string")))
    pieces = pack_documents(docs, PATH, targets=targets, bucket_tokens=9000).collect()
    ids, places = defaultdict(list), defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(ids[p.doc_id]) and p.length == len(p.ids) // 4 > 0
        ids[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    for r in docs.collect():
        assert ids[r.doc_id] == [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert places[p.sequence_id] == p.offset
        places[p.sequence_id] += p.length
    assert sorted(places) == list(range(len(places)))
    assert all(n == 4096 for s, n in places.items() if s != len(places) - 1)
    if targets:
        share = defaultdict(int)
        for p in pieces:
            if p.sequence_id == 0:
                share[p.source] += p.length
        assert all(abs(share[s] - 4096 * t) < 1 for s, t in targets.items())


def test_packing_edges(llm, empty):
    assert pack_documents(empty, PATH).count() == 0
    same = llm.createDataFrame([(1, None, None), (1, "", "a"), (None, "b", "a"), (1, "", "a")], "doc_id long, text string, source string")
    got = pack_documents(same, PATH).collect()
    assert sorted(p.length for p in got) == [1, 1, 1, 2]
    assert {p.sequence_id for p in got} == {0}
    with pytest.raises(ValueError):
        pack_documents(same, PATH, targets={"a": 0.9, "b": 0.2})


def test_schedule_is_never_a_token_away_from_what_is_owed():
    rng = random.Random(3)
    for _ in range(30):
        totals = [rng.randint(50, 4000) for _ in range(rng.randint(1, 9))]
        shares = [Fraction(rng.randint(1, 9), 40) for _ in totals]
        schedule = Schedule(totals, shares, 128)
        taken = [[schedule.served(q + 1, w) - schedule.served(q, w) for q in range(len(totals))] for w in range(schedule.sequences + 1)]
        assert taken[-1] == totals
        for before, after in zip(taken, taken[1:], strict=False):
            assert all(a <= b for a, b in zip(before, after, strict=True))
        assert all(sum(x) == min(128 * w, sum(totals)) for w, x in enumerate(taken))


def test_packing_keeps_large_and_missing_ids(llm):
    big = 2**53
    rows = [(big + 1, "one two three", "s"), (big, "four", "s"), (None, "five six", "s"), (None, None, None), (big + 3, "seven " * 50, "t")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string")
    done = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=16, bucket_tokens=5).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in done if r.start == 0) == expected
    assert sum(r.length for r in done) == sum(n for _, n in expected)
    with pytest.raises(ValueError, match="whole numbers"):
        pack_documents(docs.withColumn("doc_id", docs.doc_id.cast("string")), public_tokenizers.path("word_bpe_49k.json"))


def test_other_tokenizers_are_refused(llm, small):
    other = public_tokenizers.path("byte_bpe_50k.json")
    with pytest.raises(ValueError, match="another way"):
        count_tokens(small, other)
    with pytest.raises(ValueError, match="another way"):
        pack_documents(small, other)


def test_schedule_of_many_queues():
    rng = random.Random(4)
    totals = [rng.randint(1, 10**9) for _ in range(4096)]
    shares = [Fraction(rng.randint(1, 999), 4096 * 1000) for _ in totals]
    began = time.perf_counter()
    schedule = Schedule(totals, shares, 4096)
    queue = 2000
    first, before, within = schedule.cuts(queue, 10**6, 10**6 + 1000)
    assert time.perf_counter() - began < 5
    assert len(pickle.dumps(schedule)) < 1 << 20
    assert schedule.served(4096, schedule.sequences) == sum(totals)
    assert before[0] <= 10**6 < before[1] and before[-1] >= 10**6 + 1000
    for sequence in (0, 1, 1000, schedule.sequences // 2):
        taken = [schedule.served(q, sequence) for q in range(0, 4097, 512)]
        assert taken == sorted(taken) and taken[-1] == sequence * 4096


def _traced_peak(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashing_runs_takes_memory_by_the_piece():
    rng = np.random.default_rng(4)
    data = np.where(rng.random(4 << 20) < 0.1, 0x20, rng.integers(0x61, 0x7B, 4 << 20)).astype(np.uint8)
    data[1 << 20 : (1 << 20) + 700_000] = 0x78  # longer than a piece
    texts = text.Texts(data, np.array([0, 1000, 1000, 3 << 20, 4 << 20]))
    found = text.words(texts)
    text._powers.clear()
    hashes, peak = _traced_peak(lambda: text.run_hashes(data, found))
    # eight bytes a run, and those of the long word; 32 MB an array before
    assert peak < 8 * len(found.start) + 48 * 700_000
    # the powers that stay
    assert sum(x.nbytes for x in text._powers.values()) < 8 << 20
    # a run's hash is that of its bytes alone, wherever pieces begin
    for i in [0, 1, len(found.start) // 2, len(found.start) - 1, int(np.argmax(found.end - found.start))]:
        word = data[found.start[i] : found.end[i]]
        alone = text.run_hashes(word, text.words(text.Texts(word, np.array([0, len(word)]))))
        assert alone.tolist() == [hashes[i]]


def test_remembered_ids_take_little_memory(library):
    tokenizer = WordTokenizer(PATH)
    words = [f"q{x:x}z".translate(str.maketrans("0123456789", "ghijklmnop")).encode() for x in range(10_000, 30_000)]
    ids = tokenizer.pieces(words)
    assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in ids[:50]] == [library.encode(x.decode(), add_special_tokens=False).ids for x in words[:50]]
    assert tokenizer.pieces(words[:50]) == ids[:50]
    assert max(map(sys.getsizeof, ids)) < 80
    assert all(isinstance(x, bytes) for x in tokenizer.known.values())
    flat, lengths = text.gather(ids[:3], np.array([2, 0, 2]), np.uint32)
    assert flat.tolist() == [x for i in (2, 0, 2) for x in np.frombuffer(ids[i], dtype=np.uint32).tolist()]
    assert lengths.tolist() == [len(ids[i]) // 4 for i in (2, 0, 2)]
    flat, lengths = text.gather([], np.zeros(0, dtype=np.int64), np.uint32)
    assert len(flat) == len(lengths) == 0
