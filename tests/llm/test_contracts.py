"""The registered queries' columns, by brute force over the small tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute_simhash, brute_windows
from test_models import brute_secrets
from test_search import brute_contamination, brute_quality
from tokenizers import Tokenizer

from plumbspark.llm.pii import Feistel, pseudonyms
from plumbspark.llm.queries import PII_KEY, QUERIES
from plumbspark.llm.secret_scan import KINDS

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(small):
    return [(r.doc_id, r.text) for r in small.collect()]


def result(llm, name, *columns):
    done = next(q for n, q in QUERIES.items() if n.startswith(f"{name}_"))(llm, FOLDER)
    return sorted(map(tuple, done.select(*columns).collect()))


def test_op1(llm, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts}
    ends = Counter()
    for doc, start, length, crc, n, _, _ in result(llm, "op1", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        assert start == ends[doc] and n == len(ids[doc])
        assert crc == zlib.crc32(np.array(ids[doc][start : start + length], dtype="<u4").tobytes())
        ends[doc] += length
    assert ends == {i: len(x) for i, x in ids.items()}


def test_op2(llm, texts):
    got = {r[0]: r[1:] for r in result(llm, "op2", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for doc, text in texts:
        base = brute_secrets(text)
        shown = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert got[doc][:3] == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert got[doc][3] == sha(",".join(shown))
        assert [x for x in got[doc][4].split(",") if x and not x.startswith("model")] == shown


def test_op4(llm, texts):
    got = result(llm, "op4", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = [(i, *(x := brute_quality(t)), x[0] < 50 or 100 * x[4] > 50 * x[0]) for i, t in texts]
    assert got == sorted(expected)


def test_op5(llm, texts):
    feistel = Feistel(PII_KEY)
    expected = sorted((i, *((lambda x: (x[0], len(x[1])))(pseudonyms(t, feistel)))) for i, t in texts)
    assert result(llm, "op5", "doc_id", "text", "n_pii") == expected
    assert sum(n for _, _, n in expected)


def test_op6(llm, texts):
    for doc, out, score, predicted in result(llm, "op6", "doc_id", "held_out", "score", "predicted"):
        assert out == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == (score >= 0.5)


def test_op8(llm, texts):
    assert result(llm, "op8", "doc_id", "fingerprint", "component_id") == sorted(brute_simhash(texts))


def test_op9(llm, texts):
    bench = [(r.item_id, r.text) for r in llm.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = [(i, n, h, len(x), sha(",".join(x)), h > 0) for i, n, h, x in brute_contamination(texts, bench)]
    assert result(llm, "op9", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(expected)


def test_op10(llm, texts):
    expected = sorted((i, n, r, sha(kept)) for i, n, r, kept in brute_windows(texts))
    assert result(llm, "op10", "doc_id", "n_words", "n_removed", "kept_sha256") == expected
