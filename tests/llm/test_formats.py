"""Formats of personal data: where they begin and end, written out by hand."""

import re
from ipaddress import IPv4Address, IPv6Address

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbspark.llm.pii import Feistel, pseudonymize, pseudonyms
from plumbspark.llm.toxicity import Lexicon, ToxicityModel, score_toxicity

FEISTEL = Feistel(b"a key")

#: Texts with the values in brackets, and their kinds.
FOUND = [
    ("mail [müller@example.com] now", ["email"]),
    ("é[a.b+c@sub.exämple.org]", None),
    ("[ÀÉ.ñandú@correo.es], [李雷@例子.com]", ["email", "email"]),
    ("at [2021-03-04]T10:00:00Z or [2021-03-04]T1000", ["date", "date"]),
    ("on [04.03.2021] and [2021/3/4].", ["date", "date"]),
    ("IBAN [DE89 3704 0044 0532 0130 00], or [DE89370400440532013000]", ["iban", "iban"]),
    ("[GB29 NWBK 6016 1331 9268 19] ok", ["iban"]),
    ("call [030 1234567] or [555 123 4567] or [(030) 1234-5678]", ["phone", "phone", "phone"]),
    ("[+49 30 1234567] and [(555) 123-4567]", ["phone", "phone"]),
    ("host [2001:db8::8a2e:370:7334] and [10.1.2.3]", ["ip6", "ip"]),
    ("[2001:0db8:0000:0000:0000:8a2e:0370:7334].", ["ip6"]),
    ("card [4111 1111 1111 1111]", ["card"]),
]

#: Nothing of these is personal data in one of the formats.
CLEAN = [
    "DE88 3704 0044 0532 0130 00", "at 10:20:30", "std::vector a::b ::1 ::", "1 555 123 4567 8", "2021-13-04T10:00", "x2021-03-04", "é2021-03-04", "1.2.3.4.5",
    "300.1.2.3", "naïve@", "@example.com", "pages 012 345", "12:34:56:78", "ABCD 1234 EFGH", "",
]


@pytest.mark.parametrize(("marked", "kinds"), FOUND)
def test_values_begin_and_end_where_they_should(marked, kinds):
    text = marked.replace("[", "").replace("]", "")
    spans, shift = [], 0
    for m in re.finditer(r"\[([^]]*)\]", marked):
        spans.append((m.start() - shift, m.end() - shift - 2))
        shift += 2
    new, found = pseudonyms(text, FEISTEL)
    if kinds is None:
        # the local part of an address takes the letter before it as well
        assert found == [("email", 0, len(text))]
        return
    assert found == [(k, a, b) for k, (a, b) in zip(kinds, spans, strict=True)]
    rest = re.split(r"\[[^]]*\]", marked)
    values = re.fullmatch("(.*)".join(map(re.escape, rest)), new, re.S).groups()
    for kind, old, value in zip(kinds, re.findall(r"\[([^]]*)\]", marked), values, strict=True):
        assert value != old
        if kind == "ip6":
            assert str(IPv6Address(value)) == value
        elif kind == "ip":
            assert str(IPv4Address(value)) == value
        else:
            shape = lambda x: [(c.isupper(), c.islower(), c in "0123456789") if c.isalnum() else c for c in x]
            assert shape(value) == shape(old)


@pytest.mark.parametrize("text", CLEAN)
def test_what_only_looks_like_it_stays(text):
    assert pseudonyms(text, FEISTEL) == (text, [])


def test_one_value_in_several_spellings_stays_one():
    spaced, _ = pseudonyms("DE89 3704 0044 0532 0130 00", FEISTEL)
    plain, _ = pseudonyms("DE89370400440532013000", FEISTEL)
    assert spaced.replace(" ", "") == plain
    long, _ = pseudonyms("2001:0db8:0:0:0:8a2e:0370:7334", FEISTEL)
    short, _ = pseudonyms("2001:db8::8a2e:370:7334", FEISTEL)
    assert long == short
    low, _ = pseudonyms("bob.smith@example.com", FEISTEL)
    mixed, _ = pseudonyms("Bob.SMITH@example.com", FEISTEL)
    assert low == mixed.lower() and low != mixed
    stamp, _ = pseudonyms("2021-03-04T10:00:00Z", FEISTEL)
    day, _ = pseudonyms("2021-03-04", FEISTEL)
    assert stamp == day + "T10:00:00Z"


def test_columns_of_any_name_and_type(llm):
    docs = llm.createDataFrame([(1, "a@b.com"), (2, None)], "doc_id long, text string")
    docs = docs.withColumns({"s": F.struct(F.lit(1).alias("a b")), "odd`name.x": F.lit("k"), "m": F.create_map(F.lit("k"), F.lit(1))})
    done = pseudonymize(docs, b"key")
    assert done.columns == [*docs.columns, "pii"] and done.schema["s"].dataType == docs.schema["s"].dataType
    assert [(r.doc_id, r.s[0], r[3], r.m) for r in done.orderBy("doc_id").collect()] == [(1, 1, "k", {"k": 1}), (2, 1, "k", {"k": 1})]
    model = ToxicityModel(Lexicon({"bad": 1.0}), np.zeros(6))
    scored = score_toxicity(docs, model)
    assert scored.columns == [*docs.columns, "score", "hits"] and scored.count() == 2
