"""Format-preserving pseudonyms: a keyed Feistel permutation within each value's own format."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from ipaddress import IPv6Address
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbspark.llm.ids import plain_columns
from plumbspark.llm.text import blocks

ROUNDS = 10


class Feistel:
    """Keyed permutations of ``0..size - 1``, one for each ``size`` and ``tweak``.

    Numbers are split into two parts whose ranges multiply to ``size`` or a little more; each
    round adds a keyed hash of one part to the other.  Results beyond ``size`` go through again
    until one lies within (cycle walking), which keeps it a permutation of exactly the range.
    """

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, size: int, i: int, value: int) -> int:
        text = f"{tweak}|{size}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=24).digest(), "big")

    def _once(self, value: int, size: int, tweak: str, turn: int) -> int:
        left_range = isqrt(size - 1) + 1
        right_range = -(-size // left_range)
        left, right = value // right_range, value % right_range
        for i in range(ROUNDS) if turn > 0 else reversed(range(ROUNDS)):
            if i % 2:
                left = (left + turn * self._round(tweak, size, i, right)) % left_range
            else:
                right = (right + turn * self._round(tweak, size, i, left)) % right_range
        return left * right_range + right

    def permute(self, value: int, size: int, tweak: str, allowed: Callable[[int], bool] = lambda _: True, turn: int = 1) -> int:
        """The image of ``value``; with ``allowed``, a permutation of the allowed numbers only."""
        while True:
            value = self._once(value, size, tweak, turn)
            if value < size and allowed(value):
                return value

    def invert(self, value: int, size: int, tweak: str, allowed: Callable[[int], bool] = lambda _: True) -> int:
        return self.permute(value, size, tweak, allowed, -1)


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) * (1 + (i % 2 == 0))
        total += n - 9 * (n > 9)
    return str(-total % 10)


def _fill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if x in "0123456789" else x for x in pattern)


def _digits(text: str) -> str:
    return "".join(x for x in text if x in "0123456789")


def _iban_remainder(text: str) -> int:
    return int("".join(str(int(x, 36)) for x in text[4:] + text[:4])) % 97


# Every kind: the pattern that finds it, a check, and a permutation of its format.  Patterns begin
# only where no character of theirs precedes, so that a long run is read once.  A border is where
# no letter or digit of any language stands.

_BEFORE, _AFTER = r"(?<![^\W_])", r"(?![^\W_])"

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:(?:[^\W_]|-){1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-])")
_IBAN = re.compile(_BEFORE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _AFTER)
_DATE = re.compile(_BEFORE + r"(?<![./-])(?:(?P<y>[0-9]{4})(?P<s>[-/.])(?P<m>[0-9]{1,2})(?P=s)(?P<d>[0-9]{1,2})|(?P<a>[0-9]{1,2})(?P<t>[-/.])(?P<b>[0-9]{1,2})(?P=t)(?P<z>[0-9]{4}))(?:(?=T[0-9]{2}:?[0-9]{2})|" + _AFTER + r"(?![./-][0-9]))")
_IP = re.compile(_BEFORE + r"(?<!\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _AFTER + r"(?!\.[0-9])")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:|[0-9A-Fa-f])){2,7}(?::|[0-9A-Fa-f]{1,4})(?![\w:]|\.[0-9])")
_SSN = re.compile(_BEFORE + r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}" + _AFTER + r"(?!-[0-9])")
_CARD = re.compile(_BEFORE + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})" + _AFTER)
_PHONE = re.compile(
    _BEFORE + r"(?<!\+)(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|(?<![0-9][ .-])(?:[0-9]{3} [0-9]{3} [0-9]{4}|\(?0[0-9]{2,4}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,4}){0,2})(?![ -][0-9]))" + _AFTER + r"(?![.-][0-9])"
)

_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


@lru_cache(maxsize=4096)
def _like(x: str) -> str:
    """The characters that may take the place of ``x``: ASCII digits, ASCII letters of its case, or
    the letters of its kind among its 256 neighbours in the code; empty for signs."""
    if x in "0123456789":
        return "0123456789"
    if x.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if x.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if x.isupper() else ""
    kind = unicodedata.category(x)
    first = ord(x) & ~0xFF
    return "".join(c for c in map(chr, range(max(first, 0x80), first + 0x100)) if unicodedata.category(c) == kind) if kind[0] == "L" else ""


def _email(found: re.Match, feistel: Feistel) -> str | None:
    text = found.group()
    stop = text.rindex(".")
    body, tail = text[:stop], text[stop:]
    # equal but for the case of letters of the ASCII: equal but for the case afterwards
    likes = [_like(x) for x in body]
    value, size = 0, 1
    for x, like in zip(body, likes, strict=True):
        if like:
            value = value * len(like) + like.index(x)
            size *= len(like)
    shape = "".join("9" if like[:1] == "0" else "a" if len(like) == 26 and like.isascii() else like[0] if like else x for x, like in zip(body, likes, strict=True))
    new = feistel.permute(value, size, f"email {shape}") if size > 1 else value
    out = []
    for x, like in zip(reversed(body), reversed(likes), strict=True):
        if like:
            new, n = divmod(new, len(like))
            x = like[n]
        out.append(x)
    return "".join(reversed(out)) + tail


def _iban(found: re.Match, feistel: Feistel) -> str | None:
    text = found.group()
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34 or _iban_remainder(compact) != 1:
        return None
    digits = _digits(compact[4:])
    if not digits:
        # no country has account numbers of letters alone
        return None
    # with or without blanks an account number is the same
    shape = re.sub("[0-9]", "9", compact[4:])
    new = str(feistel.permute(int(digits), 10 ** len(digits), f"iban {text[:2]}{shape}")).zfill(len(digits))
    check = 98 - _iban_remainder(text[:2] + "00" + _fill(compact[4:], new))
    return f"{text[:2]}{check:02d}{_fill(text[4:], new)}"


def _date(found: re.Match, feistel: Feistel) -> str | None:
    x = found.groupdict()

    def day(year: str, month: str, number: str) -> int | None:
        try:
            n = (date(int(year), int(month), int(number)) - _FIRST_DAY).days
        except ValueError:
            return None
        return n if 0 <= n < _DAYS else None

    if x["y"]:
        order, sign, parts = "ymd", x["s"], (x["y"], x["m"], x["d"])
    else:
        # with slashes the month comes first where that is a date
        order = "mdy" if x["t"] == "/" and day(x["z"], x["a"], x["b"]) is not None else "dmy"
        sign, parts = x["t"], (x["a"], x["b"], x["z"])
    number = day(*(parts[order.index(c)] for c in "ymd"))
    if number is None:
        return None
    width = [len(p) for p in parts]

    def shown(n: int) -> list[str]:
        d = _FIRST_DAY + timedelta(n)
        values = {"y": d.year, "m": d.month, "d": d.day}
        return [str(values[c]).zfill(4 if c == "y" else w if w == 2 else 1) for c, w in zip(order, width, strict=True)]

    def same_format(n: int) -> bool:
        p = shown(n)
        return [len(v) for v in p] == width and not (order == "dmy" and sign == "/" and int(p[0]) <= 12)

    return sign.join(shown(feistel.permute(number, _DAYS, f"date {order}{sign}{width}", same_format)))


def _ip(found: re.Match, feistel: Feistel) -> str | None:
    parts = found.group().split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ip6(found: re.Match, feistel: Feistel) -> str | None:
    try:
        value = int(IPv6Address(found.group()))
    except ValueError:
        return None
    # unspecified, loopback and the like are nobody's; they stay, and nothing becomes one; a name
    # of letters alone between colons is more often code
    if value >> 32 == 0 or not _digits(found.group()):
        return None
    return str(IPv6Address(feistel.permute(value, 1 << 128, "ip6", lambda x: x >> 32 != 0)))


def _ssn(found: re.Match, feistel: Feistel) -> str | None:
    def valid(n: int) -> bool:
        area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    value = int(_digits(found.group()))
    return _fill(found.group(), f"{feistel.permute(value, 10**9, 'ssn', valid):09d}") if valid(value) else None


def _card(found: re.Match, feistel: Feistel) -> str | None:
    digits = _digits(found.group())
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = str(feistel.permute(int(digits[:-1]), 10 ** (len(digits) - 1), "card")).zfill(len(digits) - 1)
    return _fill(found.group(), body + luhn_digit(body))


def _phone(found: re.Match, feistel: Feistel) -> str | None:
    text = found.group()
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", text)
    head = code.group() if code else ""
    digits = _digits(text[len(head) :])
    if not 7 <= len(digits) + len(_digits(head)) <= 15 or len(digits) < 6:
        return None
    return head + _fill(text[len(head) :], str(feistel.permute(int(digits), 10 ** len(digits), f"phone {head}")).zfill(len(digits)))


#: In order of precedence where two overlap from the same place on.
KINDS: dict[str, tuple[re.Pattern, Callable[[re.Match, Feistel], str | None]]] = {
    "email": (_EMAIL, _email),
    "iban": (_IBAN, _iban),
    "card": (_CARD, _card),
    "ssn": (_SSN, _ssn),
    "date": (_DATE, _date),
    "ip": (_IP, _ip),
    "ip6": (_IP6, _ip6),
    "phone": (_PHONE, _phone),
}


def pseudonyms(text: str, feistel: Feistel, kinds: tuple[str, ...] = tuple(KINDS)) -> tuple[str, list[tuple[str, int, int]]]:
    """``text`` with every valid value permuted, and the spans ``(kind, start, end)`` in code points of the input.

    Valid values are taken from left to right, of two that overlap the earlier, then the longer,
    then the kind listed first.
    """
    found = []
    for rank, kind in enumerate(kinds):
        pattern, permuted = KINDS[kind]
        if (kind == "email" and "@" not in text) or (kind == "ip6" and text.count(":") < 2):
            continue
        for match in pattern.finditer(text):
            new = permuted(match, feistel)
            if new is not None:
                found.append((match.start(), -match.end(), rank, kind, new))
    out, spans, at = [], [], 0
    for start, end, _, kind, new in sorted(found):
        if start >= at:
            out += [text[at:start], new]
            at = -end
            spans.append((kind, start, at))
    return "".join([*out, text[at:]]) if spans else text, spans


@lru_cache(maxsize=4)
def _feistel(key: bytes) -> Feistel:
    return Feistel(key)


def pseudonymize(documents: DataFrame, key: bytes, *, text_column: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """``documents`` with the personal numbers, dates and addresses of every whole text permuted.

    E-mail addresses (letters of any language), IBANs with or without blanks, payment cards,
    social security numbers, dates of 1900 to 2099 (also at the start of an ISO timestamp, whose
    time stays), IPv4 and IPv6 addresses and telephone numbers that are valid by their check
    digits, ranges and calendar become others of the same format under ``key``: equal values
    become equal values in all documents, different ones stay different, and ``key`` can lead
    back.  Shapes, separators, country codes and top-level domains stay; letters become letters
    of their alphabet and case; an IPv6 address comes out in its shortest form.

    Left as they are: names and postal addresses, dates with names of months, of two-digit
    years or without separators, times of day, numbers in words, telephone numbers of a
    single group of digits without a ``+``, and IPv6 addresses that are
    loopback, unspecified or without a decimal digit.

    One map-only pass.  Adds ``pii``, an array of ``(kind, start, end)`` in code points of the
    input, in place of a column of that name; all other columns stay, of any name and type.
    A NULL text stays NULL, an empty one empty; very long texts are read whole; repeated rows
    give repeated results, and an empty table an empty one.
    """
    kept = [x for x in documents.columns if x != "pii"]
    at = kept.index(text_column)
    plain = plain_columns(documents, kept)
    found = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*plain.schema.fields, T.StructField("pii", T.ArrayType(found))])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = _feistel(key)
        for rows, texts in blocks(batches, f"c{at}"):
            data = texts.data
            sign = np.concatenate([[0], np.cumsum(((data >= 0x30) & (data <= 0x39)) * 1 + (data == 0x40) * 4)])
            # four digits or an at sign: less can't hold any of the kinds
            likely = np.flatnonzero(sign[texts.offsets[1:]] - sign[texts.offsets[:-1]] >= 4).tolist()
            changed, spans = {}, [[] for _ in range(len(texts))]
            for i in likely:
                text = data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode()
                new, found = pseudonyms(text, feistel, kinds)
                if found:
                    changed[i] = new
                    spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in found]
            columns = list(rows.columns)
            if changed:
                values = columns[at].to_pylist()
                for i, new in changed.items():
                    values[i] = new
                columns[at] = pa.array(values, type=columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, type=span)], names=schema.names)

    return plain.mapInArrow(scan, schema).toDF(*kept, "pii")
