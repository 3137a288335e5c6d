"""Secret scan: base patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.text import Texts, blocks, runs

#: The base kinds in their order, and the kind of what the network adds.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

#: Documents that findings are gathered from to train on, and findings of each label, at most about so many.
FIT_DOCUMENTS = 20_000
FIT_FINDINGS = 3_000

#: Findings made from public formats, and from what looks alike, to train on beside them.
MADE_FINDINGS = 12_000

#: Probability from which on a candidate is accepted in any family, for formats that training had none of.
HIGHEST = 0.6

#: Characters of a candidate and of the text before and after it that the network sees.
BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH = BEFORE + INSIDE + AFTER

#: Shortest candidate of digits and letters, and shortest one that mixes more classes of characters.
LEAST, LEAST_MIXED = 16, 8

#: Longest password with signs of its own, and step of the windows over longer values.
LONGEST_SIGNED, STEP = 32, 24

_VALUE = np.zeros(256, dtype=bool)
_VALUE[[ord(x) for x in string.ascii_letters + string.digits + "+/_.=-"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_HEX = _DIGIT.copy()
_HEX[0x61:0x67] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[0x61:0x7B] = True
_LETTER = _UPPER | _LOWER
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(x) for x in "!@#$%^&*?~|"]] = True
_SIGNED = _SIGN | _DIGIT | _LETTER
_SIGNED[[ord(x) for x in "+_.-"]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(x) for x in "/=."]] = True


@dataclass
class Spans:
    """Spans in bytes of a block, with the number of their kind."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray


def base_spans(texts: Texts) -> Spans:
    """Leftmost non-overlapping matches of each base kind, those too short left out."""
    # a line feed between texts, which no pattern can match across
    shift = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    apart = np.full(len(texts.data) + len(texts), 0x0A, dtype=np.uint8)
    apart[np.arange(len(texts.data)) + shift] = texts.data
    raw = apart.tobytes()
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    spans = np.array(found, dtype=np.int64).reshape(-1, 3)
    # back to positions without the line feeds
    begins = texts.offsets + np.arange(len(texts) + 1)
    behind = np.searchsorted(begins, spans[:, 0], side="right") - 1
    hexes = runs(texts, _HEX[texts.data])
    long = hexes.end - hexes.start >= 24
    start = np.concatenate([spans[:, 0] - behind, hexes.start[long]])
    end = np.concatenate([spans[:, 1] - behind, hexes.end[long]])
    kind = np.concatenate([spans[:, 2], np.full(int(long.sum()), 2)])
    by = np.lexsort((kind, start))
    return Spans(start[by], end[by], kind[by])


def candidates(texts: Texts, taken: Spans | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where values may stand, outside of the spans ``taken``; in order, and none inside another.

    Runs of value characters of ``LEAST`` bytes with a digit and a letter, or of 20 with four
    letters of either case; of runs longer than the network sees their pieces between ``/``, ``=`` and
    ``.`` instead.  Shorter ones of ``LEAST_MIXED`` with capital, small letter and digit.  Runs with
    signs as passwords have them, a digit and a letter, of ``LEAST_MIXED`` to ``LONGEST_SIGNED``.
    """
    data = texts.data
    open_ = np.ones(len(data) + 1, dtype=np.int32)
    if taken is not None:
        change = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(change, taken.start, 1)
        np.add.at(change, taken.end, -1)
        open_ = np.cumsum(change) == 0
    open_ = open_[: len(data)].astype(bool)
    sums = {name: np.concatenate([[0], np.cumsum(mask[data])]) for name, mask in (("digit", _DIGIT), ("upper", _UPPER), ("lower", _LOWER), ("sign", _SIGN))}

    def counts(found: Runs) -> dict[str, np.ndarray]:
        return {name: total[found.end] - total[found.start] for name, total in sums.items()} | {"size": found.end - found.start}

    def plain(n: dict[str, np.ndarray]) -> np.ndarray:
        letters = n["upper"] + n["lower"]
        long = (n["size"] >= LEAST) & (n["digit"] > 0) & (letters > 0)
        no_digit = (n["size"] >= 20) & (n["upper"] >= 4) & (n["lower"] >= 4)
        mixed = (n["size"] >= LEAST_MIXED) & (n["digit"] > 0) & (n["upper"] > 0) & (n["lower"] > 0)
        return long | no_digit | mixed

    value = _VALUE[data] & open_
    found = runs(texts, value)
    n = counts(found)
    good = plain(n)
    whole = good & (n["size"] <= INSIDE)
    parts = [(found.start[whole], found.end[whole])]
    longer = good & (n["size"] > INSIDE)
    if longer.any():
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edge, found.start[longer], 1)
        np.add.at(edge, found.end[longer], -1)
        pieces = runs(texts, (np.cumsum(edge)[:-1] > 0) & ~_BREAK[data])
        good = plain(counts(pieces))
        parts.append((pieces.start[good], pieces.end[good]))
    signed = runs(texts, _SIGNED[data] & open_)
    n = counts(signed)
    good = (n["size"] >= LEAST_MIXED) & (n["size"] <= LONGEST_SIGNED) & (n["sign"] > 0) & (n["digit"] > 0) & (n["upper"] + n["lower"] > 0)
    parts.append((signed.start[good], signed.end[good]))
    start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((-end, start))
    start, end = start[by], end[by]
    reach = np.maximum.accumulate(np.concatenate([[-1], end]))[:-1]
    outer = end > reach
    return start[outer], end[outer]


def windows(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate, start and end of what the network judges: whole candidates, longer ones in steps of ``STEP``."""
    count = 1 + np.maximum(0, -(-(end - start - INSIDE) // STEP))
    owner = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    # the last window ends with its candidate
    begin = np.minimum(start[owner] + STEP * place, np.maximum(start, end - INSIDE)[owner])
    return owner, begin, np.minimum(begin + INSIDE, end[owner])


def free(start: np.ndarray, end: np.ndarray, base: Spans) -> np.ndarray:
    """Whether each candidate overlaps no base span."""
    if not len(base.start):
        return np.ones(len(start), dtype=bool)
    reach = np.maximum.accumulate(base.end)
    before = np.searchsorted(base.start, end, side="left") - 1
    return (before < 0) | (reach[np.maximum(before, 0)] <= start)


def surroundings(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the network sees of each window: bytes before, inside (``INSIDE`` at most) and after; 0 beyond its text."""
    out = np.zeros((len(start), LENGTH), dtype=np.uint8)
    owner = np.searchsorted(texts.offsets, start, side="right") - 1
    for i, (a, b, low, high) in enumerate(zip(start.tolist(), end.tolist(), texts.offsets[owner].tolist(), texts.offsets[owner + 1].tolist(), strict=True)):
        left = texts.data[max(low, a - BEFORE) : a]
        out[i, BEFORE - len(left) : BEFORE] = left
        value = texts.data[a : min(b, a + INSIDE)]
        out[i, BEFORE : BEFORE + len(value)] = value
        right = texts.data[b : min(high, b + AFTER)]
        out[i, BEFORE + INSIDE : BEFORE + INSIDE + len(right)] = right
    return out


#: Fixed classes of bytes: each ASCII character its own, then all others.
_SYMBOLS = np.minimum(np.arange(256), 128)


class CharacterNetwork:
    """Embedding, one convolution, maximum over each of the three parts, and a logistic layer; plain numpy."""

    def __init__(self, seed: int = 2, depth: int = 12, width: int = 5, filters: int = 48) -> None:
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "e": rng.normal(0, 0.3, (129, depth)),
            "w": rng.normal(0, 1 / np.sqrt(width * depth), (width * depth, filters)),
            "b": np.zeros(filters),
            "v": rng.normal(0, 0.1, 3 * filters),
            "c": np.zeros(1),
        }
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[int, float] = {}

    def _parts(self) -> list[slice]:
        last = LENGTH - self.width + 1
        return [slice(0, BEFORE), slice(BEFORE, BEFORE + INSIDE), slice(BEFORE + INSIDE - self.width, last)]

    def _forward(self, x: np.ndarray) -> tuple:
        codes = _SYMBOLS[x]
        embedded = self.p["e"][codes]
        n, depth = len(x), embedded.shape[2]
        windows = np.lib.stride_tricks.sliding_window_view(embedded, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, self.width * depth)
        hidden = np.maximum(windows @ self.p["w"] + self.p["b"], 0)
        tops = [hidden[:, s].argmax(axis=1) + s.start for s in self._parts()]
        pooled = np.concatenate([np.take_along_axis(hidden, t[:, None, :], axis=1)[:, 0] for t in tops], axis=1)
        return codes, windows, tops, pooled, pooled @ self.p["v"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 3e-3, batch: int = 64, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                codes, windows, tops, pooled, z = self._forward(x[rows])
                error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) / len(rows)
                grads = {"v": pooled.T @ error, "c": np.array([error.sum()])}
                back = np.outer(error, self.p["v"]) * (pooled > 0)
                filters = len(self.p["b"])
                gw, gb, ge = np.zeros_like(self.p["w"]), np.zeros_like(self.p["b"]), np.zeros_like(self.p["e"])
                for part, top in enumerate(tops):
                    g = back[:, part * filters : (part + 1) * filters]
                    picked = np.take_along_axis(windows, top[:, :, None], axis=1)
                    gw += np.einsum("nfk,nf->kf", picked, g)
                    gb += g.sum(axis=0)
                    into = (g[:, :, None] * self.p["w"].T[None]).reshape(len(rows), filters, self.width, -1)
                    for k in range(self.width):
                        np.add.at(ge, np.take_along_axis(codes, top + k, axis=1), into[:, :, k])
                grads |= {"w": gw, "b": gb, "e": ge}
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Fit the scale and shift of the logits, then the highest thresholds that keep ``recall``.

        Each family of candidates has a threshold of its own: at most the one that finds
        ``recall`` of its findings, however low their probability is.
        """
        z = self.logits(x)
        scale, shift = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -40, 40)))
            g = np.array([((p - y) * z).mean() + 1e-3 * (scale - 1), (p - y).mean()])
            h = np.array([[(p * (1 - p) * z * z).mean() + 1e-3, (p * (1 - p) * z).mean()], [(p * (1 - p) * z).mean(), (p * (1 - p)).mean() + 1e-6]])
            scale, shift = np.array([scale, shift]) - np.clip(np.linalg.solve(h, g), -1, 1)
        self.scale, self.shift = float(scale), float(shift)
        p, kind = self.probability(x), family(x)
        for k in range(FAMILIES):
            own = np.sort(p[(kind == k) & (y == 1)])
            cut = own[int((1 - recall) * len(own))] if len(own) else 1.0
            self.thresholds[k] = float(min(cut, HIGHEST))

    def accepts(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0, dtype=bool)
        limit = np.array([self.thresholds[k] for k in range(FAMILIES)])
        return self.probability(x) >= limit[family(x)]


#: Families of candidates, each with a threshold of its own.
FAMILIES = 4


def family(x: np.ndarray) -> np.ndarray:
    """0: lower-case and digits; 1: with capitals; 2: with signs; 3: under ``LEAST`` characters."""
    inside = x[:, BEFORE : BEFORE + INSIDE]
    upper = ((inside >= 0x41) & (inside <= 0x5A)).any(axis=1)
    sign = ((inside > 0) & ~(_DIGIT | _LETTER)[inside]).any(axis=1)
    short = inside[:, LEAST - 1] == 0
    return np.where(short, 3, np.where(sign, 2, np.where(upper, 1, 0)))


def made_findings(count: int, seed: int = 5) -> tuple[list[bytes], np.ndarray]:
    """Labelled findings made from public formats of keys, and from what only looks alike.

    They make the network know formats that the corpus at hand may not have.
    """
    rng = np.random.default_rng(seed)

    def pick(alphabet: str, n: int) -> str:
        return "".join(rng.choice(list(alphabet), n))

    lower, upper, digits, hexes = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    alnum = upper + lower + digits
    word = lambda: pick(lower, int(rng.integers(2, 9)))
    some = lambda low, high: int(rng.integers(low, high))

    def prose() -> str:
        # syllables, so that encoded text has the letters of prose
        return " ".join("".join(pick("bcdfghlmnprstvw", 1) + pick("aeiou", 1) + pick("nrst", some(0, 2)) for _ in range(some(1, 4))) for _ in range(some(4, 9)))

    def password() -> str:
        parts = [pick("!@#$%^&*?", some(1, 3)), pick(digits, some(1, 4)), pick(upper, some(1, 3)), pick(lower, some(2, 6)), pick("!@#$%^&*?", 1), pick(alnum, some(1, 6)), pick(digits, some(0, 3))]
        return "".join(rng.permutation(parts))

    def camel() -> str:
        return "".join(word().title() for _ in range(some(2, 4)))

    secret = (
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(digits, 12) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "eyJ" + pick(alnum + "_-", 20) + "." + pick(alnum + "_-", 40),
        lambda: word() + pick("_-", 1) + pick(alnum, some(20, 40)),
        lambda: pick(alnum + "+/", some(24, 44)),
        lambda: pick(alnum, some(16, 48)),
        lambda: pick(lower + digits, some(20, 40)),
        lambda: pick(lower + digits, some(24, 48)),
        lambda: pick(upper + digits, some(20, 32)),
        password,
        password,
    )
    plain = (
        lambda: ".".join(word() for _ in range(3)) + str(some(0, 99)) + ".com",
        lambda: f"{some(1990, 2030)}-{some(1, 13):02d}-{some(1, 29):02d}T{some(0, 24):02d}",
        lambda: "/".join([word(), word(), word(), f"page{some(0, 999)}.html"]),
        lambda: "_".join([word(), word(), word(), str(some(0, 999))]),
        lambda: "-".join([word(), word(), word(), f"{some(0, 9)}.{some(0, 9)}.{some(0, 9)}"]),
        lambda: word() + word() + word() + str(some(0, 99)),
        lambda: word() + "=" * some(8, 20) + str(some(0, 9)),
        lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)),
        lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)).upper(),
        lambda: pick(hexes, some(16, 24)),
        lambda: pick(hexes.upper(), int(rng.choice([16, 32, 40, 64]))),
        lambda: base64.b64encode(prose().encode()).decode(),
        lambda: base64.b64encode(prose().capitalize().encode()).decode()[:48],
        lambda: f"{word()}.{word()}{some(0, 99)}@{word()}{some(0, 9)}.{word()}.com",
        lambda: f"{word()}{some(0, 99)}@{word()}.org",
        lambda: camel() + str(some(0, 99)),
        lambda: camel() + "." + camel() + str(some(0, 9)),
        lambda: f"{word()}?{word()}={some(0, 99)}&{word()}={some(0, 9)}",
        lambda: f"{pick(upper, 2)}-{pick(upper, 1)}{some(100, 999)}{pick(upper, 1)}{pick(lower, 1)}",
        lambda: f"{word().title()}{some(0, 99)}!?!",
    )
    texts, labels = [], []
    for i in range(count):
        is_secret = i % 2 == 0
        forms = secret if is_secret else plain
        form = forms[int(rng.integers(0, len(forms)))]
        value, value_is_password = form(), form is password
        before = " ".join(word() for _ in range(4)) + str(rng.choice([" ", ' "', " key: ", "=", ": "]))
        if value_is_password and rng.random() < 0.5:
            before += str(rng.choice([";", " ", ","])) + str(rng.choice(["Password=", "pwd=", "PASS=", "pass: ", "Passwort="]))
        value = value if len(value) <= INSIDE else value[some(0, len(value) - INSIDE + 1) :][:INSIDE]
        texts.append(f"{before}\x00{value}\x00 {word()} {word()}".encode())
        labels.append(float(is_secret))
    return texts, np.array(labels)


_FORMATS = re.compile(
    rb"(?:gh[opsur]_|github_pat_|xox[abprs]-|[sr]k_(?:live|test)_|glpat-|npm_|AIza)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_.-]+|A[KS]IA[A-Z0-9]{12,}"
    rb"|(?=(?:[^A-Z]*[A-Z]){3})(?=(?:[^a-z]*[a-z]){3})(?=(?:[^0-9]*[0-9]){3})[A-Za-z0-9]{24,}|(?=(?:[^0-9]*[0-9]){3})[A-Z0-9]{20,}"
    rb"|(?=(?:[^0-9]*[0-9]){3})(?=(?:[^a-z]*[a-z]){3})[a-z0-9]{24,}"
)


#: What announces a value in the same run of value characters; where a value stands alone it isn't there.
_ANNOUNCED = re.compile(rb".*(?:password|passwd|secret|token|api_?key)=+", re.IGNORECASE)


def known_format(value: bytes) -> bool:
    """Whether ``value`` looks like a public format of keys, or is a long mix of signs like one."""
    return _FORMATS.fullmatch(value) is not None


def _seen(marked: list[bytes]) -> np.ndarray:
    """What the network sees of values marked by a zero byte on both sides."""
    parts = [x.split(b"\x00") for x in marked]
    joined = [b"".join(p) for p in parts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in joined])]).astype(np.int64)
    start = offsets[:-1] + np.array([len(p[0]) for p in parts], dtype=np.int64)
    end = start + np.array([len(p[1]) for p in parts], dtype=np.int64)
    return surroundings(Texts(np.frombuffer(b"".join(joined), dtype=np.uint8), offsets), start, end)


def fit_network(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", fit_documents: int = FIT_DOCUMENTS, fit_findings: int = FIT_FINDINGS, recall: float = 0.98) -> CharacterNetwork:
    """Train on labelled findings: what the base patterns found in a sample of the corpus, and made ones.

    Candidates inside base findings are positive, other candidates negative, but for those in
    a known format of keys: nobody says that these are none.  Positive ones begin behind the
    word and sign that announce them, as the network never judges these.  They are seen with
    the text before them and, as often, with that before another candidate, so that the
    network learns how a value looks and not the word that announced it.  The sample is about
    ``fit_documents`` documents picked by a hash of the id, and ``fit_findings`` findings of
    each label at most.  A fifth is held back to calibrate and to set thresholds; all rows of
    one value are on the same side.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, "text"):
            base = base_spans(texts)
            start, end = candidates(texts)
            label = ~free(start, end, base)
            for i in np.flatnonzero(label).tolist():
                if announced := _ANNOUNCED.match(texts.data[start[i] : end[i]].tobytes()):
                    start[i] += announced.end()
            long = end - start >= LEAST_MIXED
            start, end, label = start[long], end[long], label[long]
            end = np.minimum(end, start + INSIDE)
            sure = label | ~np.fromiter((known_format(texts.data[a:b].tobytes()) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=bool, count=len(start))
            start, end, label = start[sure], end[sure], label[sure]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in surroundings(texts, start, end)], type=pa.binary()), pa.array(label)], names=["seen", "secret"])

    rows = documents.count()
    key = F.pmod(F.xxhash64(F.col(id_column), F.lit(2)), F.lit(1 << 20))
    picked = documents.where(key < int((1 << 20) * min(1.0, fit_documents / max(rows, 1)))).select(F.col(text_column).cast("string").alias("text"))
    found = picked.mapInArrow(gather, "seen binary, secret boolean").distinct()
    order = F.xxhash64("seen")
    both = [x for label in (True, False) for x in found.where(F.col("secret") == label).orderBy(order, "seen").limit(fit_findings).collect()]
    marked, labels = made_findings(MADE_FINDINGS)
    seen = [_seen(marked)]
    if both:
        own = np.array([np.frombuffer(x["seen"], dtype=np.uint8) for x in both])
        secret = np.array([float(x["secret"]) for x in both])
        bare = own[secret == 1].copy()
        bare[:, :BEFORE] = 0
        bare[:, BEFORE - 1] = 0x20
        if len(plain := own[secret == 0]):
            # text before them as other candidates have it, or it would tell announced values from lone ones
            bare[:, :BEFORE] = plain[np.random.default_rng(6).integers(0, len(plain), len(bare)), :BEFORE]
        seen += [own, bare]
        labels = np.concatenate([labels, secret, np.ones(len(bare))])
    x = np.concatenate(seen)
    _, value = np.unique(x[:, BEFORE : BEFORE + INSIDE], axis=0, return_inverse=True)
    held = np.random.default_rng(4).random(value.max() + 1)[value] < 0.2
    network = CharacterNetwork()
    network.train(x[~held], labels[~held])
    network.calibrate(x[held], labels[held], recall)
    return network


def found_by(network: CharacterNetwork, texts: Texts, base: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Spans outside of ``base`` that the network takes for secrets; none overlaps another."""
    start, end = candidates(texts, base)
    owner, low, high = windows(start, end)
    good = network.accepts(surroundings(texts, low, high))
    owner, low, high = owner[good], low[good], high[good]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    if not len(first):
        return low, high
    low, high = low[first], np.maximum.reduceat(high, first)
    apart = low >= np.maximum.accumulate(np.concatenate([[0], high[:-1]]))
    return low[apart], high[apart]


def scan_secrets(documents: DataFrame, network: CharacterNetwork, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All spans of secrets in every whole text.

    Base patterns first; the network then judges every candidate outside of their spans, also
    what is left of a run beside one, and adds those it accepts as kind ``model``.  A candidate
    longer than it sees is judged in windows that overlap by half, and the span covers those
    accepted.  Values of letters alone under 20 characters, of small letters and digits under
    ``LEAST``, and with blanks, quotes or brackets inside are no candidates.

    Returns ``id_column, spans``, one row per input row: an array of ``(kind, start, end)`` in
    code points, end exclusive, by start and then kind as listed in :data:`KINDS`.  A NULL or
    empty text has none; very long texts are read whole; a NULL id is kept, repeated rows give
    repeated results, an empty table none; other columns are ignored.
    """
    kind_type = documents.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            base = base_spans(texts)
            start, end = found_by(network, texts, base)
            all_start = np.concatenate([base.start, start])
            all_end = np.concatenate([base.end, end])
            kind = np.concatenate([base.kind, np.full(len(start), 3)])
            by = np.lexsort((kind, all_start))
            all_start, all_end, kind = all_start[by], all_end[by], kind[by]
            points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
            owner = np.searchsorted(texts.offsets, all_start, side="right") - 1
            # empty texts share an offset with the next one; the last of them owns what follows
            first = points[texts.offsets[owner]]
            spans: list[list[dict]] = [[] for _ in range(len(texts))]
            for i, k, a, b in zip(owner.tolist(), kind.tolist(), (points[all_start] - first).tolist(), (points[all_end] - first).tolist(), strict=True):
                spans[i].append({"kind": KINDS[k], "start": a, "end": b})
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, type=span)], names=[id_column, "spans"])

    picked = documents.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(scan, f"`{id_column}` {kind_type}, spans array<struct<kind: string, `start`: bigint, `end`: bigint>>")
