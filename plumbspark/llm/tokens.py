"""Public tokenizers by pre-token: every distinct pre-token is encoded once."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.text import LOWER, Runs, Texts, blocks, codes, gather, per_text, runs

#: Distinct pre-tokens that a worker remembers before it starts anew.
MEMORY = 300_000

_LETTER, _DIGIT, _SYMBOL, _OTHER, _FOLLOWS, _BLANK = 1, 2, 3, 4, 5, 0

_CLASSES = np.full(256, _OTHER, dtype=np.uint8)
_CLASSES[:0x80] = _SYMBOL
_CLASSES[:0x20] = _OTHER
_CLASSES[0x7F] = _OTHER
_CLASSES[ord("'")] = _OTHER
_CLASSES[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASSES[0x30:0x3A] = _DIGIT
_CLASSES[0x41:0x5B] = _LETTER
_CLASSES[0x61:0x7B] = _LETTER
_CLASSES[0x80:0xC0] = _FOLLOWS
_CLASSES[0xC3:0xCA] = _LETTER  # U+00C0 to U+027F begin with these; all letters but the three below
_NO_LETTER = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0xC9, 0x90))

#: What pre_tokens() can give without a byte in doubt: Latin letters, one digit, or ASCII symbols.
_PLAIN = re.compile(r"[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level models write for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [x for x in range(0x100) if x not in shown]
    return {x: 0x100 + i for i, x in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


#: The normalizer and the splitter that pre_tokens() follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _described(component: object) -> object:
    return None if component is None else json.loads(component.__getstate__())


class WordTokenizer:
    """A ``tokenizers`` file whose splitter never joins letters, digits and symbols.

    Its normalizer makes small letters of white space and text, and its splitter takes contractions,
    letters, single digits, other symbols; of a file with others ValueError is raised, as its
    texts would be cut elsewhere.
    Texts are cut at white space and between letters, digits and ASCII symbols, where such a
    splitter cuts as well; anything in doubt (apostrophes, other scripts, combining marks)
    stays in one piece, which the library then splits.  A text that holds a special string
    goes through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if _described(self.library.normalizer) != _NORMALIZER or _described(self.library.pre_tokenizer) != _SPLITTER:
            raise ValueError(f"{path} normalizes or splits texts in another way than pre-tokens are cut")
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        #: The ids of pre-tokens, as bytes: lists of numbers take three times the memory.
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        encoded = self.library.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [x.ids for x in encoded]

    def pieces(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each distinct pre-token as 32-bit numbers, looked up or encoded once."""
        if len(self.known) > MEMORY:
            self.known.clear()
        out = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(new, self.encode_pieces([distinct[i] for i in new]), strict=True):
            out[i] = self.known[distinct[i]] = array("I", ids).tobytes()
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pre-tokens; those that need no more splitting go to the merges directly."""
        out: list[list[int] | None] = []
        for piece in pieces:
            word = piece.decode().lower()
            plain = _PLAIN.fullmatch(word)
            out.append([x.id for x in self.library.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))] if plain else None)
        rest = iter(self.encode([x for x, ids in zip(pieces, out, strict=True) if ids is None]))
        return [next(rest) if ids is None else ids for ids in out]

    def special_texts(self, texts: Texts) -> dict[int, list[int]]:
        """Ids of the texts that hold a special string."""
        whole = texts.data.tobytes()
        if not any(x in whole for x in self.special):
            return {}
        each = [(i, whole[texts.offsets[i] : texts.offsets[i + 1]]) for i in range(len(texts))]
        each = [(i, x) for i, x in each if any(s in x for s in self.special)]
        return dict(zip((i for i, _ in each), self.encode([x for _, x in each]), strict=True))


def pre_tokens(texts: Texts) -> Runs:
    """Pieces between white space, and between ASCII symbols, digits and Latin letters."""
    data = texts.data
    if not len(data):
        return runs(texts, np.zeros(0, dtype=bool))
    kind = _CLASSES[data]
    follows = np.flatnonzero(kind == _FOLLOWS)
    kind[follows] = np.where((follows > 0) & (data[follows - 1] >= 0xC3) & (data[follows - 1] <= 0xC9), _LETTER, _OTHER)
    for lead, tail in _NO_LETTER:
        at = np.flatnonzero((data[:-1] == lead) & (data[1:] == tail))
        kind[at] = kind[at + 1] = _OTHER
    before = np.concatenate([[_BLANK], kind[:-1]])
    cut = (before != kind) & (before != _OTHER) & (kind != _OTHER) | (kind == _DIGIT) & (before == _DIGIT)
    cut |= (before == _BLANK) != (kind == _BLANK)
    cut[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    end = np.concatenate([start[1:], [len(data)]])
    real = kind[start] != _BLANK
    start, end = start[real], end[real]
    return Runs(start, end, np.searchsorted(start, texts.offsets))


def count_tokens(documents: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text, as the library counts them.

    Pieces are counted once per distinct pre-token; the counts are joined to the pre-token
    frequencies of each document by dictionary code and summed, so that the ids of a
    document are never made.  The join stays within a block of documents: no shuffle.

    Returns ``id_column, n_bytes, n_tokens, over_limit``, one row per input row.  A NULL text
    counts as empty, and very long ones are read whole; a NULL id is kept; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result.
    ValueError is raised for a file that :class:`WordTokenizer` doesn't fit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        sizes: dict[bytes, int] = {}
        for rows, texts in blocks(batches, "text"):
            found = pre_tokens(texts)
            code, distinct, _ = codes(LOWER[texts.data], found)
            if len(sizes) > 4 * MEMORY:
                sizes.clear()
            counts = list(map(sizes.get, distinct))
            new = [i for i, n in enumerate(counts) if n is None]
            for i, ids in zip(new, tokenizer.encode_pieces([distinct[i] for i in new]), strict=True):
                counts[i] = sizes[distinct[i]] = len(ids)
            per_piece = np.asarray(counts, dtype=np.int64)
            total = per_text(found, per_piece[code])
            for i, ids in tokenizer.special_texts(texts).items():
                total[i] = len(ids)
            n_bytes = np.diff(texts.offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_bytes), pa.array(total.astype(np.int64)), pa.array(total > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    WordTokenizer(tokenizer_path)
    kind = documents.schema[id_column].dataType.simpleString()
    picked = documents.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    if id_column == "text":
        raise ValueError("the id column cannot be named text")
    return picked.mapInArrow(count, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def encoded(tokenizer: WordTokenizer, texts: Texts, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and the number of each text's ids, ``end_id`` included."""
    found = pre_tokens(texts)
    code, distinct, _ = codes(LOWER[texts.data], found)
    ids, lengths = gather(tokenizer.pieces(distinct), code, np.uint32)
    sizes = per_text(found, lengths)
    special = tokenizer.special_texts(texts)
    if special or end_id is not None:
        starts = np.cumsum(sizes) - sizes
        tail = [] if end_id is None else [end_id]
        if special:
            parts = [np.asarray([*special[i], *tail] if i in special else [*ids[a : a + n], *tail], dtype=np.uint32) for i, (a, n) in enumerate(zip(starts, sizes, strict=True))]
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        else:
            ids = np.insert(ids, starts + sizes, end_id)
            sizes = sizes + 1
    return ids, sizes
