"""Toxicity scores: misspelled terms by Levenshtein automata, weighed by the context of each hit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbspark.llm.automata import Trie, near_terms
from plumbspark.llm.ids import plain_columns
from plumbspark.llm.storage import cut
from plumbspark.llm.text import LOWER, Texts, blocks, codes, runs

#: Labelled rows that the lexicon and the model are fitted on, at most about so many.
FIT_ROWS = 20_000

#: Terms of the lexicon, at most.
FIT_TERMS = 5_000

#: Words on each side of a hit that its context is read from.
CONTEXT_WORDS = 6

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x30:0x3A] = True
_INSIDE[0x41:0x5B] = True
_INSIDE[0x61:0x7B] = True
_INSIDE[0x80:] = True
_INSIDE[[ord("@"), ord("$")]] = True

#: Signs written for letters.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
#: Words that report what somebody else said, and words that address the reader.
_REPORTS = frozenset("said says say called calls call wrote writes word words term quote quoted sagte nannte wort dit appelle mot dijo llama palabra".split())
_ADDRESS = frozenset("you your you're youre u ur yourself du dich dir ihr tu te toi vous tú usted".split())
_QUOTES = frozenset("\"'“”„‟«»‹›‘’")

_REPEATED = re.compile(r"(.)\1{2,}")

FEATURES = ("abuse", "misspelled", "quoted", "addressed", "density")


def normal(word: str) -> str:
    """Lower case, no outer signs, signs inside words as letters, three or more equal letters as one."""
    word = word.strip("@$").lower()
    if not word.isalpha():
        if not any(x.isalpha() for x in word):
            return ""
        word = word.translate(_SIGNS)
    return _REPEATED.sub(r"\1", word)


@dataclass
class Lexicon:
    """Terms with a weight; which of them take misspellings, and words that are not misspellings."""

    weights: dict[str, float]
    fuzzy: list[str] = field(default_factory=list)
    known: frozenset[str] = frozenset()
    distance: int = 1

    def match(self, distinct: list[bytes], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each distinct word, 0 for none, and whether it is a misspelling."""
        word = [normal(x.decode()) for x in distinct]
        weight = np.fromiter((self.weights.get(x, 0.0) for x in word), dtype=np.float64, count=len(word))
        spelled = np.zeros(len(word), dtype=bool)
        if self.fuzzy:
            open_ = [x if len(x) > 3 and w == 0 and x not in self.known else "" for x, w in zip(word, weight, strict=True)]
            at, term, _ = near_terms(open_, trie, self.distance)
            np.maximum.at(weight, at, np.array([self.weights[x] for x in self.fuzzy])[term])
            spelled[at] = True
        return weight, spelled


def features(texts: Texts, lexicon: Lexicon, trie: Trie) -> np.ndarray:
    """One row of :data:`FEATURES` for every text.

    Each hit is judged in its window of words: quotation marks on both sides or a reporting
    word before it make it a quotation, a word of address makes it abuse of the reader.
    """
    found = runs(texts, _INSIDE[texts.data])
    code, distinct, _ = codes(LOWER[texts.data], found)
    weight, spelled = lexicon.match(distinct, trie)
    sums = np.zeros((len(texts), len(FEATURES)))
    if not len(code):
        return sums
    hits = np.flatnonzero(weight[code] > 0)
    owner = np.searchsorted(found.first, hits, side="right") - 1
    for hit, text in zip(hits.tolist(), owner.tolist(), strict=True):
        low = max(found.first[text], hit - CONTEXT_WORDS)
        high = min(found.first[text + 1], hit + CONTEXT_WORDS + 1)
        around = [distinct[c].decode() for c in code[low:high].tolist()]
        before = texts.data[found.start[low] - (found.start[low] > texts.offsets[text]) : found.start[hit]].tobytes().decode(errors="ignore")
        after = texts.data[found.end[hit] : found.end[high - 1] + (found.end[high - 1] < texts.offsets[text + 1])].tobytes().decode(errors="ignore")
        marks = any(x in _QUOTES for x in re.sub(r"\w['’]\w", "", before)) and any(x in _QUOTES for x in re.sub(r"\w['’]\w", "", after))
        reported = any(x in _REPORTS for x in around[max(0, hit - low - 3) : hit - low])
        value = weight[code[hit]]
        if marks or reported:
            sums[text, 2] += value
        else:
            sums[text, 1 if spelled[code[hit]] else 0] += value
            if any(x in _ADDRESS for x in around):
                sums[text, 3] += value
    sums[:, 4] = sums[:, :2].sum(axis=1) / np.maximum(np.diff(found.first), 1)
    return np.log1p(sums)


@dataclass
class ToxicityModel:
    """A lexicon and a logistic model over the features; the same on the driver and in every task."""

    lexicon: Lexicon
    weights: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        z = self.weights[0] + values @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: What a hit of each kind is taken to mean before any label is seen; labels move it.
PRIOR = np.array([-2.0, 3.0, 2.5, -0.5, 0.5, 0.5])


def fit_weights(values: np.ndarray, labels: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a Gaussian prior around ``prior``."""
    x = np.column_stack([np.ones(len(values)), values])
    w = prior.copy()
    hold = np.full(len(w), strength)
    hold[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - labels) + hold * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(identifier: Column, folds: int = 5) -> Column:
    """Rows whose CRC-32 of the id as text is divisible by ``folds``; never used to fit.  False for a NULL id."""
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _labelled(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, fit_rows: int) -> DataFrame:
    """Distinct labelled texts outside the held-out fold, about ``fit_rows`` at most, picked by a hash of the id."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).dropna().where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, fit_rows / max(n, 1))))
    texts = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # at most about fit_rows ids and labels: a bound that doesn't grow with the tables
    return texts.join(F.broadcast(picked), "id").select("label", "text")


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", fit_rows: int = FIT_ROWS, fit_terms: int = FIT_TERMS, min_toxic: int = 5, crowded: int = 3) -> ToxicityModel:
    """Learn terms and weights from labelled documents outside the held-out fold.

    Terms are words of at least ``min_toxic`` toxic texts, and of 0.4 percent of them, that
    clean texts have less than half as often; near copies, which share their four smallest
    word hashes, count once.  A term takes
    misspellings unless ``crowded`` words of clean texts lie within one edit of it; those
    words themselves are never misspellings.
    """
    fitting = _labelled(documents, labels, id_column, text_column, label_column, fit_rows)

    def sketch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(frames, "text"):
            found = runs(texts, _INSIDE[texts.data])
            code, _, hashes = codes(LOWER[texts.data], found)
            keys = []
            for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
                keys.append(np.sort(np.unique(hashes[code[a:b]]))[:4].tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(keys, type=pa.binary())], names=["label", "text", "key"])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(frames, "text"):
            found = runs(texts, _INSIDE[texts.data])
            code, distinct, _ = codes(LOWER[texts.data], found)
            label = np.asarray(rows.column(0).to_pylist(), dtype=np.int64)
            owner = np.repeat(np.arange(len(texts)), np.diff(found.first))
            pair = np.unique(owner * (len(distinct) + 1) + code)
            word, positive = pair % (len(distinct) + 1), label[pair // (len(distinct) + 1)]
            toxic = np.bincount(word, weights=positive, minlength=len(distinct))
            clean = np.bincount(word, weights=1 - positive, minlength=len(distinct))
            frame = pd.DataFrame({"term": [normal(x.decode()) for x in distinct], "toxic": toxic, "clean": clean})
            frame = frame[frame["term"].str.len().between(2, 40)].groupby("term", as_index=False).sum()
            yield pa.RecordBatch.from_arrays([pa.array(frame["term"], type=pa.string()), pa.array(frame["toxic"].astype("int64")), pa.array(frame["clean"].astype("int64"))], names=["term", "toxic", "clean"])

    one_each = fitting.mapInArrow(sketch, "label int, text string, key binary").groupBy("key").agg(F.min_by("label", "text").alias("label"), F.min("text").alias("text")).select("label", "text")
    one_each = cut(one_each)
    min_toxic = max(min_toxic, one_each.where("label = 1").count() // 250)
    counted = one_each.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = cut(counted)
    # near words are looked for among the words of clean texts, on the executors
    rows = counted.where(F.col("toxic") >= min_toxic).where(F.col("toxic") > 2 * F.col("clean")).orderBy(F.desc(F.col("toxic") - F.col("clean")), "term").limit(fit_terms).collect()
    weights = {r["term"]: float(np.log((r["toxic"] + 0.5) / (r["clean"] + 0.5))) for r in rows}
    terms = sorted(x for x in weights if len(x) > 3)
    lexicon = Lexicon(weights)
    if terms:

        def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trie = Trie(terms)
            for frame in frames:
                at, term, _ = near_terms(frame["term"].tolist(), trie, lexicon.distance)
                yield pd.DataFrame({"word": frame["term"].to_numpy()[at], "near": np.array(terms, dtype=object)[term]})

        ordinary = counted.where("clean > 0").where(~F.col("term").isin(terms)).select("term")
        near = ordinary.mapInPandas(neighbours, "word string, near string")
        crowd = near.groupBy("near").agg(F.countDistinct("word").alias("n"), F.slice(F.sort_array(F.collect_set("word")), 1, crowded).alias("words")).collect()
        crowds = {r["near"]: r["words"] for r in crowd}
        lexicon.fuzzy = [x for x in terms if len(crowds.get(x, [])) < crowded]
        lexicon.known = frozenset(w for x in lexicon.fuzzy for w in crowds.get(x, []))

    def describe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(lexicon.fuzzy)
        for rows_, texts in blocks(frames, "text"):
            values = features(texts, lexicon, trie)
            yield pa.RecordBatch.from_arrays([rows_.column(0), *map(pa.array, values.T)], names=["label", *FEATURES])

    described = one_each.mapInArrow(describe, "label int, " + ", ".join(f"{x} double" for x in FEATURES)).toPandas()
    described = described.sort_values([*FEATURES, "label"])
    return ToxicityModel(lexicon, fit_weights(described[list(FEATURES)].to_numpy(), described["label"].to_numpy(dtype=float)))


def score_toxicity(documents: DataFrame, model: ToxicityModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with ``score``, the chance that a document is toxic, and ``hits``: its log-scaled features.

    One map-only pass over whole texts; the input's own ``score`` and ``hits`` are replaced,
    all other columns kept, of any name and type.  NULL and empty texts score as texts without a
    hit, very long ones are read whole, repeated rows give repeated results, and an empty table
    an empty one.
    """
    kept = [x for x in documents.columns if x not in ("score", "hits")]
    plain = plain_columns(documents, kept)
    added = [T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*plain.schema.fields, *added])

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.lexicon.fuzzy)
        for rows, texts in blocks(frames, f"c{kept.index(text_column)}"):
            values = features(texts, model.lexicon, trie)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(values)), pa.array(values.tolist(), type=pa.list_(pa.float64()))], names=schema.names)

    return plain.mapInArrow(score, schema).toDF(*kept, "score", "hits")
