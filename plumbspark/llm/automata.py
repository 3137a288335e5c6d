"""Levenshtein automata of many words run in lockstep through a trie of terms."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Trie:
    """Terms by their letters; every node carries the number of the term that ends there, or -1."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term = [-1]
        self.longest = 0
        for number, term in enumerate(terms):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.term)
                    self.children.append({})
                    self.term.append(-1)
                node = self.children[node][letter]
            self.term[node] = number
            self.longest = max(self.longest, len(term))


def near_terms(words: list[str], trie: Trie, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (word, term) within ``distance`` edits: numbers of word and term, and the distance.

    A word's automaton is its row of edit distances to the letters read so far, of which
    only the ``2 * distance + 1`` around the diagonal can stay within the distance.  All
    automata take the same step of the trie at once; a branch goes on with the words that
    are still alive, and ends when there are none.
    """
    band, dead = 2 * distance + 1, distance + 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    fit = np.flatnonzero((sizes > 0) & (sizes <= trie.longest + distance))
    width = trie.longest + distance
    letters = np.zeros((len(fit), width + 2 * band), dtype=np.uint32)
    if len(fit):
        joined = "".join(words[i] for i in fit)
        flat = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        row = np.repeat(np.arange(len(fit)), sizes[fit])
        column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes[fit]) - sizes[fit], sizes[fit])
        letters[row, column + band] = flat
    # entry d of a row is the distance to the word's first (depth - distance + d) letters
    first = np.tile(np.array([dead] * distance + list(range(distance + 1)), dtype=np.uint8), (len(fit), 1))
    out_word, out_term, out_distance = [], [], []
    stack = [(0, 0, np.arange(len(fit)), first)]
    while stack:
        node, depth, alive, rows = stack.pop()
        if trie.term[node] >= 0:
            at = sizes[fit[alive]] - depth + distance
            inside = (at >= 0) & (at < band)
            value = np.full(len(alive), dead, dtype=np.uint8)
            value[inside] = rows[inside, at[inside]]
            hit = value <= distance
            out_word.append(fit[alive[hit]])
            out_term.append(np.full(int(hit.sum()), trie.term[node]))
            out_distance.append(value[hit])
        for letter, child in trie.children[node].items():
            code = np.uint32(ord(letter))
            new = np.full((len(alive), band), dead, dtype=np.uint8)
            for d in range(band):
                end = depth + 1 - distance + d  # letters of the word that this entry covers
                if end < 0:
                    continue
                best = np.full(len(alive), dead, dtype=np.uint8)
                if end > 0:
                    best = rows[:, d] + (letters[alive, end - 1 + band] != code)
                if d + 1 < band:
                    best = np.minimum(best, rows[:, d + 1] + 1)
                if d > 0:
                    best = np.minimum(best, new[:, d - 1] + 1)
                new[:, d] = np.minimum(best, dead)
            live = (new <= distance).any(axis=1)
            if live.any():
                stack.append((child, depth + 1, alive[live], new[live]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *out_word]).astype(np.int64), np.concatenate([none, *out_term]).astype(np.int64), np.concatenate([none, *out_distance]).astype(np.int64)
