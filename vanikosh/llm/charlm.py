"""Interpolated Kneser-Ney character models in sorted hash arrays.

A model is trained on the words of clean sentences and gives the log probability
of any word, character by character, start and end included. Its n-grams are kept
per order as a sorted array of 64-bit hashes beside an array of probabilities, so
that all characters of all words of a batch are looked up at once by binary search.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

START, END = "\x02", "\x03"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _hash_grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at every position; at the first positions zeros stand in front."""
    h = np.full(len(codes), np.uint64(order), dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        if back < len(codes):
            shifted[back:] = codes[: len(codes) - back]
        h = (h ^ shifted) * _PRIME
        h ^= h >> np.uint64(29)
    return h * _MIX


class KneserNey:
    """One language's model; ``order`` is the longest n-gram, ``alphabet`` the size of the uniform base."""

    def __init__(self, words: Counter, order: int = 5, alphabet: int = 400):
        self.order, self.alphabet = order, alphabet
        grams: list[Counter] = [Counter() for _ in range(order + 1)]
        for word, n in words.items():
            text = START + word + END
            for i in range(1, len(text)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        grams[k][text[i - k + 1 : i + 1]] += n
        # below the highest order, count the distinct characters in front; n-grams at a word's start have none
        counts: list[dict[str, float]] = [{} for _ in range(order + 1)]
        counts[order] = dict(grams[order])
        for k in range(order - 1, 0, -1):
            fronts: Counter = Counter(g[1:] for g in grams[k + 1])
            counts[k] = {g: (n if g[0] == START else fronts[g]) for g, n in grams[k].items()}
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        lower: dict[str, float] = {}
        for k in range(1, order + 1):
            seen = Counter(min(3, int(c)) for c in counts[k].values())
            n1, n2, n3 = (max(1, seen[i]) for i in (1, 2, 3))
            y = n1 / (n1 + 2 * n2)
            cut = [0.0, min(0.95, max(0.1, 1 - 2 * y * n2 / n1)), min(1.9, max(0.2, 2 - 3 * y * n3 / n2)), min(2.8, max(0.3, 3 - 4 * y * max(1, n3) / n3))]
            total: dict[str, float] = defaultdict(float)
            freed: dict[str, float] = defaultdict(float)
            for g, c in counts[k].items():
                total[g[:-1]] += c
                freed[g[:-1]] += cut[min(3, int(c))]
            now = {}
            for g, c in counts[k].items():
                h = g[:-1]
                base = 1 / alphabet if k == 1 else lower.get(g[1:], 1 / alphabet)
                now[g] = (c - cut[min(3, int(c))]) / total[h] + freed[h] / total[h] * base
            self.tables.append(_sorted(now, k))
            self.backoff.append(_sorted({h: freed[h] / total[h] for h in total}, k - 1))
            lower = now

    def score(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probability of every position; ``place``: index of the position in its word (0: start marker)."""
        p = np.full(len(codes), 1 / self.alphabet)
        for k in range(1, self.order + 1):
            full = place >= k - 1
            hashes = _hash_grams(codes, k)
            got, value = _look(self.tables[k - 1], hashes)
            if k == 1:
                weight = np.full(len(codes), self.backoff[0][1][0])
            else:
                context = np.empty(len(codes), dtype=np.uint64)
                context[0], context[1:] = 0, _hash_grams(codes, k - 1)[:-1]
                known, weight = _look(self.backoff[k - 1], context)
                weight = np.where(known, weight, 1.0)
            p = np.where(full, np.where(got, value, weight * p), p)
        return np.log(p)


def _sorted(values: dict[str, float], order: int) -> tuple[np.ndarray, np.ndarray]:
    if order == 0:
        return np.zeros(1, np.uint64), np.array([next(iter(values.values()), 1.0)])
    grams = list(values)
    codes = np.array([[ord(c) for c in g] for g in grams], dtype=np.uint64).reshape(len(grams), order)
    flat = codes.ravel()
    hashes = _hash_grams(flat, order)[order - 1 :: order]
    at = np.argsort(hashes)
    return hashes[at], np.fromiter(values.values(), float, len(values))[at]


def _look(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table
    if not len(keys):
        return np.zeros(len(hashes), bool), np.ones(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return keys[at] == hashes, values[at]


def flatten(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and places of all characters of the marked words, and where each word ends."""
    text = "".join(START + w + END for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    return codes, place, ends


def word_scores(models: list[KneserNey], words: list[str]) -> np.ndarray:
    """Log probability of each word (rows) in each model (columns)."""
    if not words:
        return np.zeros((0, len(models)))
    codes, place, ends = flatten(words)
    out = np.empty((len(words), len(models)))
    for j, m in enumerate(models):
        each = np.where(place == 0, 0.0, m.score(codes, place))
        sums = np.concatenate([[0.0], np.cumsum(each)])
        out[:, j] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
    return out
