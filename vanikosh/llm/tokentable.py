"""Texts as arrays of word numbers.

A text is split at white space; every distinct token is brought to the form of
problem 1 and parsed once, and texts become arrays by looking their tokens up. What
costs Python time is thus paid per distinct token and not per token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Characters of text read at a time, which bounds the memory of a worker; a longer text is a portion of its own.
PORTION = 2_000_000


def portions(texts: list[str | None], size: int = PORTION) -> Iterator[slice]:
    """Consecutive runs of texts of about ``size`` characters."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


class TokenTable:
    """Numbers tokens and their words; ``parse`` gives a token's words and one count more.

    Numbers stay valid until ``clear``, which is due once ``full``.
    """

    def __init__(self, parse: Callable[[str], tuple[list[str], int]], memory: int = 400_000):
        self.parse, self.memory = parse, memory
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, int] = {}
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.flat = np.zeros(0, np.int64)
        self.starts, self.sizes, self.extra = (np.zeros(0, np.int64) for _ in range(3))

    @property
    def full(self) -> bool:
        return len(self.tokens) > self.memory

    def _learn(self, new: list[str]) -> None:
        flat, sizes, extra = [], [], []
        numbers, words = self.numbers, self.words
        for token in new:
            said, more = self.parse(token)
            for w in said:
                n = numbers.get(w)
                if n is None:
                    n = numbers[w] = len(words)
                    words.append(w)
                flat.append(n)
            sizes.append(len(said))
            extra.append(more)
        self.tokens.update(zip(new, range(len(self.tokens), len(self.tokens) + len(new))))
        size = np.array(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int64)])
        self.sizes, self.extra = np.concatenate([self.sizes, size]), np.concatenate([self.extra, np.array(extra, np.int64)])

    def numbers_of(self, values: list[str]) -> np.ndarray:
        """The numbers of the words of whole values, each of which is one token and one word."""
        new = list(dict.fromkeys(v for v in values if v not in self.tokens))
        if new:
            self._learn(new)
        return self.flat[self.starts[np.fromiter(map(self.tokens.__getitem__, values), np.int64, len(values))]]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words of the texts in order the number of the text and of the word; and per text the sum of the second counts."""
        split = [t.split() if t else [] for t in texts]
        new = list(dict.fromkeys(w for w in set(chain.from_iterable(split)) if w not in self.tokens))
        if new:
            self._learn(new)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        tokens = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(split)), lengths)
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        words = self.flat[np.arange(total) + np.repeat(self.starts[tokens] - (ends - sizes), sizes)]
        return np.repeat(of, sizes), words, np.bincount(of, self.extra[tokens], len(split)).astype(np.int64)
