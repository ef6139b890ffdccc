"""Word alignment and error rates.

The distance between two token lists stays in the JVM: the tokens are renamed to
single characters, whose strings the built-in ``levenshtein`` compares. Alignments
need a traceback, which no built-in offers; they run as Arrow-batched functions
whose rows of the table are numpy vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanikosh.functions.text import bind
from vanikosh.session import ship_package

PAIRS = T.ArrayType(T.StructType([T.StructField("ref", T.StringType()), T.StructField("hyp", T.StringType())]))
OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("ref_w", T.StringType()), T.StructField("hyp_w", T.StringType())]))

#: Characters that stand for tokens: the first kinds by place in this string, later ones by code point.
_ALPHABET = "".join(map(chr, range(0x4E00, 0x9FA6)))
_MORE = 0x10000
#: Most kinds of tokens that two lists may have between them; a table of their prefixes would not fit any memory before.
MOST_KINDS = 0x10FFFF - _MORE


def token_distance(ref: Column, hyp: Column) -> Column:
    """Least number of replaced, missing and added tokens; more than ``MOST_KINDS`` kinds are an error."""

    def letter(place: Column) -> Column:
        point = F.decode(F.unhex(F.lpad(F.hex(place + _MORE), 8, "0")), "UTF-32")
        return F.when(place <= len(_ALPHABET), F.substring(F.lit(_ALPHABET), place.cast("int"), F.lit(1))).otherwise(point)

    def compare(kinds: Column) -> Column:
        named = lambda words: F.array_join(F.transform(words, lambda w: letter(F.array_position(kinds, w))), "")
        return F.when(F.size(kinds) <= MOST_KINDS, F.levenshtein(named(ref), named(hyp))).otherwise(F.raise_error(F.lit("too many kinds of tokens")).cast("int"))

    return F.when(ref.isNotNull() & hyp.isNotNull(), bind(F.array_distinct(F.concat(ref, hyp)), compare))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Errors per token of the reference; without tokens in it, 0 if the hypothesis has none either, else 1."""
    n = F.size(ref)
    return F.when(n > 0, token_distance(ref, hyp) / n).otherwise(F.when(F.size(hyp) > 0, 1.0).otherwise(0.0))


def utterance_error_rate(ref: Column, hyp: Column) -> Column:
    """Errors per token of the reference, and 0 for a reference without tokens, whatever was recognised."""
    return F.when(F.size(ref) > 0, token_distance(ref, hyp) / F.size(ref)).otherwise(0.0)


def _codes(ref, hyp) -> tuple[np.ndarray, np.ndarray]:
    names: dict[str, int] = {}
    code = lambda words: np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    return code(ref), code(hyp)


def _table(ref: np.ndarray, hyp: np.ndarray, same: int, other: int, gap: int) -> np.ndarray:
    """Least costs of all prefixes. A row is the least over all places from which it comes by added tokens only."""
    out = np.empty((len(ref) + 1, len(hyp) + 1), np.int32)
    steps = np.arange(len(hyp) + 1) * gap
    out[0] = steps
    for i, r in enumerate(ref):
        row = out[i] + gap
        row[1:] = np.minimum(row[1:], out[i, :-1] + np.where(hyp == r, same, other))
        out[i + 1] = np.minimum.accumulate(row - steps) + steps
    return out


def _trace(ref, hyp, same: int, other: int, gap: int) -> list[tuple[str | None, str | None]]:
    """The alignment of least cost; of equal steps back, a pair comes before a missing token and that before an added one."""
    a, b = _codes(ref, hyp)
    cost = _table(a, b, same, other, gap).tolist()
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (same if a[i - 1] == b[j - 1] else other):
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and cost[i][j] == cost[i - 1][j] + gap:
            i -= 1
            out.append((ref[i], None))
        else:
            j -= 1
            out.append((None, hyp[j]))
    return out[::-1]


def align_tokens(ref: Column, hyp: Column) -> Column:
    """``array<struct(ref, hyp)>``: alignment that earns 1 for a match and loses 1 for any mismatch or gap; null for a null side."""
    ship_package()
    return _align(ref, hyp)


def edit_operations(ref: Column, hyp: Column) -> Column:
    """The edit script of least length without its matches: S, D or I with both words, '' for a missing one. Empty for an empty reference."""
    ship_package()
    return _edit(ref, hyp)


def lattice_error_rate(hyp: Column, bins: Column) -> Column:
    """Least errors of a hypothesis against bins of accepted tokens, per bin or token, whichever are more.

    A token of the bin is free, a bin with '' may be left out. Without bins, 0 for no token, else 1.
    """
    ship_package()
    return _lattice_rate(hyp, bins)


@F.pandas_udf(PAIRS)
def _align(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else [{"ref": a, "hyp": b} for a, b in _trace(list(r), list(h), -1, 1, 1)] for r, h in zip(ref, hyp)], dtype=object)


@F.pandas_udf(OPS)
def _edit(ref: pd.Series, hyp: pd.Series) -> pd.Series:

    def script(r, h):
        pairs = _trace(list(r), list(h), 0, 1, 1) if len(r) else []
        return [{"op": "I" if a is None else "D" if b is None else "S", "ref_w": a or "", "hyp_w": b or ""} for a, b in pairs if a != b]

    return pd.Series([None if r is None or h is None else script(r, h) for r, h in zip(ref, hyp)], dtype=object)


@F.pandas_udf(T.DoubleType())
def _lattice_rate(hyp: pd.Series, bins: pd.Series) -> pd.Series:

    def rate(tokens, accepted) -> float:
        if not len(accepted):
            return 1.0 if len(tokens) else 0.0
        steps = np.arange(len(tokens) + 1)
        row = steps.copy()
        for names in accepted:
            names = set(names)
            new = row + (0 if "" in names else 1)
            new[1:] = np.minimum(new[1:], row[:-1] + np.array([t not in names for t in tokens], dtype=int))
            row = np.minimum.accumulate(new - steps) + steps
        return float(row[-1]) / max(len(tokens), len(accepted))

    return pd.Series([None if h is None or b is None else rate(list(h), list(b)) for h, b in zip(hyp, bins)], dtype=object).astype("float64")
