"""Tokens and normalised text as column expressions."""

from __future__ import annotations

import itertools
import os
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanikosh.session import ship_package

U = "\\" + "u"
#: Content of a character class: every code point at which text splits into tokens.
WHITE = rf"\t-\r\x1c-\x20\x85\xa0{U}1680{U}2000-{U}200a{U}2028{U}2029{U}202f{U}205f{U}3000"
_NUKTA = chr(0x93C)
#: Composed form of Devanagari: letters that composition takes apart, and pairs that it joins.
_APART = {chr(0x958 + i): chr(c) + _NUKTA for i, c in enumerate((0x915, 0x916, 0x917, 0x91C, 0x921, 0x922, 0x92B, 0x92F))}
_TOGETHER = {chr(c - 1) + _NUKTA: chr(c) for c in (0x929, 0x931, 0x934)}


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """The pieces between white space, none of them empty; null for null."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda t: t != "")


def _classes() -> list[str]:
    """The combining marks that normalised text may hold, as contents of character classes, in their canonical order."""
    by: dict[int, str] = {}
    for c in (*range(0x900, 0x980), *range(0x1CD0, 0x1D00)):
        if unicodedata.combining(chr(c)):
            by[unicodedata.combining(chr(c))] = by.get(unicodedata.combining(chr(c)), "") + chr(c)
    return [by[k] for k in sorted(by)]


_CLASSES = _classes()
_ALL_MARKS = "".join(_CLASSES)
#: Texts of these characters (of which only those of Devanagari combine) have nothing to compose but what ``composed`` knows.
_KNOWN = rf"^[ -~{U}00a0-{U}02ff{U}0391-{U}03c9{U}0400-{U}0482{U}0900-{U}097f{U}1cd0-{U}1cff{U}2002-{U}206f{U}feff{U}ff00-{U}ff9d]*$"


def _in_order(text: Column) -> Column:
    """Runs of combining marks in canonical order; marks of one class stay in theirs."""

    def sort(piece: Column) -> Column:
        parts = [F.regexp_replace(piece, f"[^{c}]+", "") for c in _CLASSES]
        return F.when(piece.rlike(f"^[{_ALL_MARKS}]"), F.concat(*parts)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"[{_ALL_MARKS}]+|[^{_ALL_MARKS}]+"), F.lit(0))
    out = F.array_join(F.transform(pieces, sort), "")
    for parts, one in _TOGETHER.items():  # marks of the first class don't keep a nukta from its letter
        out = F.regexp_replace(out, f"{parts[0]}([{_CLASSES[0]}]+){_NUKTA}", f"{one}$1")
    return F.when(text.rlike(f"[{_ALL_MARKS}]{{2}}"), out).otherwise(text)


def composed(text: Column) -> Column:
    """Canonical composed form of Devanagari text; other scripts are left alone."""
    for one, parts in _APART.items():
        text = F.replace(text, F.lit(one), F.lit(parts))
    text = _in_order(text)
    for parts, one in _TOGETHER.items():
        text = F.replace(text, F.lit(parts), F.lit(one))
    return text


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composed form of text of any script; what isn't ASCII or Devanagari goes through Python."""
    ship_package()
    other = F.when(~text.rlike(_KNOWN), text)
    return F.when(other.isNull(), composed(text)).otherwise(_nfc(other))


def normalized(text: Column) -> Column:
    """Devanagari, ASCII digits, blanks and the marks ``। ॥ , ? ! .`` only, blanks collapsed; null gives ''.

    Tabs and line breaks go with the other characters, so that words on both sides join.
    """
    kept = F.regexp_replace(composed(text), rf"[^{U}0900-{U}097f{U}1cd0-{U}1cff0-9 ,?!.]", "")
    return F.coalesce(F.trim(F.regexp_replace(kept, " +", " ")), F.lit(""))


def characters(word: Column) -> Column:
    """The code points of a string, in order; empty for ''."""
    return F.filter(F.split(word, ""), lambda c: c != "")


def word_at(words: Column, i: Column) -> Column:
    """The word at a 0-based place, '' outside."""
    return F.coalesce(F.get(words, i), F.lit(""))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by blanks; empty for shorter texts."""
    last = F.size(words) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def alternatives(words) -> str:
    """A pattern of any of the words, longest first, with common beginnings taken together: a word that fails, fails at its first letters."""
    words = sorted(set(words))
    if len(words) <= 1:
        return re.escape(words[0]) if words else "(?!)"
    out = []
    for first, group in itertools.groupby([w for w in words if w], key=lambda w: w[0]):
        group = list(group)
        shared = os.path.commonprefix(group)
        tails = [w[len(shared) :] for w in group]
        out.append(re.escape(shared) + (f"(?:{alternatives(tails)})" if len(tails) > 1 else ""))
    return "|".join(out) + ("|" if "" in words else "")
