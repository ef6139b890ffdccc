"""English words inside Hindi text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vanikosh.functions import lexicon as L
from vanikosh.functions.numbers import normalize_numbers
from vanikosh.functions.text import U, alternatives, bind, tokens

_DEVANAGARI = rf"[{U}0900-{U}097f]"
_ENGLISH_SOUND = rf"^(?:{alternatives(L.ENGLISH_BEGINNINGS)})|[{L.ENGLISH_LETTERS}]"


def is_latin(word: Column) -> Column:
    """Has a Latin letter and nothing of Devanagari."""
    return word.rlike("[A-Za-z]") & ~word.rlike(_DEVANAGARI)


def tag_method(core: Column) -> Column:
    """How an English word is known: by its script, by the list of loan words, by its sound; null if it isn't."""
    sounds = core.rlike(_DEVANAGARI) & (F.length(core) >= 4) & core.rlike(_ENGLISH_SOUND)
    return F.when(core == "", None).when(is_latin(core), "latin_script").when(core.isin(L.LOANWORDS), "known_loanword").when(sounds, "phonological")


def token_tags(text: Column) -> Column:
    """Per token ``struct(position, token, core, method, nativised)``."""

    def tag(token: Column, i: Column) -> Column:
        def describe(core: Column) -> Column:
            known = ~is_latin(core) & core.isin(L.LOANWORDS)
            return F.struct(i.alias("position"), token.alias("token"), core.alias("core"), tag_method(core).alias("method"), (known & core.isin(L.NATIVISED)).alias("nativised"))

        return bind(F.btrim(token, F.lit(L.TAG_PUNCTUATION)), describe)

    return F.transform(tokens(text), tag)


def english_tags(text: Column) -> Column:
    """``array<struct(word, position, method, nativised)>`` of the English words; positions count tokens from 0."""
    found = F.filter(token_tags(text), lambda t: t["method"].isNotNull())
    return F.transform(found, lambda t: F.struct(t["core"].alias("word"), t["position"].alias("position"), t["method"].alias("method"), F.coalesce(t["nativised"], F.lit(False)).alias("nativised")))


def tagged_text(text: Column) -> Column:
    """Text with English words in ``[EN]…[/EN]``, punctuation outside, single blanks between tokens."""

    def mark(t: Column) -> Column:
        token, marks = t["token"], F.lit(L.TAG_PUNCTUATION)
        before = F.left(token, F.length(token) - F.length(F.ltrim(token, marks)))
        after = F.right(token, F.length(token) - F.length(F.rtrim(token, marks)))
        return F.when(t["method"].isNull(), token).otherwise(F.concat(before, F.lit("[EN]"), t["core"], F.lit("[/EN]"), after))

    return F.array_join(F.transform(token_tags(text), mark), " ")


def cleanup(text: Column) -> Column:
    """``struct(normed, tagged, num_changes, en_tags)``: numbers as digits, then English words tagged in the result."""


    def record(numbers: Column) -> Column:
        normed = numbers["text"]
        return F.struct(normed.alias("normed"), tagged_text(normed).alias("tagged"), numbers["changes"].alias("num_changes"), english_tags(normed).alias("en_tags"))

    return bind(normalize_numbers(text), record)
