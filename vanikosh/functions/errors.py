"""Categories of recognition errors, their severity, and rule-based repair, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vanikosh.functions import lexicon as L
from vanikosh.functions.text import bind, composed, tokens, word_at

_E, _AA, _EEN = chr(0x947), chr(0x93E), chr(0x940) + chr(0x902)


def severity(wer: Column) -> Column:
    return F.when(wer <= 0.25, "mild").when(wer <= 0.60, "moderate").otherwise("severe")


def category(op: Column, ref: Column, hyp: Column) -> Column:
    """The first category whose test holds."""
    digits = lambda w: w.rlike(r"(?U)^\d+$")
    shorter = F.least(F.length(ref), F.length(hyp))
    same = lambda k: F.left(ref, k) == F.left(hyp, k)
    return (
        F.when((ref.isin(L.COUNT_WORDS) & digits(hyp)) | (hyp.isin(L.COUNT_WORDS) & digits(ref)), "NUMERIC_MISMATCH")
        .when(op == "I", "INSERTION")
        .when((op == "D") & (F.length(ref) <= 2), "DELETION_FUNC")
        .when(op == "D", "DELETION_CONTENT")
        .when(ref.isin(L.POSTPOSITIONS) | hyp.isin(L.POSTPOSITIONS), "POSTPOSITION_ERROR")
        .when((shorter >= 3) & same(F.greatest(F.lit(2), shorter - 2)) & (ref != hyp), "GRAM_INFLECTION")
        .when((shorter >= 3) & same(F.lit(3)) & (F.abs(F.length(ref) - F.length(hyp)) <= 2), "PHONETIC_CONF")
        .when((F.length(ref) >= 4) & (hyp.contains(ref) | ref.contains(hyp)), "COMPOUND_SPLIT")
        .otherwise("OTHER_SUBST")
    )


def stem(word: Column) -> Column:
    """The word without the first of the listed suffixes that it ends in and is longer than."""
    out = word
    for suffix in reversed(L.SUFFIXES):
        n = len(suffix)
        out = F.when(word.endswith(suffix) & (F.length(word) > n), F.substring(word, F.lit(1), F.length(word) - n)).otherwise(out)
    return out


def repair(text: Column) -> Column:
    """Agreement before ``ने`` and after feminine plurals, then postpositions that the next word's stem asks for."""
    return bind(bind(tokens(text), _agreed), lambda words: F.array_join(_governed(words), " "))


def _agreed(words: Column) -> Column:
    def agree(w: Column, i: Column) -> Column:
        cut = F.substring(w, F.lit(1), F.length(w) - 1)
        can = w.endswith(_E) & (F.length(w) > 1)
        return F.when(can & word_at(words, i - 1).isin(list(L.FEMININE_PLURAL)), F.concat(cut, F.lit(_EEN))).when(can & (word_at(words, i + 1) == "ने"), F.concat(cut, F.lit(_AA))).otherwise(w)

    return F.transform(words, agree)


def _governed(words: Column) -> Column:
    def govern(w: Column, i: Column) -> Column:
        def choose(head: Column) -> Column:
            out = w
            for stems, wrong, right in L.GOVERNMENT:  # of rules that fit the same stem the last one decides
                out = F.when(head.isin(stems) & w.isin(wrong), F.lit(right)).otherwise(out)
            return out

        return F.when(w.isin(L.REPAIRED_POSTPOSITIONS), bind(bind(word_at(words, i + 1), stem), choose)).otherwise(w)

    return F.transform(words, govern)


def spelling_variants(token: Column, compose=composed) -> Column:
    """The token and its forms with one sign replaced throughout, or without nukta, each in composed form.

    ``compose``: ``composed`` for normalised tokens, ``nfc`` for tokens of any script.
    """
    swaps = ((0x902, 0x901), (0x901, 0x902), (0x93F, 0x940), (0x940, 0x93F), (0x941, 0x942), (0x942, 0x941))
    forms = [token, *[F.replace(token, F.lit(chr(a)), F.lit(chr(b))) for a, b in swaps], F.replace(token, F.lit(chr(0x93C)), F.lit(""))]
    return F.array_distinct(F.array(*[compose(f) for f in forms]))
