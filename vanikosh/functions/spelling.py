"""Rule-based spelling of Hindi words: label, confidence and reason, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vanikosh.functions import lexicon as L
from vanikosh.functions.text import U, WHITE, alternatives, bind, nfc, word_at

_C, _V, _S = f"[{L.CONSONANTS}]", f"[{L.VOWEL_LETTERS}]", f"[{L.VOWEL_SIGNS}]"
_NASALS = [L.ANUSVARA, L.CHANDRABINDU]
_DIACRITICS = [*_NASALS, L.VISARGA, L.NUKTA]
_DEVA = rf"[{U}0900-{U}097f]"
_FOREIGN = rf"[^{U}0900-{U}097f0-9'–-]"
_SIGNS = list(L.VOWEL_SIGNS)
_LETTERS = list(L.CONSONANTS)
#: Matches exactly the words that have a placement issue.
_MISPLACED = "|".join(
    (
        rf"^(?:{_S}|[{''.join(_NASALS)}])", rf"[{L.VOWEL_SIGNS}{''.join(_NASALS)}{L.VISARGA}]{_S}", f"{L.HALANT}$",
        f"[^{L.CONSONANTS}]{L.HALANT}", f"{L.ANUSVARA}{L.ANUSVARA}", f"{L.VISARGA}[^{L.CONSONANTS}]",
    )
)


def placement_issues(word: Column) -> Column:
    """Signs of a word that stand where they can't, as codes with 0-based positions, in order of position."""
    n = F.length(word)
    chars = F.split(word, "")

    def at(i: Column) -> Column:
        c, before, after = word_at(chars, i), word_at(chars, i - 1), word_at(chars, i + 1)
        first = i == 0
        sign, halant, nasal = c.isin(_SIGNS), c == L.HALANT, c.isin(_NASALS)
        rules = (
            ("sign_at_start", sign & first),
            ("sign_after_sign", sign & ~first & before.isin(_SIGNS)),
            ("sign_after_diacritic", sign & ~first & before.isin([*_NASALS, L.VISARGA])),
            ("halant_at_end", halant & (i == n - 1)),
            ("halant_after_non_consonant", halant & ~first & ~before.isin(_LETTERS)),
            ("halant_after_halant", halant & ~first & (before == L.HALANT)),
            ("nasal_at_start", nasal & first),
            ("anusvara_doubled", (c == L.ANUSVARA) & ~first & (before == L.ANUSVARA)),
            ("visarga_before_non_consonant", (c == L.VISARGA) & (i < n - 1) & ~after.isin(_LETTERS)),
        )
        found = F.array(*[F.when(test, F.concat(F.lit(code + "@"), i.cast("string"))) for code, test in rules])
        return F.filter(found, lambda x: x.isNotNull())

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at))).otherwise(F.array().cast("array<string>"))


def classify(word: Column) -> Column:
    """``struct(label, confidence, reason)`` of a word; the first rule that holds decides. Null counts as empty."""
    return bind(nfc(F.coalesce(F.regexp_replace(word, rf"^[{WHITE}]+|[{WHITE}]+$", ""), F.lit(""))), _decide)


def _decide(w: Column) -> Column:
    n = F.length(w)
    deva, digit = w.rlike(_DEVA), w.rlike(r"(?U)\d")
    foreign = F.regexp_extract(w, f"({_FOREIGN})", 1)
    triple = F.regexp_extract(w, rf"({_C})\1\1", 1)
    first, second = F.substring(w, 1, 1), F.substring(w, 2, 1)

    def result(label: str, confidence: str, reason) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    good, bad = (lambda c, r: result("correct", c, r)), (lambda c, r: result("incorrect", c, r))
    hexed = F.lpad(F.hex(F.ascii(foreign)), 4, "0")
    strange = F.concat(F.lit("foreign_character:U+"), F.when(F.length(F.hex(F.ascii(foreign))) > 4, F.hex(F.ascii(foreign))).otherwise(hexed), F.lit("@"), (F.position(foreign, w) - 1).cast("string"))
    return (
        F.when(w == "", bad("high", "empty"))
        .when(w.rlike("[A-Za-z]") & ~deva, bad("high", "latin_script"))
        .when(digit & ~deva, bad("high", "digits"))
        .when(w.isin(L.SPELLING_LOANWORDS), good("high", "loanword"))
        .when(w.contains(L.LONE_VOWEL), good("high", "english_vowel"))
        .when(n > L.LONGEST, bad("high", F.concat(F.lit("too_long:"), n.cast("string"))))
        .when((n == 1) & (w.rlike(_V) | w.isin(list(L.VALID_SINGLES))), good("high", "single_letter_word"))
        .when((n == 1) & w.isin(_LETTERS), bad("medium", "bare_consonant"))
        .when((n == 1) & w.isin([*_SIGNS, L.HALANT, L.AVAGRAHA, *_DIACRITICS]), bad("high", "lone_sign"))
        .when(n == 1, bad("medium", "unknown_character"))
        .when(foreign != "", bad("high", strange))
        .when(w.rlike(_MISPLACED), bad("high", F.concat(F.lit("placement:"), F.array_join(F.slice(placement_issues(w), 1, 2), "; "))))
        .when(~w.rlike(rf"{_V}|{_S}") & (n <= 3) & w.rlike(rf"^[{L.CONSONANTS}{L.HALANT}{''.join(_DIACRITICS)}]+$"), bad("medium", "no_vowel_short"))
        .when(~w.rlike(rf"{_V}|{_S}"), bad("high", "no_vowel"))
        .when(triple != "", bad("high", F.concat(F.lit("tripled_consonant:"), triple)))
        .when((n <= 2) & w.isin(L.COMMON_SHORT), good("high", "common_short_word"))
        .when((n <= 2) & first.isin(_LETTERS) & second.isin(_SIGNS), good("medium", "consonant_and_sign"))
        .when((n <= 2) & first.rlike(_V) & second.isin(_LETTERS), good("medium", "vowel_and_consonant"))
        .when(n <= 2, good("low", "unusual_short_word"))
        .when(n >= L.LONG, good("low", F.concat(F.lit("long:"), n.cast("string"))))
        .when(w.rlike(rf"^(?:{alternatives(L.CLUSTERS)})"), good("medium", "loan_cluster"))
        .when(digit & deva, good("medium", "digits_and_letters"))
        .otherwise(good("high", "regular"))
    )
