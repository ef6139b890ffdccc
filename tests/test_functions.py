"""Column functions against expected values and brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vanikosh.functions import align, codeswitch, errors, lexicon, numbers, spelling, text

NUMBERS = {
    "शाम मतलब छै सात में इतना अंधेरा हो गया": ("शाम मतलब छै 7 में इतना अंधेरा हो गया", ["CONVERTED"]),
    "छः सात आठ किलोमीटर में नौ बजे है": ("21 किलोमीटर में 9 बजे है", ["CONVERTED", "CONVERTED"]),
    "हमारे पास एक हज़ार पाँच सौ रुपये थे": ("हमारे पास 1500 रुपये थे", ["CONVERTED"]),
    "बस दो-चार बातें करनी थीं उनसे": ("बस दो-चार बातें करनी थीं उनसे", []),
    "एक बात बताओ मुझे": ("एक बात बताओ मुझे", ["KEPT (idiom/phrase)"]),
    "यह तो दो नम्बर का काम है": ("यह तो दो नम्बर का काम है", ["KEPT (idiom/phrase)"]),
    "मैं सौ फीसद सहमत हूँ": ("मैं 100 फीसद सहमत हूँ", ["CONVERTED"]),
    "दस, लोग": ("दस, लोग", []),
    "दस लोग एक बात": ("दस लोग एक बात", ["KEPT (idiom/phrase)"] * 2),
    "दो सौ तीन सौ": ("20300", ["CONVERTED"]),
    "दस लाख करोड़": ("11000000", ["CONVERTED"]),
    "शून्य सौ": ("100", ["CONVERTED"]),
    "सौ " * 10: ("1" + "0" * 20 + " ", ["CONVERTED"]),
    "सौ " * 20: ("सौ " * 20, ["KEPT (idiom/phrase)"]),  # beyond 38 digits
    "  दस  बीस \tलोग": ("  30 \tलोग", ["CONVERTED"]),
    "": ("", []),
}


def test_numbers(evaluate):
    got = evaluate([*NUMBERS, None], numbers.normalize_numbers)
    assert got.pop() is None
    for (source, (expected, actions)), r in zip(NUMBERS.items(), got):
        assert (r.text, [c.action for c in r.changes]) == (expected, actions), source


def _numbers_by_hand(source: str) -> str:
    """The same in Python, from the pieces between white space."""
    known = {**numbers.UNITS, **lexicon.MULTIPLIERS}
    spans = list(re.finditer(r"(?<!\S)\S+(?!\S)", source))
    runs, at = [], 0
    while at < len(spans):
        end = at
        while end < len(spans) and spans[end][0] in known:
            end += 1
        if end > at:
            runs.append((spans[at].start(), spans[end - 1].end()))
        at = max(end, at + 1)
    out = source
    for a, b in reversed(runs):
        if re.search(numbers.IDIOM, out[max(0, a - 10) : b + 20]):
            continue
        total = now = 0
        for w in out[a:b].split():
            v = known[w]
            if w in numbers.UNITS:
                now += v
            elif v == 100:
                now = (now or 1) * 100
            else:
                total, now = total + (now or 1) * v, 0
        out = out[:a] + str(total + now) + out[b:]
    return out


def test_numbers_against_brute_force(evaluate):
    rng = random.Random(3)
    words = [*numbers.UNITS, *lexicon.MULTIPLIERS, "लोग", "बात", "तरफ", "नंबर", "और", "-", "दो-चार", "बजे,"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert [r.text for r in evaluate(texts, numbers.normalize_numbers)] == [_numbers_by_hand(t) for t in texts]


def test_number_normalisation_is_idempotent_on_digits(evaluate):
    assert [r.text for r in evaluate(["12 लोग 100", "७ दिन"], numbers.normalize_numbers)] == ["12 लोग 100", "७ दिन"]


TAGS = {
    "हमारा प्रोजेक्ट भी था कि जो जन जाती पाई जाती है उधर की एरिया में": [("प्रोजेक्ट", 1, "known_loanword", False), ("एरिया", 13, "known_loanword", False)],
    "हम वहाँ पहले एंटर किये थे": [],
    "पता है लेकिन जब लोग घूमने जाते हैं तो लाइट वगैरा लेकर जाने चाहिए": [("लाइट", 9, "known_loanword", False)],
    "हम ने मिस्टेक किए कि हम लाइट नहीं ले गए थे": [("मिस्टेक", 2, "known_loanword", False), ("लाइट", 6, "known_loanword", False)],
    "मेरा interview बहुत अच्छा गया और मुझे job मिल गई": [("interview", 1, "latin_script", False), ("job", 7, "latin_script", False)],
    "मैं स्कूल बस से आता हूँ": [("स्कूल", 1, "known_loanword", True), ("बस", 2, "known_loanword", True)],
    "प्रकार": [("प्रकार", 0, "phonological", False)],
    " , ": [],
    "": [],
}


def test_english_tags(evaluate):
    got = evaluate([*TAGS, None], codeswitch.english_tags)
    assert [[tuple(t) for t in r] for r in got[:-1]] == list(TAGS.values())
    assert not got[-1]


def test_tagged_text_keeps_punctuation_outside(evaluate):
    assert evaluate(['वह  "job," है', "क ,, ख"], codeswitch.tagged_text) == ['वह "[EN]job[/EN]," है', "क ,, ख"]


SPELLING = {
    "job": ("incorrect", "high", "latin_script"), "123": ("incorrect", "high", "digits"), "प्रोजेक्ट": ("correct", "high", "loanword"),
    "ऑनबोर्ड": ("correct", "high", "english_vowel"), "का" * 18: ("incorrect", "high", "too_long:36"), "अ": ("correct", "high", "single_letter_word"),
    "ख": ("incorrect", "medium", "bare_consonant"), "ा": ("incorrect", "high", "lone_sign"), "१": ("incorrect", "medium", "unknown_character"),
    "काjob": ("incorrect", "high", "foreign_character:U+006A@2"), "ाम": ("incorrect", "high", "placement:sign_at_start@0"),
    "काा": ("incorrect", "high", "placement:sign_after_sign@2"), "कंा": ("incorrect", "high", "placement:sign_after_diacritic@2"),
    "काम्": ("incorrect", "high", "placement:halant_at_end@3"), "घर": ("incorrect", "medium", "no_vowel_short"), "सड़कपर": ("incorrect", "high", "no_vowel"),
    "बॉस": ("incorrect", "high", "no_vowel"), "ककका": ("incorrect", "high", "tripled_consonant:क"), "का": ("correct", "high", "common_short_word"),
    "चा": ("correct", "medium", "consonant_and_sign"), "आज": ("correct", "medium", "vowel_and_consonant"), "ईई": ("correct", "low", "unusual_short_word"),
    "किताबकिताबकिताबकिता": ("correct", "low", "long:19"), "प्रकार": ("correct", "medium", "loan_cluster"), "21वीं": ("correct", "medium", "digits_and_letters"),
    "अब": ("correct", "high", "common_short_word"), "।": ("correct", "high", "single_letter_word"), ".": ("incorrect", "medium", "unknown_character"),
    "किताब": ("correct", "high", "regular"), "": ("incorrect", "high", "empty"), "   ": ("incorrect", "high", "empty"),
    "😀": ("incorrect", "medium", "unknown_character"), "का😀": ("incorrect", "high", "foreign_character:U+1F600@2"),
}


def test_spelling(evaluate):
    got = evaluate([*SPELLING, None], spelling.classify)
    assert [tuple(r) for r in got] == [*SPELLING.values(), ("incorrect", "high", "empty")]


def test_misplaced_pattern_is_the_rule_list(evaluate):
    rng = random.Random(5)
    letters = "कर" + "ाि" + "ंँः" + "्" + "़" + "अ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    issues = evaluate(words, spelling.placement_issues)
    assert [bool(i) for i in issues] == [bool(re.search(spelling._MISPLACED, w)) for w in words]


REPAIRS = {
    "लड़के ने कहा": "लड़का ने कहा", "औरतें गए": "औरतें गए", "औरतें थे": "औरतें थीं", "उसने मुझ से बताया": "उसने मुझ को बताया",
    "घर में जाता": "घर से जाता", "घर से रहता": "घर में रहता", "किताब में दिया": "किताब में दिया", "": "",
}


def test_repair(evaluate):
    assert evaluate(list(REPAIRS), errors.repair) == list(REPAIRS.values())


NORMAL = {"abc हिंदी": "हिंदी", "राम\tगया": "रामगया", "राम  गया।": "राम गया।", "रा" + chr(0x200D) + "म": "राम", "ल" + chr(0x95C) + "का": "लड़का", "": ""}


def test_normalized(evaluate):
    assert evaluate([*NORMAL, None], text.normalized) == [unicodedata.normalize("NFC", v) for v in NORMAL.values()] + [""]


def test_composed_is_nfc(evaluate):
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x900, 0x980)] + [chr(0x93C), chr(0x94D)] * 8
    words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(500)]
    words += ["".join(rng.choice("कन" + "".join(text._CLASSES)) for _ in range(7)) for _ in range(500)]
    words += ["न" + x for x in (chr(0x94D) * 2 + chr(0x93C), chr(0x951) + chr(0x93C), chr(0x951) + chr(0x952))]
    assert evaluate(words, text.composed) == [unicodedata.normalize("NFC", w) for w in words]


def test_nfc_of_any_script(evaluate):
    words = ["cafe" + chr(0x301), "ক" + chr(0x9C7) + chr(0x9BE), "ক" + chr(0x9BC), "가", "न" + chr(0x93C), "", "a" + chr(0x300) + chr(0x93C), chr(0x2000) + "a" + chr(0x2001), "é" + chr(0x301), "ｈी" + chr(0xFEFF)]
    known = [c for c in map(chr, range(0x20, 0x10000)) if re.fullmatch(text._KNOWN.replace(text.U, "\\u"), c) and not 0x900 <= ord(c) < 0x980]
    assert all(unicodedata.normalize("NFC", c) == c for c in known) and not any(unicodedata.combining(c) for c in known if not 0x1CD0 <= ord(c) < 0x1D00)
    assert evaluate([*words, None], text.nfc) == [unicodedata.normalize("NFC", w) for w in words] + [None]


def test_tokens_split_at_unicode_white_space(evaluate):
    assert evaluate(["a b　c\x1dd  e​f", " ", None], text.tokens) == [["a", "b", "c", "d", "e​f"], [], None]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment(spark):
    rng = random.Random(7)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 8))], [rng.choice("abcd") for _ in range(rng.randint(0, 8))]) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, r array<string>, h array<string>")
    r, h = F.col("r"), F.col("h")
    rows = df.select("i", align.token_distance(r, h).alias("d"), align.word_error_rate(r, h).alias("w"), align.align_tokens(r, h).alias("p"), align.edit_operations(r, h).alias("o")).orderBy("i").collect()
    for (a, b), row in zip(pairs, rows):
        d = _distance(a, b)
        assert row.d == d
        assert row.w == (d / len(a) if a else float(bool(b)))
        assert [p.ref for p in row.p if p.ref is not None] == a
        assert [p.hyp for p in row.p if p.hyp is not None] == b
        assert len(row.o) == (d if a else 0)


def test_distance_of_long_texts_and_nulls(spark):
    many = [str(i) for i in range(25_000)]
    df = spark.createDataFrame([(1, many[:200], many[100:200]), (2, None, ["a"])], "i int, r array<string>, h array<string>")
    assert [x.d for x in df.select("i", align.token_distance(F.col("r"), F.col("h")).alias("d")).orderBy("i").collect()] == [100, None]
    assert int(align._table(*align._codes(many[:50], many[10:50]), 0, 1, 1)[-1, -1]) == 10


@pytest.mark.parametrize(
    ("op", "ref", "hyp", "expected"),
    [
        ("S", "दस", "10", "NUMERIC_MISMATCH"), ("I", "", "है", "INSERTION"), ("D", "है", "", "DELETION_FUNC"), ("D", "किताब", "", "DELETION_CONTENT"),
        ("S", "में", "से", "POSTPOSITION_ERROR"), ("S", "जाता", "जाती", "GRAM_INFLECTION"), ("S", "किताबघर", "कितवघरा", "PHONETIC_CONF"),
        ("S", "जनजाति", "जाति", "COMPOUND_SPLIT"), ("S", "आम", "इमली", "OTHER_SUBST"),
    ],
)
def test_category(spark, op, ref, hyp, expected):
    df = spark.createDataFrame([(op, ref, hyp)], "o string, r string, h string")
    assert df.select(errors.category(F.col("o"), F.col("r"), F.col("h"))).first()[0] == expected


def test_variants_and_equivalents(evaluate):
    assert [sorted(x) for x in evaluate(["यहाँ", "हज़ार"], errors.spelling_variants)] == [sorted(["यहाँ", "यहां"]), sorted(["हज़ार", "हजार"])]
    assert [sorted(x) for x in evaluate(["6", "छह", "आम", ""], numbers.numeric_equivalents)] == [sorted(["6", "छह", "छः"]), sorted(["छह", "6"]), ["आम"], [""]]
