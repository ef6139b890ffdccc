"""One consistent form for texts that look the same (problem 1).

``canonical`` brings a text to compatibility-normalised composed form with
white space mapped and collapsed, default-ignorable characters removed and
look-alike letters replaced; letter case is kept unless asked for, because a
reader can see it. Two texts that a reader cannot tell apart get one form and
texts that differ visibly keep different forms.

Deviation from plain NFKC: superscripts, subscripts, circled or squared
characters and fractions stay as they are, since they look different.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanikosh.operators.stage import stage
from vanikosh.session import ship_package

# --- fixed values -----------------------------------------------------------

#: Code points a reader sees as a blank.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u2800\u3000"

#: Default_Ignorable_Code_Point of the Unicode character database, as ranges.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

#: Letters that are drawn like a Latin letter, by script; and hyphens that are drawn alike.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w",
    "х": "x", "у": "y", "ү": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "Ӏ": "I",
}
GREEK = {
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
ARMENIAN = {"օ": "o", "Օ": "O", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q"}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
LISU = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: Latin letters with another code point, and hyphens: the same in any word.
DRAWN_ALIKE = {"ɡ": "g", "ɑ": "a", "ⅼ": "l", "‐": "-", "‑": "-", "−": "-"}

#: Sequences of Indic vowel letters and signs that are drawn like one character.
SEQUENCES = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अॅ": "ॲ", "आे": "ओ", "आै": "औ", "आॅ": "ऑ", "एे": "ऐ", "एॅ": "ऍ",
    "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "অা": "আ", "॥": "।।",
}

# --- tables derived from them -------------------------------------------------

_CONTROL = [c for c in range(0xA0) if unicodedata.category(chr(c)) == "Cc" and chr(c) not in SPACES]
_DROP_RE = re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in IGNORABLE) + re.escape("".join(map(chr, _CONTROL))) + "]+")
_SPACE_RE = re.compile("[" + re.escape(SPACES) + "]+")
_ALIKE_RE = re.compile("[" + re.escape("".join(DRAWN_ALIKE)) + "]")
#: For each script its letters by their Latin twins, and the Latin twins by its letters.
_TWINS = [(table, {latin: own for own, latin in reversed(table.items())}) for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU)]
_SCRIPT_OF = re.compile("([\u0400-\u052f])|([\u0370-\u03ff\u1f00-\u1fff])|([\u0531-\u0587])|([\u13a0-\u13fd\uab70-\uabbf])|([\ua4d0-\ua4ff])")
_MIXED_RE = re.compile("[\\w\u0300-\u036f]*[\u0370-\u0587\u13a0-\u13fd\u1f00-\u1fff\ua4d0-\ua4ff\uab70-\uabbf][\\w\u0300-\u036f]*")
_LATIN_TWINS = frozenset(latin for table, _ in _TWINS for latin in table.values())


def _indic() -> tuple[str, dict[str, str]]:
    """Letters and marks of the Indic blocks as the content of a class, and per letter the visarga of its script, if drawn like a colon."""
    letters, visarga = [], {}
    for block in range(0x900, 0xE00, 0x80):
        own = [chr(c) for c in range(block, block + 0x80) if unicodedata.category(chr(c))[0] in "LM"]
        sign = [c for c in own if unicodedata.name(c, "").endswith("SIGN VISARGA") and block != 0xB80]  # the Tamil one is three dots
        letters += own
        visarga.update(dict.fromkeys(own, sign[0]) if sign else {})
    ends = [i for i, c in enumerate(letters) if i == 0 or ord(c) != ord(letters[i - 1]) + 1] + [len(letters)]
    return "".join(f"{letters[a]}-{letters[b - 1]}" for a, b in zip(ends, ends[1:])), visarga


_INDIC, _VISARGA = _indic()
VISARGAS = "".join(sorted(set(_VISARGA.values())))
_SEQ = "|".join(SEQUENCES)
_SEQ_RE = re.compile(_SEQ)
#: Bars and dandas: at the end of a sentence of an Indic script, or right at the end of a word or number.
_BARS_RE = re.compile(rf"([{_INDIC}][\"'”’)\]?!,.]* ?)([|।]+)|(?<=[^\W_])([|।]+)(?= |$)")
_COLON_RE = re.compile(rf"([{_INDIC}]):(?=([{_INDIC}]))")

#: Characters of texts that need no work, unless they stand in one of the pairs below.
_USUAL = " -~\u0900-\u0957\u0960-\u0964\u0966-\u097f\u0980-\u09db\u09de\u09e0-\u09ff"
#: Pairs that may be a sequence drawn like one character, compose, or stand in no canonical order.
_PAIRS = (
    r"[\u0905\u0906\u090f\u093e][\u093e\u0945\u0947-\u0949\u094b\u094c]|\u0985\u09be"
    r"|[\u0928\u0930\u0933\u094d]\u093c|\u093c[\u0900-\u0903\u093e-\u094d]*\u093c|\u09c7[\u09be\u09d7]|\u09cd\u09bc"
)
#: Matches every text that may not be in canonical form yet; the same test runs in the JVM and in Python. Texts it
#: does not match hold only ASCII, Devanagari and Bengali characters that are already composed and single-spaced.
ODD_PATTERN = rf"[^{_USUAL}]|{_PAIRS}|  |^ | $|:(?<=[{_INDIC}]:)|\||।(?<![{_INDIC}।]।)"
#: Scripts whose composed letters may hold a look-alike.
_BICAMERAL_RE = re.compile("[\u0370-\u058f\u1f00-\u1fff]")
_STRANGE_RE, _PAIRS_RE = re.compile(f"[^{_USUAL}]"), re.compile(_PAIRS)
_MARKS_RE = re.compile(rf"[{_INDIC}]:|\||\u0964(?<![{_INDIC}\u0964]\u0964)")


def _is_odd(text: str) -> bool:
    return bool(
        _STRANGE_RE.search(text)
        or _PAIRS_RE.search(text)
        or ((":" in text or "|" in text or "\u0964" in text) and _MARKS_RE.search(text))
        or "  " in text
        or text[:1] == " "
        or text[-1:] == " "
    )


_STYLED_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")


@lru_cache(maxsize=1)
def _styled() -> re.Pattern:
    """Characters whose compatibility mapping would change their look."""
    blocks = (range(0xA0, 0xA700), range(0x10780, 0x107C0), range(0x1E030, 0x1E070), range(0x1F100, 0x1F300))
    found = [chr(c) for block in blocks for c in block if unicodedata.decomposition(chr(c)).startswith(_STYLED_TAGS)]
    return re.compile("([" + re.escape("".join(found)) + "]+)")


def _clean(text: str) -> str:
    """Without ignorable characters, and with one blank for any white space."""
    return _SPACE_RE.sub(" ", _DROP_RE.sub("", text))


def _decompose(text: str) -> str:
    parts = _styled().split(text)
    if len(parts) == 1:
        return unicodedata.normalize("NFKD", text)
    return "".join(p if i % 2 else unicodedata.normalize("NFKD", p) for i, p in enumerate(parts))


def one_script(word: str) -> str:
    """A word with look-alike letters of several scripts in one of them: that of its other letters; Latin if it has none.

    So a Latin word with a few strange letters becomes Latin, and a Russian or Greek word stays what it is.
    """
    own = {m.lastindex - 1 for c in word if (m := _SCRIPT_OF.match(c)) and c not in _TWINS[m.lastindex - 1][0]}
    latin = any(c.isalpha() and c not in _LATIN_TWINS and unicodedata.name(c, "").startswith("LATIN") for c in word)
    if latin or not own:
        return "".join(next((table[c] for table, _ in _TWINS if c in table), c) for c in word)
    if len(own) > 1:
        return word
    i = own.pop()
    back = _TWINS[i][1]
    latin_of = lambda c: next((table[c] for j, (table, _) in enumerate(_TWINS) if j != i and c in table), c)
    return "".join(back.get(latin_of(c), c) if c not in _TWINS[i][0] else c for c in word)


def _bars(m: re.Match) -> str:
    return (m[1] or "") + "\u0964" * len(m[2] or m[3])


def _visarga(m: re.Match) -> str:
    """A colon between two letters of a script is its visarga."""
    sign = _VISARGA.get(m[1])
    return m[1] + (sign if sign and _VISARGA.get(m[2]) == sign else ":")


def canonical(text: str | None, case: str | None = None) -> str | None:
    """The consistent form of one text; null stays null and a blank text becomes empty.

    ``case``: None keeps it, ``"fold"`` applies full case folding, ``"lower"`` lower case.
    """
    if text is None:
        return None
    if _is_odd(text):
        if text.isascii():
            text = _clean(text)
        else:
            if not unicodedata.is_normalized("NFKC", text) or _BICAMERAL_RE.search(text):
                text = _decompose(text)
            text = _clean(text)  # before composition, which an invisible character would prevent
            text = _ALIKE_RE.sub(lambda m: DRAWN_ALIKE[m[0]], text)
            text = _MIXED_RE.sub(lambda m: one_script(m[0]), text)
            text = unicodedata.normalize("NFC", text)
            text = _SEQ_RE.sub(lambda m: SEQUENCES[m[0]], text)
        text = text.strip(" ")
        if "|" in text or "\u0964" in text:
            text = _BARS_RE.sub(_bars, text)
        if ":" in text:
            text = _COLON_RE.sub(_visarga, text)
    if case == "fold":
        text = unicodedata.normalize("NFC", text.casefold())
    elif case == "lower":
        text = unicodedata.normalize("NFC", text.lower())
    return text


def canonical_series(values: pd.Series, case: str | None = None) -> pd.Series:
    """``canonical`` of a column, worked out once per distinct value."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    forms = pd.Series([canonical(x, case) for x in distinct], dtype=object)
    out = forms.reindex(codes)
    out.index = values.index
    return out.where(codes >= 0, None)


@F.pandas_udf(T.StringType())
def _form(values: pd.Series) -> pd.Series:
    return canonical_series(values)


@F.pandas_udf(T.StringType())
def _form_fold(values: pd.Series) -> pd.Series:
    return canonical_series(values, "fold")


def canonical_column(column: Column, fold_case: bool = False) -> Column:
    """``canonical`` as a column. Python sees only values that the JVM pattern cannot prove to be in form already."""
    ship_package()
    odd = F.when(column.rlike(ODD_PATTERN), column)
    # of the letters that are not odd, full folding changes ASCII only
    return F.coalesce(_form_fold(odd), F.lower(column)) if fold_case else F.coalesce(_form(odd), column)


#: The fields of problem 1: table, field, id and the group within which rows are compared.
FIELDS = (("rid_transcription", "text", "seg_id", "rid"), ("word_result", "word", "ord", "sheet_id"), ("predictions", "reference", "id", "rid"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, field, row_id, group in FIELDS:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
            F.lit(table).alias("tbl"), F.col(group).cast("string").alias("grp"), F.col(row_id).cast("bigint").alias("id"), F.col(field).alias("raw")
        )
        out = df if out is None else out.unionByName(df)
    return out


def canonical_values(spark: SparkSession, sf_dir: str, fold_case: bool = True) -> DataFrame:
    """``(tbl, id, form)``: the consistent form of every value of the three fields, nulls included."""
    return _values(spark, sf_dir).select("tbl", "id", canonical_column(F.col("raw"), fold_case).alias("form"))


def _keyed(values: DataFrame) -> DataFrame:
    """``tbl, grp, id``, hashes of what a text looks like (``k``) and of its characters (``v``), and whether it may be out of form, staged."""
    ship_package(values.sparkSession)
    rows = values.where(F.col("raw").isNotNull() & F.col("grp").isNotNull()).withColumn("odd", F.col("raw").rlike(ODD_PATTERN))
    # some look-alikes have no common canonical form: word-final visarga and colon, danda and bar between words
    form = F.translate(F.coalesce(_form(F.when(F.col("odd"), F.col("raw"))), F.col("raw")), VISARGAS + "\u0964", ":" * len(VISARGAS) + "|")
    keyed = rows.withColumn("form", form).where(F.trim("form") != "")
    return stage(keyed.select("tbl", "grp", "id", F.xxhash64("form").alias("k"), F.xxhash64("raw", F.lit(7)).alias("v"), "odd"), "p1-keys")


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """Pairs ``(tbl, id_a, id_b)``, ``id_a < id_b``, of rows of one group whose texts look the same and differ.

    ``values``: ``tbl, grp, id, raw``. Rows with a null group or with a null, empty or blank text take no part. Every
    pair has a row that is not in canonical form, so the distinct forms of those few rows are one side of the join; the
    other side is all rows, as two hashes of 64 bits and an id. Rows that are equal as strings are no pair, and a form
    that comes again and again is compared once: what comes out of either join is at most the pairs themselves.
    """
    keyed = _keyed(values)
    odd = keyed.where("odd").drop("odd")
    forms = odd.groupBy("tbl", "grp", "k", "v").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    others = keyed.withColumnsRenamed({"id": "id_2", "v": "v_2", "odd": "odd_2"})
    met = forms.join(others, ["tbl", "grp", "k"]).where((F.col("v") != F.col("v_2")) & (~F.col("odd_2") | (F.col("v") < F.col("v_2"))))
    return met.join(odd, ["tbl", "grp", "k", "v"]).select("tbl", F.least("id", "id_2").alias("id_a"), F.greatest("id", "id_2").alias("id_b"))


def lookalike_classes(values: DataFrame) -> DataFrame:
    """``tbl, grp, class, rows, forms, pairs, first_id``: one row per set of rows of a group that look the same, with the number of its
    rows, of their different strings and of the pairs ``lookalike_pairs`` would give, so that no class need be expanded."""
    each = _keyed(values).groupBy("tbl", "grp", "k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    rows = F.sum("n")
    pairs = ((rows * rows - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint")
    return each.groupBy("tbl", "grp", F.col("k").alias("class")).agg(rows.alias("rows"), F.count(F.lit(1)).alias("forms"), pairs.alias("pairs"), F.min("first").alias("first_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_values(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of rows that look the same but are not all the same string."""
    return lookalike_classes(_values(spark, sf_dir)).where("forms > 1")


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_canonical": p1_canonical}
