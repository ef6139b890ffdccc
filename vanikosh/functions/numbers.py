"""Hindi number words to digits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vanikosh.functions import lexicon as L
from vanikosh.functions.text import WHITE, alternatives, bind, tokens

UNITS = {w: i for i, words in enumerate(L.UNIT_WORDS) for w in words.split()}
_ANY = alternatives([*UNITS, *L.MULTIPLIERS])
#: A run of tokens that are number words, as a whole run.
RUN = rf"(?<![^{WHITE}])(?:{_ANY})(?:[{WHITE}]+(?:{_ANY}))*(?![^{WHITE}])"
_HEAD, _TAIL = L.IDIOM_HYPHEN
IDIOM = "|".join(
    [rf"(?:{alternatives(_HEAD)})[{WHITE}]*[-–][{WHITE}]*(?:{alternatives(_TAIL)})"]
    + [rf"(?:{alternatives(a)})[{WHITE}]+(?:{alternatives(b)})" for a, b in L.IDIOM_PAIRS]
)
BEFORE, AFTER = 10, 20

_BIG = "decimal(38,0)"
_LOG = "array<struct<original:string,converted:string,action:string>>"


def _values(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def words_to_int(words: Column) -> Column:
    """Value of a run of number words as a decimal; null beyond 38 digits.

    Units add up, a hundred multiplies what stands before it, larger multipliers close a group.
    """
    unit, times = _values(UNITS), _values(L.MULTIPLIERS)
    zero = F.lit(0).cast(_BIG)

    def step(acc: Column, w: Column) -> Column:
        held = F.when(acc["now"] == 0, F.lit(1).cast(_BIG)).otherwise(acc["now"])
        by = F.element_at(times, w).cast(_BIG)
        product = F.try_multiply(held, by).cast(_BIG)
        return F.when(F.element_at(unit, w).isNotNull(), F.struct(acc["sum"].alias("sum"), F.try_add(acc["now"], F.element_at(unit, w).cast(_BIG)).cast(_BIG).alias("now"))).when(
            by >= 1000, F.struct(F.try_add(acc["sum"], product).cast(_BIG).alias("sum"), zero.alias("now"))
        ).otherwise(F.struct(acc["sum"].alias("sum"), product.alias("now")))

    return F.aggregate(words, F.struct(zero.alias("sum"), zero.alias("now")), step, lambda a: F.try_add(a["sum"], a["now"]).cast(_BIG))


def normalize_numbers(text: Column) -> Column:
    """``struct(text, changes)``: runs of number words as digits, from right to left; a run near an idiom is kept and logged.

    Null stays null. A number too large for 38 digits keeps its words.
    """
    untouched = F.struct(text.alias("text"), F.array().cast(_LOG).alias("changes"))
    pieces = F.struct(F.split(text, RUN, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("spans"))
    return F.when(text.isNull(), None).when(text.rlike(RUN), bind(pieces, lambda p: _folded(text, p["gaps"], p["spans"]))).otherwise(untouched)


def _folded(text: Column, gaps: Column, spans: Column) -> Column:
    n = F.size(spans)
    lengths = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))

    def step(acc: Column, k: Column) -> Column:
        span, gap = F.element_at(spans, k), F.element_at(gaps, k)
        start = lengths(F.slice(gaps, F.lit(1), k)) + F.when(k > 1, lengths(F.slice(spans, F.lit(1), k - 1))).otherwise(0)
        left = F.substring(text, F.greatest(F.lit(1), start - (BEFORE - 1)), F.least(F.lit(BEFORE), start))
        window = F.concat(left, span, F.substring(acc["right"], 1, AFTER))
        number = F.when(~window.rlike(IDIOM), words_to_int(tokens(span)).cast("string"))

        def write(number: Column) -> Column:
            out = F.coalesce(number, span)
            entry = F.struct(span.alias("original"), out.alias("converted"), F.when(number.isNull(), "KEPT (idiom/phrase)").otherwise("CONVERTED").alias("action"))
            return F.struct(F.concat(gap, out, acc["right"]).alias("right"), F.concat(F.array(entry), acc["changes"]).cast(_LOG).alias("changes"))

        return bind(number, write)

    start = F.struct(F.element_at(gaps, -1).alias("right"), F.array().cast(_LOG).alias("changes"))
    return F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), start, step, lambda a: F.struct(a["right"].alias("text"), a["changes"].alias("changes")))


def digit_table() -> dict[str, tuple[str, ...]]:
    """Words that stand for a string of digits, as far as they may be exchanged."""
    return {str(i): tuple(L.UNIT_WORDS[i].split()) for i in L.DIGIT_NUMBERS} | L.DIGIT_MULTIPLIERS


def numeric_equivalents(token: Column) -> Column:
    """The token, its digits if it is a number word, and the words of a string of digits; one step, no chains."""
    table = digit_table()
    words = F.create_map(*[x for d, ws in table.items() for x in (F.lit(d), F.array(*map(F.lit, ws)))])
    digits = _values({w: d for d, ws in table.items() for w in ws})
    none = F.array().cast("array<string>")
    digit = F.element_at(digits, token)
    return F.array_union(F.array_union(F.array(token), F.when(digit.isNotNull(), F.array(digit)).otherwise(none)), F.coalesce(F.element_at(words, token), none))
