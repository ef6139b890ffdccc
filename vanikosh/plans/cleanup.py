"""Numbers, English words and spelling over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vanikosh.functions import lexicon as L
from vanikosh.functions.codeswitch import cleanup, english_tags, is_latin
from vanikosh.functions.numbers import UNITS, normalize_numbers, words_to_int
from vanikosh.functions.spelling import classify
from vanikosh.functions.text import tokens
from vanikosh.operators.stage import spread
from vanikosh.plans.tables import WHITE_SQL, in_sql, read, tokens_sql


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "rid_transcription", "seg_id", "text").where("text is not null"))


def number_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("seg_id", normalize_numbers(F.col("text"))["text"].alias("normed"))


def number_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each run of number words was converted or kept."""
    changes = _texts(spark, sf_dir).select(F.explode(normalize_numbers(F.col("text"))["changes"]).alias("c")).select("c.*")
    return changes.groupBy("original", "converted", "action").agg(F.count(F.lit(1)).alias("n"))


def idiom_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_changes(spark, sf_dir).where("action like 'KEPT%'").select("original", "n")


def num_words_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of every run of number words, whatever stands around it."""
    return number_changes(spark, sf_dir).select("original").distinct().select(F.array_join(tokens(F.col("original")), " ").alias("words")).distinct().select("words", words_to_int(tokens(F.col("words"))).cast("bigint").alias("value"))


def english_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English words of every segment with their places."""
    return _texts(spark, sf_dir).select("seg_id", F.explode(english_tags(F.col("text"))).alias("t")).select("seg_id", "t.*")


def english_tag_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return english_tag(spark, sf_dir).groupBy("method", "nativised").agg(F.count(F.lit(1)).alias("tags"), F.countDistinct("word").alias("words"))


def latin_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens in Latin script of every segment that has some."""
    n = F.size(F.filter(tokens(F.col("text")), is_latin)).cast("bigint")
    return _texts(spark, sf_dir).select("seg_id", n.alias("n")).where("n > 0")


def english_tag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the delivered tags compare with ours: in both, only delivered, only found."""
    place = ["seg_id", "position"]
    given = read(spark, sf_dir, "english_word_tag", *place).distinct().withColumn("given", F.lit(True))
    found = english_tag(spark, sf_dir).select(*place).withColumn("found", F.lit(True))
    side = F.when(F.col("given").isNull(), "found").when(F.col("found").isNull(), "given").otherwise("both")
    return given.join(found, place, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def cleanup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return _texts(spark, sf_dir).select("seg_id", cleanup(F.col("text")).alias("c")).select("seg_id", c["normed"].alias("normed"), c["tagged"].alias("tagged"), F.size(c["num_changes"]).alias("changes"), F.size(c["en_tags"]).alias("tags"))


def spell_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, confidence and reason of every row."""
    rows = spread(read(spark, sf_dir, "word_result", "ord", "word"))
    return rows.select("ord", "word", classify(F.col("word")).alias("c")).select("ord", "word", "c.*")


def spell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell_classify(spark, sf_dir).select("ord", "label", "confidence")


def spell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and percentages by label, by confidence and in all, of the distinct words, in one pass."""
    words = read(spark, sf_dir, "word_result", "word").where("word is not null").distinct().select(classify(F.col("word")).alias("c")).select("c.label", "c.confidence")
    sets = words.groupingSets([[F.col("label")], [F.col("confidence")], []], F.col("label"), F.col("confidence")).agg(F.count(F.lit(1)).alias("n"))
    return sets.select("label", "confidence", "n", F.bround(100 * F.col("n") / F.max("n").over(Window.partitionBy()), 4).alias("share"))


def spell_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell_classify(spark, sf_dir).groupBy("label", "confidence", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def spell_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered classification against ours."""
    ours = read(spark, sf_dir, "word_result", "word", "classification").select("classification", classify(F.col("word")).alias("c"))
    return ours.groupBy("classification", F.col("c.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def low_conf_sample(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """At most ``k`` distinct words of low confidence; the order of their MD5 stands in for a random one."""
    words = read(spark, sf_dir, "word_result", "word").where("word is not null").distinct().select("word", classify(F.col("word")).alias("c"))
    return words.where("c.confidence = 'low'").orderBy(F.md5(F.col("word").cast("binary")), "word").limit(k).select("word", F.col("c.label").alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        number_normalize, number_changes, idiom_kept, num_words_to_int, english_tag, english_tag_method_counts, latin_tag, english_tag_agreement,
        cleanup_pipeline, spell_classify, spell_labels, spell_summary, spell_reason_counts, spell_agreement, low_conf_sample,
    )
}

_VALUES = ", ".join(f"('{w}', CAST({v} AS HUGEINT))" for w, v in {**UNITS, **L.MULTIPLIERS}.items())
_MARK = "[।,.!?;:\\-\"''()]"
_TAGS = f"""
t AS (SELECT seg_id, {tokens_sql('text')} AS w FROM rid_transcription WHERE text IS NOT NULL),
x AS (SELECT seg_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS position FROM t),
c AS (SELECT *, regexp_replace(token, '^{_MARK}+|{_MARK}+$', '', 'g') AS word FROM x),
m AS (SELECT seg_id, CAST(position AS INTEGER) AS position, word, token,
  CASE WHEN word = '' THEN NULL WHEN regexp_matches(word, '[A-Za-z]') AND NOT regexp_matches(word, '[\\x{{900}}-\\x{{97f}}]') THEN 'latin_script'
       WHEN word IN {in_sql(L.LOANWORDS)} THEN 'known_loanword'
       WHEN regexp_matches(word, '[\\x{{900}}-\\x{{97f}}]') AND length(word) >= 4 AND regexp_matches(word, '^({"|".join(L.ENGLISH_BEGINNINGS)})|[{L.ENGLISH_LETTERS}]') THEN 'phonological' END AS method FROM c),
g AS (SELECT seg_id, position, word, method, method = 'known_loanword' AND word IN {in_sql(L.NATIVISED)} AS nativised FROM m WHERE method IS NOT NULL)"""
_IDIOM_SQL = "|".join(
    [f"({'|'.join(L.IDIOM_HYPHEN[0])})WS*[-–]WS*({'|'.join(L.IDIOM_HYPHEN[1])})"] + [f"({'|'.join(a)})WS+({'|'.join(b)})" for a, b in L.IDIOM_PAIRS]
).replace("WS", WHITE_SQL)
#: Texts with their runs of number words rewritten, from the last run to the first; and what became of every run.
_REWRITTEN = f"""
v AS (SELECT * FROM (VALUES {_VALUES}) v(word, value)),
p0 AS (SELECT seg_id, text, string_split_regex(text, '{WHITE_SQL}') AS parts FROM rid_transcription WHERE text IS NOT NULL),
p1 AS (SELECT seg_id, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p0),
p2 AS (SELECT *, 1 + coalesce(sum(length(part) + 1) OVER (PARTITION BY seg_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY i) AS pos FROM p2 WHERE part <> ''),
p4 AS (SELECT p3.*, value, pos - row_number() OVER (PARTITION BY seg_id ORDER BY pos) AS island FROM p3 JOIN v ON word = part),
p5 AS (SELECT seg_id, text, min(place) AS s, max(place + length(part)) AS e, list(value ORDER BY pos) AS vs FROM p4 GROUP BY seg_id, text, island),
p6 AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY s DESC) AS k, list_reduce(list_transform(vs, lambda q: [q]), lambda a, q:
  CASE WHEN q[1] >= 1000 THEN [a[1] + CASE WHEN a[2] = 0 THEN 1 ELSE a[2] END * q[1], 0]
       WHEN q[1] = 100 THEN [a[1], CASE WHEN a[2] = 0 THEN 1 ELSE a[2] END * 100] ELSE [a[1], a[2] + q[1]] END, [CAST(0 AS HUGEINT), CAST(0 AS HUGEINT)]) AS r FROM p5),
p7 AS (SELECT seg_id, text, s, e, k, substr(text, CAST(s AS BIGINT), CAST(e - s AS BIGINT)) AS span, CAST(r[1] + r[2] AS VARCHAR) AS number FROM p6),
w AS (
  SELECT seg_id, text, s, k, span, number, substr(text, CAST(e AS BIGINT)) AS after FROM p7 WHERE k = 1
  UNION ALL
  SELECT p7.seg_id, p7.text, p7.s, p7.k, p7.span, p7.number, substr(p7.text, CAST(p7.e AS BIGINT), CAST(w.s - p7.e AS BIGINT)) ||
    CASE WHEN regexp_matches(substr(w.text, CAST(greatest(1, w.s - 10) AS BIGINT), CAST(least(10, w.s - 1) AS BIGINT)) || w.span || left(w.after, 20), '{_IDIOM_SQL}') THEN w.span ELSE w.number END || w.after
  FROM w JOIN p7 ON p7.seg_id = w.seg_id AND p7.k = w.k + 1),
y AS (SELECT *, regexp_matches(substr(text, CAST(greatest(1, s - 10) AS BIGINT), CAST(least(10, s - 1) AS BIGINT)) || span || left(after, 20), '{_IDIOM_SQL}') AS kept FROM w),
z AS (SELECT seg_id, left(text, CAST(s - 1 AS BIGINT)) || CASE WHEN kept THEN span ELSE number END || after AS normed
      FROM y QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY k DESC) = 1),
n AS (SELECT t.seg_id, coalesce(z.normed, t.text) AS normed FROM rid_transcription t LEFT JOIN z USING (seg_id) WHERE t.text IS NOT NULL)"""


def numbers_sql(texts: str) -> str:
    """``_REWRITTEN`` over another table of ``seg_id`` and ``text``."""
    return _REWRITTEN.replace("FROM rid_transcription WHERE", f"FROM {texts} WHERE").replace("FROM rid_transcription t ", f"FROM (SELECT * FROM {texts}) t ")


_CV, _VV, _SV = f"[{L.CONSONANTS}]", f"[{L.VOWEL_LETTERS}]", f"[{L.VOWEL_SIGNS}]"
_NASAL, _DIA = L.ANUSVARA + L.CHANDRABINDU, L.ANUSVARA + L.CHANDRABINDU + L.VISARGA + L.NUKTA
_HAS = lambda p: f"regexp_matches(w, '{p}')"
#: The check has short words and letters of its own, so that a slip in the operator's lists shows.
_SHORT_SQL = "('का','की','के','को','से','ने','ही','तो','भी','या','हो','है','था','थी','थे','जो','वो','इस','उस','कि','अब','जी','नो','वे','आप','ओह','हा','ना','रे','और','अरे')"
_SINGLE_SQL = "('अ','आ','इ','ई','उ','ऊ','ए','ऐ','ओ','औ','न','व','।','ह','य','त','क','स')"
_DEVA_SQL = _HAS(r"[\x{900}-\x{97f}]")
_DECIDED = f"""CASE
  WHEN w = '' THEN 'incorrect high empty'
  WHEN {_HAS('[A-Za-z]')} AND NOT {_DEVA_SQL} THEN 'incorrect high latin_script'
  WHEN {_HAS(chr(92) + 'p{Nd}')} AND NOT {_DEVA_SQL} THEN 'incorrect high digits'
  WHEN w IN {in_sql(L.SPELLING_LOANWORDS)} THEN 'correct high loanword'
  WHEN contains(w, '{L.LONE_VOWEL}') THEN 'correct high english_vowel'
  WHEN length(w) > 35 THEN 'incorrect high too_long'
  WHEN length(w) = 1 AND (w IN {_SINGLE_SQL} OR {_HAS(_VV)}) THEN 'correct high single_letter_word'
  WHEN length(w) = 1 AND {_HAS(_CV)} THEN 'incorrect medium bare_consonant'
  WHEN length(w) = 1 AND {_HAS(f'[{L.VOWEL_SIGNS}{L.HALANT}{L.AVAGRAHA}{_DIA}]')} THEN 'incorrect high lone_sign'
  WHEN length(w) = 1 THEN 'incorrect medium unknown_character'
  WHEN {_HAS(chr(91) + '^' + r"\x{900}-\x{97f}0-9''–-]")} THEN 'incorrect high foreign_character'
  WHEN {_HAS(f'^[{L.VOWEL_SIGNS}{_NASAL}]')} OR {_HAS(f'[{L.VOWEL_SIGNS}{_NASAL}{L.VISARGA}]{_SV}')} OR {_HAS(f'[^{L.CONSONANTS}]{L.HALANT}')} OR suffix(w, '{L.HALANT}')
    OR contains(w, '{L.ANUSVARA}{L.ANUSVARA}') OR {_HAS(f'{L.VISARGA}[^{L.CONSONANTS}]')} THEN 'incorrect high placement'
  WHEN NOT {_HAS(_VV)} AND NOT {_HAS(_SV)} THEN CASE WHEN length(w) <= 3 AND {_HAS(f'^[{L.CONSONANTS}{L.HALANT}{_DIA}]+$')} THEN 'incorrect medium no_vowel_short' ELSE 'incorrect high no_vowel' END
  WHEN {" OR ".join(f"contains(w, '{c * 3}')" for c in L.CONSONANTS)} THEN 'incorrect high tripled_consonant'
  WHEN length(w) <= 2 AND w IN {_SHORT_SQL} THEN 'correct high common_short_word'
  WHEN length(w) <= 2 AND {_HAS(f'^{_CV}{_SV}')} THEN 'correct medium consonant_and_sign'
  WHEN length(w) <= 2 AND {_HAS(f'^{_VV}{_CV}')} THEN 'correct medium vowel_and_consonant'
  WHEN length(w) <= 2 THEN 'correct low unusual_short_word'
  WHEN length(w) >= 18 THEN 'correct low long'
  WHEN {_HAS(f'^({"|".join(L.CLUSTERS)})')} THEN 'correct medium loan_cluster'
  WHEN {_HAS(chr(92) + 'p{Nd}')} THEN 'correct medium digits_and_letters'
  ELSE 'correct high regular' END"""
_SPELL = f"""
a AS (SELECT ord, word, classification, coalesce(nfc_normalize(regexp_replace(word, '^{WHITE_SQL}+|{WHITE_SQL}+$', '', 'g')), '') AS w FROM word_result),
s AS (SELECT *, split_part({_DECIDED}, ' ', 1) AS label, split_part({_DECIDED}, ' ', 2) AS confidence, split_part({_DECIDED}, ' ', 3) AS reason FROM a)"""

_AT, _BEFORE, _AFTER = "substr(w, CAST(i + 1 AS BIGINT), 1)", "CASE WHEN i > 0 THEN substr(w, CAST(i AS BIGINT), 1) ELSE '' END", "substr(w, CAST(i + 2 AS BIGINT), 1)"
_ONE_OF = lambda c, letters: f"({c} <> '' AND contains('{letters}', {c}))"
_SIGN, _ISSUES = _ONE_OF(_AT, L.VOWEL_SIGNS), []
for _code, _test in (
    ("sign_at_start", f"{_SIGN} AND i = 0"), ("sign_after_sign", f"{_SIGN} AND {_ONE_OF(_BEFORE, L.VOWEL_SIGNS)}"), ("sign_after_diacritic", f"{_SIGN} AND {_ONE_OF(_BEFORE, _NASAL + L.VISARGA)}"),
    ("halant_at_end", f"{_AT} = '{L.HALANT}' AND i = length(w) - 1"), ("halant_after_non_consonant", f"{_AT} = '{L.HALANT}' AND i > 0 AND NOT {_ONE_OF(_BEFORE, L.CONSONANTS)}"),
    ("halant_after_halant", f"{_AT} = '{L.HALANT}' AND {_BEFORE} = '{L.HALANT}'"), ("nasal_at_start", f"{_ONE_OF(_AT, _NASAL)} AND i = 0"),
    ("anusvara_doubled", f"{_AT} = '{L.ANUSVARA}' AND {_BEFORE} = '{L.ANUSVARA}'"), ("visarga_before_non_consonant", f"{_AT} = '{L.VISARGA}' AND i < length(w) - 1 AND NOT {_ONE_OF(_AFTER, L.CONSONANTS)}"),
):
    _ISSUES.append(f"CASE WHEN {_test} THEN '{_code}@' || i END")
del _code, _test
_FOREIGN_SQL = r"regexp_extract(w, '[^\x{900}-\x{97f}0-9''–-]')".replace("\\\\", "\\")
_REASON = f"""CASE reason
  WHEN 'too_long' THEN 'too_long:' || length(w) WHEN 'long' THEN 'long:' || length(w)
  WHEN 'foreign_character' THEN 'foreign_character:U+' || format('{{:04X}}', unicode({_FOREIGN_SQL})) || '@' || (strpos(w, {_FOREIGN_SQL}) - 1)
  WHEN 'tripled_consonant' THEN 'tripled_consonant:' || list_filter(string_split(w, ''), lambda c, i: {_ONE_OF('c', L.CONSONANTS)} AND substr(w, i, 3) = c || c || c)[1]
  WHEN 'placement' THEN 'placement:' || array_to_string(flatten(list_transform(range(0, length(w)), lambda i: list_filter([{", ".join(_ISSUES)}], lambda x: x IS NOT NULL)))[1:2], '; ')
  ELSE reason END"""

SQL = {
    "spell_classify": f"WITH {_SPELL} SELECT ord, word, label, confidence, {_REASON} AS reason FROM s",
    "number_normalize": f"WITH RECURSIVE {_REWRITTEN} SELECT seg_id, normed FROM n",
    "number_changes": f"""
WITH RECURSIVE {_REWRITTEN}
SELECT span AS original, CASE WHEN kept THEN span ELSE number END AS converted, CASE WHEN kept THEN 'KEPT (idiom/phrase)' ELSE 'CONVERTED' END AS action, count(*) AS n FROM y GROUP BY ALL""",
    "idiom_kept": f"WITH RECURSIVE {_REWRITTEN} SELECT span AS original, count(*) AS n FROM y WHERE kept GROUP BY ALL",
    "cleanup_pipeline": f"""
WITH RECURSIVE {_REWRITTEN}, {_TAGS.replace("text IS NOT NULL", "normed IS NOT NULL").replace(tokens_sql('text'), tokens_sql('normed')).replace("FROM rid_transcription", "FROM n")},
b AS (SELECT seg_id, string_agg(CASE WHEN method IS NULL THEN token ELSE regexp_extract(token, '^({_MARK}*)', 1) || '[EN]' || word || '[/EN]' || regexp_extract(token, '({_MARK}*)$', 1) END, ' ' ORDER BY position) AS tagged,
      CAST(count(method) AS INTEGER) AS tags FROM m GROUP BY seg_id),
q AS (SELECT seg_id, CAST(count(*) AS INTEGER) AS changes FROM y GROUP BY seg_id)
SELECT n.seg_id, n.normed, coalesce(b.tagged, '') AS tagged, coalesce(q.changes, 0) AS changes, coalesce(b.tags, 0) AS tags
FROM n LEFT JOIN b USING (seg_id) LEFT JOIN q USING (seg_id)""",
    "num_words_to_int": f"""
WITH v AS (SELECT * FROM (VALUES {_VALUES}) v(word, value)),
t AS (SELECT seg_id, {tokens_sql('text')} AS w FROM rid_transcription WHERE text IS NOT NULL),
x AS (SELECT seg_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM t),
y AS (SELECT seg_id, pos, token, value, pos - row_number() OVER (PARTITION BY seg_id ORDER BY pos) AS island FROM x JOIN v ON word = token),
z AS (SELECT DISTINCT list(token ORDER BY pos) AS ws, list(value ORDER BY pos) AS vs FROM y GROUP BY seg_id, island),
f AS (SELECT array_to_string(ws, ' ') AS words, list_reduce(list_transform(vs, lambda q: [q]), lambda a, q:
  CASE WHEN q[1] >= 1000 THEN [a[1] + CASE WHEN a[2] = 0 THEN 1 ELSE a[2] END * q[1], 0]
       WHEN q[1] = 100 THEN [a[1], CASE WHEN a[2] = 0 THEN 1 ELSE a[2] END * 100] ELSE [a[1], a[2] + q[1]] END, [CAST(0 AS HUGEINT), CAST(0 AS HUGEINT)]) AS r FROM z)
SELECT DISTINCT words, CAST(r[1] + r[2] AS BIGINT) AS value FROM f""",
    "english_tag": f"WITH {_TAGS} SELECT seg_id, position, word, method, nativised FROM g",
    "english_tag_method_counts": f"WITH {_TAGS} SELECT method, nativised, count(*) AS tags, count(DISTINCT word) AS words FROM g GROUP BY ALL",
    "latin_tag": f"WITH {_TAGS} SELECT seg_id, count(*) AS n FROM m WHERE regexp_matches(token, '[A-Za-z]') AND NOT regexp_matches(token, '[\\x{{900}}-\\x{{97f}}]') GROUP BY seg_id",
    "english_tag_agreement": f"""
WITH {_TAGS}, o AS (SELECT DISTINCT seg_id, position FROM english_word_tag)
SELECT CASE WHEN o.seg_id IS NULL THEN 'found' WHEN g.seg_id IS NULL THEN 'given' ELSE 'both' END AS side, count(*) AS n
FROM o FULL JOIN g ON o.seg_id = g.seg_id AND o.position = g.position GROUP BY ALL""",
    "spell_labels": f"WITH {_SPELL} SELECT ord, label, confidence FROM s",
    "spell_reason_counts": f"WITH {_SPELL} SELECT label, confidence, reason, count(*) AS n FROM s GROUP BY ALL",
    "spell_summary": f"""
WITH {_SPELL}, d AS (SELECT word, any_value(label) AS label, any_value(confidence) AS confidence FROM s WHERE word IS NOT NULL GROUP BY word)
SELECT label, confidence, count(*) AS n, CAST(round_even(100.0 * count(*) / (SELECT count(*) FROM d), 4) AS DOUBLE) AS share
FROM d GROUP BY GROUPING SETS ((label), (confidence), ())""",
    "spell_agreement": f"WITH {_SPELL} SELECT classification, label, count(*) AS n FROM s GROUP BY ALL",
    "low_conf_sample": f"""
WITH {_SPELL} SELECT word, any_value(label) AS label FROM s WHERE word IS NOT NULL AND confidence = 'low' GROUP BY word ORDER BY md5(word), word LIMIT 50""",
}
