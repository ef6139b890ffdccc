"""Tokens, word lists, n-grams, recordings and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.functions.text import normalized, ngrams, tokens
from vanikosh.operators.intervals import usable
from vanikosh.operators.scans import running_sum
from vanikosh.plans.tables import norm_sql, read, recording_languages, tokens_sql
from vanikosh.sources.readers import SEGMENT_ARRAY, word_list


def tokenize_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "rid_transcription", "seg_id", "text").select("seg_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def token_freq_topk(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """The ``k`` most frequent tokens; of equally frequent ones the lesser by code points."""
    return tokenize_explode(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(k)


def wordlist_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trimmed words with the place where each comes first."""
    return word_list(read(spark, sf_dir, "word_result", "ord", "word"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "rid_transcription", "seg_id", "text").select("seg_id", normalized(F.col("text")).alias("norm"))


def segments_merge(spark: SparkSession, sf_dir: str, part_seconds: int = 3600, part_segments: int = 4096) -> DataFrame:
    """The normalised text of each recording, of all its segments with text: those with usable times by start and id, a part for
    each hour; then the others by number (null last) and id, ``part_segments`` of them in the last hour's part and in each part
    after it. So the rows of a group are bounded."""
    rows = read(spark, sf_dir, "rid_transcription", "seg_id", "rid", "seg_no", "start", "end", "text").where("text is not null").withColumn("recording", F.struct("rid"))  # a struct equals itself even if rid is null
    timed = usable(F.col("start"), F.col("end"))
    hours = rows.where(timed).select("recording", F.floor(F.col("start") / part_seconds).alias("part"), F.lit(False).alias("late"), F.col("start").alias("at"), "seg_id", "text")
    block = F.struct(F.col("seg_no").isNull(), F.floor(F.coalesce(F.col("seg_no").cast("bigint"), "seg_id") / part_segments))
    numbered = running_sum(rows.where(~timed).withColumn("block", block), ["recording"], "block", ["seg_no", "seg_id"], F.lit(1), "n")
    part = F.coalesce("last", F.lit(0)) + F.floor((F.col("n") - 1) / part_segments)
    last = hours.groupBy("recording").agg(F.max("part").alias("last"))
    others = numbered.join(last, "recording", "left").select("recording", part.alias("part"), F.lit(True).alias("late"), F.col("n").cast("double").alias("at"), "seg_id", "text")
    ordered = F.array_sort(F.collect_list(F.struct("late", "at", "seg_id", "text")))
    text = normalized(F.array_join(F.transform(ordered, lambda s: s["text"]), " "))
    return hours.unionByName(others).groupBy("recording", "part").agg(F.count(F.lit(1)).alias("segments"), text.alias("text")).select("recording.rid", "part", "segments", "text")


def segments_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments read from JSON text of the reference's layout: seconds and text of each."""
    rows = read(spark, sf_dir, "rid_transcription", "seg_id", "start", "end", "speaker_id", "text")
    as_json = rows.select("seg_id", F.to_json(F.array(F.struct("start", "end", "speaker_id", "text"))).alias("json"))
    parsed = as_json.select("seg_id", F.explode(F.from_json("json", SEGMENT_ARRAY)).alias("s"))
    seconds = F.round(F.col("s.end") - F.col("s.start"), 3)
    return parsed.select("seg_id", F.col("s.speaker_id").cast("bigint").alias("speaker_id"), F.when(~F.isnan(seconds), seconds).alias("seconds"), F.length("s.text").cast("bigint").alias("chars"))


def duration_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, half-up to 6 places, and recordings per language label, each recording once with its longest finite duration.

    Whole microseconds are summed, so that the result doesn't depend on the order of the rows.
    """
    micros = F.round(F.col("duration") * 1_000_000).try_cast("bigint")
    once = read(spark, sf_dir, "manifest", "rid", "lang", "duration").where("rid is not null").groupBy("rid").agg(F.min(F.lower("lang")).alias("lang"), F.max(micros).alias("micros"))
    hours = F.expr("(sum(micros) + 1800) div 3600") / 1_000_000
    return once.groupBy("lang").agg(F.count(F.lit(1)).alias("recordings"), hours.alias("hours"))


def duration_filter(spark: SparkSession, sf_dir: str, least: float = 0.5, most: float = 30.0) -> DataFrame:
    """Segments of a length fit for training."""
    seconds = F.col("end") - F.col("start")
    return read(spark, sf_dir, "rid_transcription", "seg_id", "start", "end").where(usable(F.col("start"), F.col("end")) & seconds.between(least, most)).select("seg_id", F.round(seconds, 3).alias("seconds"))


def hindi_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording_languages(spark, sf_dir).where("lang = 'hi'").select("rid")


def lm_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty normalised lines of the training texts and then of the validation texts."""
    part = lambda table, column, name, i: read(spark, sf_dir, table, column).select(F.lit(i).alias("part"), F.lit(name).alias("source"), normalized(F.col(column)).alias("line")).where("line <> ''")
    return part("rid_transcription", "text", "train", 0).unionByName(part("predictions", "reference", "validation", 1))


def _sized(grams, n: int):
    return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


def ngram_counts(spark: SparkSession, sf_dir: str, most: int = 4) -> DataFrame:
    """Counts of all runs of 1 to ``most`` tokens of the lines of ``lm_corpus``."""
    rows = lm_corpus(spark, sf_dir).select(tokens(F.col("line")).alias("w"))
    runs = F.flatten(F.array(*[_sized(ngrams(F.col("w"), n), n) for n in range(1, most + 1)]))
    return rows.select(F.explode(runs).alias("g")).groupBy("g.n", "g.gram").agg(F.count(F.lit(1)).alias("count"))


def vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of the references, of the fine-tuned hypotheses, in both, and only in either."""
    bag = lambda c: read(spark, sf_dir, "predictions", c).select(F.explode(tokens(normalized(F.col(c)))).alias("token")).distinct()
    a, b = bag("reference"), bag("ft_pred")
    parts = {"reference": a, "hypothesis": b, "both": a.intersect(b), "reference_only": a.exceptAll(b), "hypothesis_only": b.exceptAll(a), "either": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_explode, token_freq_topk, wordlist_dedup, normalize_text, segments_merge, segments_from_json, duration_hours, duration_filter,
        hindi_manifest, lm_corpus, ngram_counts, vocabulary_overlap,
    )
}

_USABLE = """rid IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND isfinite("start") AND isfinite("end") AND "start" >= 0 AND "end" > "start\""""
_TIMED = _USABLE.removeprefix("rid IS NOT NULL AND ")
_TOK = f"t AS (SELECT seg_id, {tokens_sql('text')} AS w FROM rid_transcription WHERE text IS NOT NULL), x AS (SELECT seg_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM t)"
_BAG = lambda c: f"SELECT DISTINCT unnest({tokens_sql(norm_sql(c))}) AS token FROM predictions"

SQL = {
    "tokenize_explode": f"WITH {_TOK} SELECT seg_id, CAST(pos AS INTEGER) AS pos, token FROM x",
    "token_freq_topk": f"WITH {_TOK} SELECT token, count(*) AS n FROM x GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "wordlist_dedup": r"""
WITH w AS (SELECT ord, regexp_replace(word, '^WS+|WS+$', '', 'g') AS word FROM word_result)
SELECT word, min(ord) AS ord FROM w
WHERE word <> '' AND NOT (ord = (SELECT min(ord) FROM w WHERE word <> '') AND lower(word) IN ('word', 'words', 'unique words', 'unique_words')) GROUP BY word""",
    "normalize_text": f"SELECT seg_id, {norm_sql('text')} AS norm FROM rid_transcription",
    "segments_merge": f"""
WITH a AS (SELECT rid, seg_id, seg_no, "start", text, coalesce({_TIMED}, false) AS timed FROM rid_transcription WHERE text IS NOT NULL),
h AS (SELECT rid, CAST(floor("start" / 3600) AS BIGINT) AS part, 0 AS late, "start" AS place, seg_id, text FROM a WHERE timed),
l AS (SELECT rid, max(part) AS part FROM h GROUP BY rid),
o AS (SELECT a.rid, coalesce(l.part, 0) AS part, row_number() OVER (PARTITION BY a.rid ORDER BY a.seg_no IS NULL, a.seg_no, a.seg_id) AS n, a.seg_id, a.text
  FROM a LEFT JOIN l ON l.rid IS NOT DISTINCT FROM a.rid WHERE NOT a.timed),
b AS (SELECT * FROM h UNION ALL SELECT rid, part + (n - 1) // 4096, 1, CAST(n AS DOUBLE), seg_id, text FROM o)
SELECT rid, part, count(*) AS segments, {norm_sql("string_agg(text, ' ' ORDER BY late, place, seg_id)")} AS text FROM b GROUP BY rid, part""",
    "segments_from_json": """SELECT seg_id, speaker_id, CASE WHEN isnan("start") OR isnan("end") THEN NULL ELSE round("end" - "start", 3) END AS seconds, length(text) AS chars FROM rid_transcription""",
    "duration_hours": """
WITH o AS (SELECT rid, min(lower(lang)) AS lang, max(CAST(round(CASE WHEN isfinite(duration) THEN duration END * 1000000) AS BIGINT)) AS micros FROM manifest WHERE rid IS NOT NULL GROUP BY rid)
SELECT lang, count(*) AS recordings, ((sum(micros) + 1800) // 3600) / 1000000.0 AS hours FROM o GROUP BY lang""",
    "duration_filter": f"""SELECT seg_id, round("end" - "start", 3) AS seconds FROM rid_transcription WHERE {_USABLE} AND "end" - "start" BETWEEN 0.5 AND 30""",
    "hindi_manifest": "SELECT rid FROM manifest WHERE rid IS NOT NULL GROUP BY rid HAVING min(lower(lang)) = 'hi'",
    "lm_corpus": f"""
WITH p AS (SELECT 0 AS part, 'train' AS source, {norm_sql('text')} AS line FROM rid_transcription
  UNION ALL SELECT 1, 'validation', {norm_sql('reference')} FROM predictions)
SELECT * FROM p WHERE line <> ''""",
    "ngram_counts": f"""
WITH w AS (SELECT {tokens_sql(norm_sql('text'))} AS w FROM rid_transcription UNION ALL SELECT {tokens_sql(norm_sql('reference'))} FROM predictions),
g AS (SELECT CAST(n AS INTEGER) AS n, unnest(list_transform(range(1, greatest(1, len(w) - n + 2)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM w, (VALUES (1), (2), (3), (4)) v(n))
SELECT n, gram, count(*) AS count FROM g GROUP BY n, gram""",
    "vocabulary_overlap": f"""
WITH a AS ({_BAG('reference')}), b AS ({_BAG('ft_pred')})
SELECT 'reference' AS part, count(*) AS n FROM a UNION ALL SELECT 'hypothesis', count(*) FROM b
UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'reference_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'hypothesis_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
}
SQL["wordlist_dedup"] = SQL["wordlist_dedup"].replace("WS", r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
