"""Error rates, error categories, repair and lattices over the scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vanikosh.functions import lexicon
from vanikosh.functions.align import edit_operations, token_distance, utterance_error_rate
from vanikosh.functions.errors import category, repair, severity, spelling_variants
from vanikosh.functions.numbers import digit_table, numeric_equivalents
from vanikosh.functions.text import nfc, tokens
from vanikosh.operators import lattice
from vanikosh.operators.metric import IGNORED, corpus_metric
from vanikosh.operators.stage import stage
from vanikosh.plans.tables import DISTANCES_SQL, HYPOTHESES_SQL, hypotheses, in_sql, read, recording_languages, tokenized, tokens_sql

#: Sample size and order of the buckets of the stratified sample.
SAMPLE = 27
SEVERITIES = ("mild", "moderate", "severe")
REPAIRED = ("GRAM_INFLECTION", "POSTPOSITION_ERROR", "PHONETIC_CONF")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hypothesis with its errors, the words of its reference, and its rate.

    The distance comes out of a generator, which keeps filters and later columns from working it out again.
    """
    pairs = tokenized(hypotheses(spark, sf_dir))
    once = F.inline(F.array(F.struct(token_distance(F.col("r"), F.col("h")).alias("errors"), F.size("r").alias("n"))))
    rate = F.when(F.col("n") > 0, F.col("errors") / F.col("n")).when(F.col("errors") > 0, 1.0).otherwise(0.0)
    return pairs.select("id", "rid", "run_id", "model", once).withColumn("wer", rate)


def std_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "model", F.bround("wer", 4).alias("wer"))


def utterance_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that counts an utterance without reference as right."""
    rate = utterance_error_rate(F.col("r"), F.col("h"))
    return tokenized(hypotheses(spark, sf_dir)).select("id", "model", F.bround(rate, 4).alias("wer"))


def edit_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of edit operations of each hypothesis, from the alignment."""
    return tokenized(hypotheses(spark, sf_dir)).select("id", "model", F.size(edit_operations(F.col("r"), F.col("h"))).cast("bigint").alias("ops"))


def _corpus(df: DataFrame, *keys: str) -> DataFrame:
    """Errors and words pooled, not a mean of rates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("utterances"), F.sum("errors").cast("bigint").alias("errors"), F.sum("n").cast("bigint").alias("words")).withColumn("wer", F.when(F.col("words") > 0, F.bround(100 * F.col("errors") / F.col("words"), 4)))


def corpus_wer_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus error rate in per cent by the recording's language label and model."""
    return _corpus(scored(spark, sf_dir).join(recording_languages(spark, sf_dir), "rid", "left"), "lang", "model")


def corpus_wer_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(scored(spark, sf_dir), "run_id", "model")


def relative_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, by how many per cent the fine-tuned model's corpus rate is below the baseline's."""
    rate = lambda m: F.sum(F.when(F.col("model") == m, F.col("errors"))) / F.sum(F.when(F.col("model") == m, F.col("n")))
    both = scored(spark, sf_dir).groupBy("run_id").agg(rate("baseline").alias("a"), rate("fine_tuned").alias("b"))
    return both.select("run_id", F.when(F.col("a") > 0, F.bround(100 * (F.col("a") - F.col("b")) / F.col("a"), 4)).alias("improvement"))


def wer_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("wer > 0").groupBy("model", severity(F.col("wer")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark: SparkSession, sf_dir: str, size: int = SAMPLE) -> DataFrame:
    """About ``size`` fine-tuned errors, in proportion to severity: quotas rounded half-even, one at least, the largest
    bucket takes what is over; within a bucket by the MD5 of the id, which stands in for a random order."""
    errors = scored(spark, sf_dir).where("model = 'fine_tuned' and wer > 0").select("id", "wer", severity(F.col("wer")).alias("severity"))
    errors = stage(errors, "errors")
    # the quotas add up to ``size`` and none but the largest, after its correction, is below 1: each is at most ``size`` + 2
    found = errors.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    named = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")).join(found, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))
    whole = Window.partitionBy()  # three rows
    quota = named.withColumn("quota", F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("n") / F.sum("n").over(whole), 0).cast("int")))
    largest = F.row_number().over(whole.orderBy(F.desc("quota"), "rank")) == 1
    quota = quota.withColumn("quota", F.when(largest, F.col("quota") + size - F.sum("quota").over(whole)).otherwise(F.col("quota")))
    place = F.row_number().over(Window.partitionBy("severity").orderBy(F.md5(F.col("id").cast("string")), "id"))
    first = errors.withColumn("place", place).where(F.col("place") <= size + len(SEVERITIES) - 1)  # a literal limit, kept before the shuffle
    return first.join(F.broadcast(quota.select("severity", "quota")), "severity").where("place <= quota").select("id", "severity", F.bround("wer", 4).alias("wer"))


def sample_display(spark: SparkSession, sf_dir: str, width: int = 55) -> DataFrame:
    """The stratified sample as it is shown: reference and prediction cut to ``width`` characters."""
    texts = hypotheses(spark, sf_dir).where("model = 'fine_tuned'").select("id", F.left("ref", F.lit(width)).alias("reference"), F.left("hyp", F.lit(width)).alias("prediction"))
    return texts.join(F.broadcast(stratified_sample(spark, sf_dir)), "id").select("id", "severity", "wer", "reference", "prediction")  # at most SAMPLE + 2 rows


def category_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that occur by their count, the one seen first before others as frequent."""
    counts = edit_ops(spark, sf_dir).groupBy("cat").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "seq")).alias("first"))
    return counts.select(F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"), "cat", "n")  # a row per category


def joined_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and outputs of the models, kept apart by their key, joined again."""
    both = hypotheses(spark, sf_dir)
    return lattice.hypotheses_of(both.select("id", "ref"), both.select("id", "model", "hyp"), ["id"])


def metric_from_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus rate of the fine-tuned hypotheses from ids of a vocabulary of their words, with ignored places in the references."""
    pairs = tokenized(hypotheses(spark, sf_dir).where("model = 'fine_tuned'")).select(F.col("id").alias("row"), "r", "h")
    words = pairs.select(F.explode(F.concat("r", "h")).alias("word")).distinct()
    vocabulary = stage(words.select(F.xxhash64("word").alias("id"), F.concat(F.lit(" "), "word").alias("piece")), "vocabulary")
    ids = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    rows = pairs.select("row", F.concat(ids("r"), F.array(F.lit(IGNORED).cast("bigint"), F.lit(IGNORED).cast("bigint"))).alias("label_ids"), ids("h").alias("pred_ids"))
    return corpus_metric(rows, vocabulary, 0)


def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit operations of the fine-tuned hypotheses with their categories."""
    pairs = tokenized(hypotheses(spark, sf_dir).where("model = 'fine_tuned'"))
    ops = pairs.select("id", F.posexplode(edit_operations(F.col("r"), F.col("h"))).alias("seq", "op")).select("id", "seq", "op.*")
    return ops.withColumn("cat", category(F.col("op"), F.col("ref_w"), F.col("hyp_w")))


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and share of every category, with its meaning; categories that don't occur are there as well."""
    counts = edit_ops(spark, sf_dir).groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame(list(lexicon.CATEGORIES.items()), "cat string, meaning string")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    total = F.sum("n").over(Window.partitionBy())  # a row per category
    return known.join(counts, "cat", "left").select("cat", F.coalesce("meaning", F.lit("-")).alias("meaning"), n.alias("n"), F.when(total > 0, F.bround(100 * n / total, 4)).otherwise(0.0).alias("share"))


def taxonomy_examples(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """The first ``k`` operations of each category, by id and place."""
    first = F.row_number().over(Window.partitionBy("cat").orderBy("id", "seq"))
    return edit_ops(spark, sf_dir).withColumn("place", first).where(F.col("place") <= k).select("cat", "place", "id", "op", "ref_w", "hyp_w")


def repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses(spark, sf_dir).where("model = 'fine_tuned'").select("id", repair(F.col("hyp")).alias("repaired"))


def repair_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rate of the utterances that have an error of a category, before and after repair; a category without any has a row of nulls."""
    pairs = tokenized(hypotheses(spark, sf_dir).where("model = 'fine_tuned'"))
    fixed = pairs.withColumn("f", tokens(repair(F.col("hyp"))))
    sums = fixed.select("id", F.size("r").alias("n"), token_distance(F.col("r"), F.col("h")).alias("before"), token_distance(F.col("r"), F.col("f")).alias("after"))
    hit = edit_ops(spark, sf_dir).where(F.col("cat").isin(list(REPAIRED))).select("id", "cat").distinct()
    rates = hit.join(sums, "id").groupBy("cat").agg(F.count(F.lit(1)).alias("utterances"), F.sum("n").alias("words"), F.sum("before").alias("b"), F.sum("after").alias("a"))
    rate = lambda c: F.bround(100 * F.col(c) / F.col("words"), 4)
    targets = spark.createDataFrame([(c,) for c in REPAIRED], "cat string")
    return targets.join(rates, "cat", "left").select("cat", F.coalesce("utterances", F.lit(0)).alias("utterances"), rate("b").alias("before"), rate("a").alias("after"), F.bround(100 * (F.col("b") - F.col("a")) / F.col("words"), 4).alias("delta"))


def repaired_examples(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """The first ``k`` hypotheses with an inflection or postposition error that repair changes."""
    rank = F.min(F.when(F.col("cat") == "GRAM_INFLECTION", 0).otherwise(1))
    hit = edit_ops(spark, sf_dir).where("cat in ('GRAM_INFLECTION', 'POSTPOSITION_ERROR')").groupBy("id").agg(rank.alias("rank"))
    texts = hypotheses(spark, sf_dir).where("model = 'fine_tuned'").withColumn("repaired", repair(F.col("hyp")))
    return hit.join(texts, "id").where("repaired <> hyp").orderBy("rank", "id").limit(k).select("id", "hyp", "repaired")


def reference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "predictions", "reference").select(F.explode(tokens(F.col("reference"))).alias("token")).distinct()


def numeric_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_tokens(spark, sf_dir).select("token", F.explode(numeric_equivalents(F.col("token"))).alias("form"))


def spelling_variants_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_tokens(spark, sf_dir).select("token", F.explode(spelling_variants(F.col("token"), nfc)).alias("form"))


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses by utterance: the rows of a recording with one normalised reference, each row and model a voter."""
    return hypotheses(spark, sf_dir).where("rid is not null").withColumn("model", F.concat_ws(":", F.col("id").cast("string"), "model"))


def position_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.position_votes(_utterances(spark, sf_dir), ["rid", "ref"])


def lattice_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = lattice.lattice_bins(_utterances(spark, sf_dir), ["rid", "ref"])
    others = F.array_except("alternatives", F.array("ref_token"))
    return bins.select("rid", "ref", "pos", "ref_token", F.array_join("alternatives", "|").alias("alternatives"), F.array_join(others, "|").alias("others"))


def lattice_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.evaluate(_utterances(spark, sf_dir), ["rid", "ref"])


def unfair_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses that the standard rate penalises and the lattice doesn't, per kind of model."""
    kind = F.substring_index("model", ":", -1).alias("model")
    return lattice_wer(spark, sf_dir).groupBy(kind).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("unfair").alias("unfair"))


QUERIES = {
    f.__name__: f
    for f in (
        std_wer, utterance_wer, edit_op_counts, corpus_wer_by_lang, corpus_wer_by_run, relative_improvement, wer_severity_counts, stratified_sample, sample_display, category_ranking, joined_hypotheses, metric_from_ids, edit_ops, error_taxonomy,
        taxonomy_examples, repair_text, repair_delta, repaired_examples, numeric_equiv, position_votes, lattice_bins, lattice_wer, unfair_pairs,
    )
} | {"spelling_variants": spelling_variants_of_tokens}


def _costs_sql(name: str, source: str, same: int, other: int) -> str:
    """Rows of the table of least costs of all prefixes, gaps at 1."""
    return f"""
{name} AS (SELECT k, r, w, 0 AS i, range(0, len(w) + 1) AS cost FROM {source}
  UNION ALL
  SELECT k, r, w, i + 1, list_transform(range(1, len(w) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda q:
    (CASE WHEN q = 1 THEN i + 1 ELSE least(cost[q] + 1, cost[q - 1] + CASE WHEN r[i + 1] = w[q - 1] THEN {same} ELSE {other} END) END) - q)) + j)
  FROM {name} WHERE i < len(r))"""


def _trace_sql(name: str, costs: str, same: int, other: int) -> str:
    """Steps back through the table, a pair before a missing word before an added one; ``step`` counts from the end."""
    return f"""
{name} AS (SELECT k, len(r) AS i, len(w) AS j, 0 AS step, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM {costs} WHERE i = len(r)
  UNION ALL
  SELECT k, i - CASE WHEN go = 'I' THEN 0 ELSE 1 END, j - CASE WHEN go = 'D' THEN 0 ELSE 1 END, step + 1, CASE WHEN go <> 'I' THEN r[i] END, CASE WHEN go <> 'D' THEN w[j] END
  FROM (SELECT {name}.k, {name}.i, {name}.j, {name}.step, c.r, c.w,
          CASE WHEN {name}.i > 0 AND {name}.j > 0 AND c.cost[{name}.j + 1] = p.cost[{name}.j] + CASE WHEN c.r[{name}.i] = c.w[{name}.j] THEN {same} ELSE {other} END THEN 'S'
               WHEN {name}.i > 0 AND c.cost[{name}.j + 1] = p.cost[{name}.j + 1] + 1 THEN 'D' ELSE 'I' END AS go
        FROM {name} JOIN {costs} c ON c.k = {name}.k AND c.i = {name}.i LEFT JOIN {costs} p ON p.k = {name}.k AND p.i = {name}.i - 1
        WHERE {name}.i + {name}.j > 0))"""


_LEFT = lambda n: f"left(ref_w, {n}) = left(hyp_w, {n})"
_EDITS = f"""{HYPOTHESES_SQL}, f AS (SELECT id AS k, r, w FROM h WHERE model = 'fine_tuned' AND len(r) > 0),
{_costs_sql('c', 'f', 0, 1)}, {_trace_sql('t', 'c', 0, 1)},
o AS (SELECT k AS id, step, CASE WHEN a IS NULL THEN 'I' WHEN b IS NULL THEN 'D' ELSE 'S' END AS op, coalesce(a, '') AS ref_w, coalesce(b, '') AS hyp_w FROM t WHERE step > 0 AND a IS DISTINCT FROM b),
l AS (SELECT *, least(length(ref_w), length(hyp_w)) AS ml FROM o),
ops AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY step DESC) - 1 AS INTEGER) AS seq, op, ref_w, hyp_w,
  CASE WHEN (ref_w IN {in_sql(lexicon.COUNT_WORDS)} AND regexp_full_match(hyp_w, '\\p{{Nd}}+')) OR (hyp_w IN {in_sql(lexicon.COUNT_WORDS)} AND regexp_full_match(ref_w, '\\p{{Nd}}+')) THEN 'NUMERIC_MISMATCH'
       WHEN op = 'I' THEN 'INSERTION' WHEN op = 'D' AND length(ref_w) <= 2 THEN 'DELETION_FUNC' WHEN op = 'D' THEN 'DELETION_CONTENT'
       WHEN ref_w IN {in_sql(lexicon.POSTPOSITIONS)} OR hyp_w IN {in_sql(lexicon.POSTPOSITIONS)} THEN 'POSTPOSITION_ERROR'
       WHEN ml >= 3 AND {_LEFT('greatest(2, ml - 2)')} AND ref_w <> hyp_w THEN 'GRAM_INFLECTION'
       WHEN ml >= 3 AND {_LEFT(3)} AND abs(length(ref_w) - length(hyp_w)) <= 2 THEN 'PHONETIC_CONF'
       WHEN length(ref_w) >= 4 AND (contains(hyp_w, ref_w) OR contains(ref_w, hyp_w)) THEN 'COMPOUND_SPLIT' ELSE 'OTHER_SUBST' END AS cat FROM l)"""
_VOTES = f"""{HYPOTHESES_SQL}, f AS (SELECT {{'rid': rid, 'ref': ref, 'model': id || ':' || model}} AS k, r, w FROM h WHERE rid IS NOT NULL),
{_costs_sql('c', 'f', -1, 1)}, {_trace_sql('t', 'c', -1, 1)},
a AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY step DESC) - 1 AS pos, coalesce(b, '') AS token FROM t WHERE step > 0 AND a IS NOT NULL),
votes AS (SELECT k.rid AS rid, k.ref AS ref, pos, token, count(*) AS votes FROM a GROUP BY ALL)"""
_NUMBERS = ", ".join(f"('{d}', '{w}')" for d, ws in digit_table().items() for w in ws)
_SHAPES = "[s" + "".join(f", replace(s, chr({a}), chr({b}))" for a, b in ((0x902, 0x901), (0x901, 0x902), (0x93F, 0x940), (0x940, 0x93F), (0x941, 0x942), (0x942, 0x941))) + ", replace(s, chr(2364), '')]"
_BINS = f"""{_VOTES},
m AS (SELECT rid, ref, count(*) AS models, any_value(r) AS r FROM h WHERE rid IS NOT NULL GROUP BY rid, ref),
own AS (SELECT rid, ref, unnest(r) AS s, generate_subscripts(r, 1) - 1 AS pos FROM m),
named AS (SELECT rid, ref, pos, s, s AS ref_token FROM own
  UNION ALL SELECT votes.rid, votes.ref, pos, token, NULL FROM votes JOIN m ON m.rid = votes.rid AND m.ref = votes.ref WHERE CAST(votes AS DOUBLE) / models >= 0.6),
num AS (SELECT * FROM (VALUES {_NUMBERS}) v(digit, word)),
forms AS (SELECT rid, ref, pos, ref_token, s AS form FROM named
  UNION SELECT rid, ref, pos, ref_token, digit FROM named JOIN num ON word = s UNION SELECT rid, ref, pos, ref_token, word FROM named JOIN num ON digit = s
  UNION SELECT rid, ref, pos, ref_token, nfc_normalize(unnest({_SHAPES})) FROM named),
bins AS (SELECT rid, ref, pos, max(ref_token) AS ref_token, list_sort(list(DISTINCT form)) AS alternatives FROM forms GROUP BY rid, ref, pos)"""
_RATES = f"""{_BINS},
lat AS (SELECT rid, ref, list(alternatives ORDER BY pos) AS bins FROM bins GROUP BY rid, ref),
e0 AS (SELECT h.rid, h.ref, h.id || ':' || h.model AS model, h.r, h.w, coalesce(lat.bins, []) AS bins FROM h LEFT JOIN lat ON lat.rid = h.rid AND lat.ref = h.ref WHERE h.rid IS NOT NULL),
e1 AS (SELECT rid, ref, model, r, w, bins, 0 AS i, range(0, len(w) + 1) AS cost, range(0, len(w) + 1) AS plain FROM e0
  UNION ALL
  SELECT rid, ref, model, r, w, bins, i + 1,
    list_transform(range(1, len(w) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda q: least(cost[q] + CASE WHEN list_contains(bins[i + 1], '') THEN 0 ELSE 1 END,
      CASE WHEN q = 1 THEN 1000000 ELSE cost[q - 1] + CASE WHEN list_contains(bins[i + 1], w[q - 1]) THEN 0 ELSE 1 END END) - q)) + j),
    list_transform(range(1, len(w) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda q: least(plain[q] + 1,
      CASE WHEN q = 1 THEN 1000000 ELSE plain[q - 1] + CASE WHEN r[i + 1] = w[q - 1] THEN 0 ELSE 1 END END) - q)) + j)
  FROM e1 WHERE i < len(bins)),
e2 AS (SELECT rid, ref, model, CAST(round_even(CASE WHEN len(r) > 0 THEN CAST(plain[len(plain)] AS DOUBLE) / len(r) WHEN len(w) > 0 THEN 1.0 ELSE 0.0 END, 4) AS DOUBLE) AS standard_wer,
         CAST(round_even(CASE WHEN len(bins) > 0 THEN CAST(cost[len(cost)] AS DOUBLE) / greatest(len(bins), len(w)) WHEN len(w) > 0 THEN 1.0 ELSE 0.0 END, 4) AS DOUBLE) AS lattice_wer FROM e1 WHERE i = len(bins))"""
_MEANINGS = ", ".join(f"('{c}', '{m}')" for c, m in lexicon.CATEGORIES.items())
_REF = f"t AS (SELECT DISTINCT unnest({tokens_sql('reference')}) AS token FROM predictions)"
_DIGITS = ", ".join(f"('{d}', '{w}')" for d, ws in digit_table().items() for w in ws)
_SEVERITY = "CASE WHEN wer <= 0.25 THEN 'mild' WHEN wer <= 0.6 THEN 'moderate' ELSE 'severe' END"
_R4 = lambda x: f"CAST(round_even({x}, 4) AS DOUBLE)"
_SWAPS = ((0x902, 0x901), (0x901, 0x902), (0x93F, 0x940), (0x940, 0x93F), (0x941, 0x942), (0x942, 0x941))
_FORMS = " UNION ".join(["SELECT token, nfc_normalize(token) AS form FROM d"] + [f"SELECT token, nfc_normalize(replace(token, chr({a}), chr({b}))) FROM d" for a, b in _SWAPS] + ["SELECT token, nfc_normalize(replace(token, chr(2364), '')) FROM d"])
_STEM = "x"
for _suffix in reversed(lexicon.SUFFIXES):
    _STEM = f"CASE WHEN suffix(x, '{_suffix}') AND length(x) > {len(_suffix)} THEN left(x, length(x) - {len(_suffix)}) ELSE {_STEM} END"
_GOVERN = "w"
for _stems, _wrong, _right in lexicon.GOVERNMENT:
    _GOVERN = f"CASE WHEN s IN {in_sql(_stems)} AND w IN {in_sql(_wrong)} THEN '{_right}' ELSE {_GOVERN} END"

SQL = {
    "edit_ops": f"WITH RECURSIVE {_EDITS} SELECT id, seq, op, ref_w, hyp_w, cat FROM ops",
    "error_taxonomy": f"""
WITH RECURSIVE {_EDITS}, g AS (SELECT v.cat, v.meaning, count(ops.cat) AS n FROM (VALUES {_MEANINGS}) v(cat, meaning) LEFT JOIN ops ON ops.cat = v.cat GROUP BY ALL)
SELECT cat, meaning, n, CASE WHEN sum(n) OVER () > 0 THEN CAST(round_even(100.0 * n / sum(n) OVER (), 4) AS DOUBLE) ELSE 0.0 END AS share FROM g""",
    "taxonomy_examples": f"""
WITH RECURSIVE {_EDITS} SELECT cat, CAST(row_number() OVER (PARTITION BY cat ORDER BY id, seq) AS INTEGER) AS place, id, op, ref_w, hyp_w FROM ops
QUALIFY row_number() OVER (PARTITION BY cat ORDER BY id, seq) <= 4""",
    "position_votes": f"WITH RECURSIVE {_VOTES} SELECT rid, ref, CAST(pos AS INTEGER) AS pos, token, votes FROM votes",
    "lattice_bins": f"""
WITH RECURSIVE {_BINS} SELECT rid, ref, CAST(pos AS INTEGER) AS pos, ref_token, array_to_string(alternatives, '|') AS alternatives,
  array_to_string(list_filter(alternatives, lambda x: x <> ref_token), '|') AS others FROM bins""",
    "lattice_wer": f"WITH RECURSIVE {_RATES} SELECT *, lattice_wer < standard_wer AS unfair FROM e2",
    "unfair_pairs": f"WITH RECURSIVE {_RATES} SELECT split_part(model, ':', 2) AS model, count(*) AS pairs, count(*) FILTER (lattice_wer < standard_wer) AS unfair FROM e2 GROUP BY ALL",
    "std_wer": f"WITH RECURSIVE {DISTANCES_SQL} SELECT id, model, {_R4('wer')} AS wer FROM s",
    "utterance_wer": f"WITH RECURSIVE {DISTANCES_SQL} SELECT id, model, CASE WHEN n = 0 THEN 0.0 ELSE {_R4('wer')} END AS wer FROM s",
    "edit_op_counts": f"WITH RECURSIVE {DISTANCES_SQL} SELECT id, model, CAST(CASE WHEN n = 0 THEN 0 ELSE errors END AS BIGINT) AS ops FROM s",
    "corpus_wer_by_lang": f"""
WITH RECURSIVE {DISTANCES_SQL}, l AS (SELECT rid, min(lower(lang)) AS lang FROM manifest WHERE rid IS NOT NULL GROUP BY rid)
SELECT lang, model, count(*) AS utterances, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS words,
       CASE WHEN sum(n) > 0 THEN {_R4('100.0 * sum(errors) / sum(n)')} END AS wer
FROM s LEFT JOIN l USING (rid) GROUP BY lang, model""",
    "corpus_wer_by_run": f"""
WITH RECURSIVE {DISTANCES_SQL}
SELECT run_id, model, count(*) AS utterances, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS words,
       CASE WHEN sum(n) > 0 THEN {_R4('100.0 * sum(errors) / sum(n)')} END AS wer
FROM s GROUP BY run_id, model""",
    "relative_improvement": f"""
WITH RECURSIVE {DISTANCES_SQL},
p AS (SELECT run_id, CAST(sum(errors) FILTER (model = 'baseline') AS DOUBLE) / sum(n) FILTER (model = 'baseline') AS a,
             CAST(sum(errors) FILTER (model = 'fine_tuned') AS DOUBLE) / sum(n) FILTER (model = 'fine_tuned') AS b FROM s GROUP BY run_id)
SELECT run_id, CASE WHEN a > 0 THEN {_R4('100 * (a - b) / a')} END AS improvement FROM p""",
    "wer_severity_counts": f"WITH RECURSIVE {DISTANCES_SQL} SELECT model, {_SEVERITY} AS severity, count(*) AS n FROM s WHERE wer > 0 GROUP BY ALL",
    "stratified_sample": f"""
WITH RECURSIVE {DISTANCES_SQL},
x AS (SELECT id, wer, {_SEVERITY} AS severity FROM s WHERE model = 'fine_tuned' AND wer > 0),
c AS (SELECT v.severity, v.rank, count(x.id) AS n FROM (VALUES ('mild', 0), ('moderate', 1), ('severe', 2)) v(severity, rank) LEFT JOIN x ON x.severity = v.severity GROUP BY ALL),
q AS (SELECT *, greatest(1, CAST(round_even(27.0 * n / (SELECT sum(n) FROM c), 0) AS INTEGER)) AS quota FROM c),
f AS (SELECT severity, quota + CASE WHEN row_number() OVER (ORDER BY quota DESC, rank) = 1 THEN 27 - (SELECT sum(quota) FROM q) ELSE 0 END AS quota FROM q),
p AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY md5(CAST(id AS VARCHAR)), id) AS place FROM x)
SELECT id, severity, {_R4('wer')} AS wer FROM p JOIN f USING (severity) WHERE place <= quota""",
    "repair_text": f"""
WITH {HYPOTHESES_SQL}, a AS (SELECT id, w FROM h WHERE model = 'fine_tuned'),
b AS (SELECT id, list_transform(range(1, len(w) + 1), lambda i:
  CASE WHEN suffix(w[i], chr(2375)) AND length(w[i]) > 1 AND i > 1 AND w[i - 1] IN {in_sql(lexicon.FEMININE_PLURAL)} THEN left(w[i], length(w[i]) - 1) || chr(2368) || chr(2306)
       WHEN suffix(w[i], chr(2375)) AND length(w[i]) > 1 AND w[i + 1] = 'ने' THEN left(w[i], length(w[i]) - 1) || chr(2366) ELSE w[i] END) AS w FROM a),
c AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM b),
e AS (SELECT id, i, w, coalesce(lead(w) OVER (PARTITION BY id ORDER BY i), '') AS x FROM c),
g AS (SELECT id, i, w, {_STEM} AS s FROM e),
o AS (SELECT id, string_agg({_GOVERN}, ' ' ORDER BY i) AS repaired FROM g GROUP BY id)
SELECT a.id, coalesce(o.repaired, '') AS repaired FROM a LEFT JOIN o USING (id)""",
    "numeric_equiv": f"""
WITH {_REF}, v AS (SELECT * FROM (VALUES {_DIGITS}) v(digit, word))
SELECT token, token AS form FROM t UNION SELECT token, digit FROM t JOIN v ON word = token UNION SELECT token, word FROM t JOIN v ON digit = token""",
    "spelling_variants": f"WITH {_REF}, d AS (SELECT token FROM t), f AS ({_FORMS} UNION SELECT token, nfc_normalize(token) FROM d) SELECT DISTINCT token, form FROM f",
}
del _suffix, _stems, _wrong, _right
_REPAIRED = f"""{_EDITS}, rep AS ({SQL['repair_text']}), hit AS (SELECT DISTINCT id, cat FROM ops)"""
SQL["repair_delta"] = f"""
WITH RECURSIVE {_REPAIRED},
f2 AS (SELECT f.k, f.r, {tokens_sql('rep.repaired')} AS w FROM f JOIN rep ON rep.id = f.k), {_costs_sql('c2', 'f2', 0, 1)},
b AS (SELECT c.k AS id, len(c.r) AS n, c.cost[len(c.cost)] AS b, c2.cost[len(c2.cost)] AS a FROM c JOIN c2 ON c2.k = c.k AND c2.i = len(c2.r) WHERE c.i = len(c.r)),
g AS (SELECT cat, count(*) AS utterances, sum(n) AS words, sum(b) AS b, sum(a) AS a FROM hit JOIN b USING (id) GROUP BY cat)
SELECT v.cat, coalesce(utterances, 0) AS utterances, {_R4('100.0 * b / words')} AS before, {_R4('100.0 * a / words')} AS after, {_R4('100.0 * (b - a) / words')} AS delta
FROM (VALUES {", ".join(f"('{c}')" for c in REPAIRED)}) v(cat) LEFT JOIN g ON g.cat = v.cat"""
SQL["sample_display"] = f"""
SELECT s.id, s.severity, s.wer, left(x.ref, 55) AS reference, left(x.hyp, 55) AS prediction
FROM ({SQL['stratified_sample']}) s JOIN (WITH {HYPOTHESES_SQL} SELECT * FROM h WHERE model = 'fine_tuned') x ON x.id = s.id"""
SQL["category_ranking"] = f"""
WITH RECURSIVE {_EDITS}, g AS (SELECT cat, count(*) AS n, min(id) AS a, min((id, seq)) AS first FROM ops GROUP BY cat)
SELECT CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS place, cat, n FROM g"""
SQL["joined_hypotheses"] = f"WITH {HYPOTHESES_SQL} SELECT id, ref, model, hyp FROM h"
SQL["metric_from_ids"] = f"WITH RECURSIVE {DISTANCES_SQL} SELECT CASE WHEN sum(n) > 0 THEN {_R4('100.0 * sum(errors) / sum(n)')} END AS wer FROM s WHERE model = 'fine_tuned'"
SQL["repaired_examples"] = f"""
WITH RECURSIVE {_REPAIRED}
SELECT h.id, h.hyp, rep.repaired FROM (SELECT id, min(CASE WHEN cat = 'GRAM_INFLECTION' THEN 0 ELSE 1 END) AS rank FROM hit WHERE cat IN ('GRAM_INFLECTION', 'POSTPOSITION_ERROR') GROUP BY id) x
JOIN h ON h.id = x.id AND h.model = 'fine_tuned' JOIN rep ON rep.id = x.id WHERE rep.repaired <> h.hyp ORDER BY rank, h.id LIMIT 4"""
