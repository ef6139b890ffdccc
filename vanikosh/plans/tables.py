"""The tables as the queries see them, and pieces of SQL that the checks share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.functions.text import normalized, tokens
from vanikosh.operators.stage import spread


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, rid, run_id, model, ref, hyp``: one row per scored hypothesis, texts normalised, null texts as ''."""
    df = spread(read(spark, sf_dir, "predictions", "id", "rid", "run_id", "reference", "baseline_pred", "ft_pred"))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("hyp")) for m, c in (("baseline", "baseline_pred"), ("fine_tuned", "ft_pred"))]))
    return df.select("id", "rid", "run_id", "reference", models.alias("m")).select("id", "rid", "run_id", "m.model", normalized(F.col("reference")).alias("ref"), normalized(F.col("m.hyp")).alias("hyp"))


def tokenized(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"r": tokens(F.col("ref")), "h": tokens(F.col("hyp"))})


def recording_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rid, lang``: the label of each recording in lower case, the least one of those it has."""
    return read(spark, sf_dir, "manifest", "rid", "lang").where("rid is not null").groupBy("rid").agg(F.min(F.lower("lang")).alias("lang"))


# --- SQL ---------------------------------------------------------------------------

WHITE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WHITE_SQL}+'), lambda t: t <> '')"


def norm_sql(text: str) -> str:
    kept = rf"regexp_replace(nfc_normalize({text}), '[^\x{{900}}-\x{{97f}}\x{{1cd0}}-\x{{1cff}}0-9 ,?!.]', '', 'g')"
    return f"coalesce(trim(regexp_replace({kept}, ' +', ' ', 'g')), '')"


def in_sql(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


HYPOTHESES_SQL = f"""
h0 AS (SELECT id, rid, run_id, 'baseline' AS model, {norm_sql('reference')} AS ref, {norm_sql('baseline_pred')} AS hyp FROM predictions
       UNION ALL SELECT id, rid, run_id, 'fine_tuned', {norm_sql('reference')}, {norm_sql('ft_pred')} FROM predictions),
h AS (SELECT *, {tokens_sql('ref')} AS r, {tokens_sql('hyp')} AS w FROM h0)"""

#: Word errors of every hypothesis: rows of the table of least costs, one after the other.
DISTANCES_SQL = f"""{HYPOTHESES_SQL},
d AS (SELECT id, model, r, w, 0 AS i, range(0, len(w) + 1) AS cost FROM h
      UNION ALL
      SELECT id, model, r, w, i + 1,
             list_transform(range(1, len(w) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k:
               (CASE WHEN k = 1 THEN i + 1 ELSE least(cost[k] + 1, cost[k - 1] + CASE WHEN r[i + 1] = w[k - 1] THEN 0 ELSE 1 END) END) - k)) + j)
      FROM d WHERE i < len(r)),
e AS (SELECT h.id, h.rid, h.run_id, h.model, len(h.r) AS n, len(h.w) AS m, d.cost[len(d.cost)] AS errors
      FROM h JOIN d ON d.id = h.id AND d.model = h.model AND d.i = len(h.r)),
s AS (SELECT *, CASE WHEN n > 0 THEN CAST(errors AS DOUBLE) / n WHEN m > 0 THEN 1.0 ELSE 0.0 END AS wer FROM e)"""
