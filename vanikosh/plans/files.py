"""Queries that go through files, and tables generated from the texts in code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.functions.numbers import normalize_numbers
from vanikosh.operators.lattice import evaluate
from vanikosh.operators.stage import scratch
from vanikosh.plans import quality
from vanikosh.plans.cleanup import numbers_sql
from vanikosh.plans.tables import norm_sql, read
from vanikosh.plans.words import lm_corpus
from vanikosh.sources import samples
from vanikosh.sources.writers import CSV, write_batches, write_csv, write_json, write_lines

_COLUMNS = "id bigint, rid string, run_id string, reference string, baseline_pred string, ft_pred string"


def json_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions, texts and all, after they went through JSON lines, CSV and Parquet batches."""
    df = read(spark, sf_dir, "predictions", "id", "rid", "run_id", "reference", "baseline_pred", "ft_pred")
    base = scratch(spark, "roundtrip")
    write_json(df, f"{base}/json")
    write_csv(df, f"{base}/csv")
    write_batches(df, f"{base}/parquet")
    back = {
        "json": spark.read.schema(_COLUMNS).json(f"{base}/json"),
        "csv": spark.read.schema(_COLUMNS).options(**CSV).csv(f"{base}/csv"),
        "parquet": spark.read.parquet(f"{base}/parquet"),
    }
    out = None
    for name, table in back.items():
        part = table.select(F.lit(name).alias("format"), "id", "rid", "run_id", "reference", "baseline_pred", "ft_pred")
        out = part if out is None else out.unionByName(part)
    return out


def lm_corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's corpus read back from its text files: lines and their counts."""
    path = scratch(spark, "lm")
    write_lines(lm_corpus(spark, sf_dir), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def replicated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence pairs in turn; the baseline is blank in 30 of 100."""
    return samples.replicated_pairs(spark)


def cycled_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences in code in turn, 200 rows, with durations."""
    return samples.cycled(spark, samples.TRANSCRIPTS, 200)


def idiom_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of number words inside and outside of phrases that keep them."""
    texts = spark.createDataFrame(list(enumerate(samples.NUMBER_TEXTS)), "seg_id bigint, text string").select("seg_id", normalize_numbers(F.col("text")).alias("n"))
    kept = F.size(F.filter("n.changes", lambda c: c["action"].startswith("KEPT")))
    return texts.select("seg_id", F.col("n.text").alias("normed"), F.size("n.changes").cast("bigint").alias("runs"), kept.cast("bigint").alias("kept"))


def taxonomy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit operation with its category, through the JSON report and back."""
    path = scratch(spark, "taxonomy")
    ops = quality.edit_ops(spark, sf_dir)
    write_json(ops, path)
    return spark.read.schema(ops.schema).json(path)


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reports through CSV files of their own and back: sampled errors, results of repair, rates by run; a row per cell."""
    reports = {"sampled_errors": (quality.sample_display, "id"), "fix_results": (quality.repair_delta, "cat"), "wer_table": (quality.corpus_wer_by_run, "run_id")}
    out = None
    for name, (query, key) in reports.items():
        path, df = scratch(spark, name), query(spark, sf_dir)
        write_csv(df, path, one_file=True)
        back = spark.read.schema(df.schema).options(**CSV).csv(path)
        key_text = F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("-")), *(["model"] if "model" in df.columns else []))
        cells = F.array(*[F.struct(F.lit(c).alias("column"), _shown(df, c).alias("value")) for c in df.columns if c not in (key, "model")])
        part = back.select(F.lit(name).alias("report"), key_text.alias("key"), F.explode(cells).alias("c")).select("report", "key", "c.column", "c.value")
        out = part if out is None else out.unionByName(part)
    return out


def _shown(df: DataFrame, column: str) -> Column:
    """A cell as text: numbers in ten-thousandths, so that any SQL writes them alike."""
    kind = df.schema[column].dataType.typeName()
    return F.round(F.col(column) * 10_000).cast("bigint").cast("string") if kind == "double" else F.col(column).cast("string")


def lattice_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard and lattice rates of the small examples in code."""
    return evaluate(samples.lattice_samples(spark), ["utt"])


QUERIES = {f.__name__: f for f in (json_csv_roundtrip, lm_corpus_file, replicated_predictions, cycled_transcripts, idiom_examples, taxonomy_file, report_files, lattice_examples)}

_RATES = {"Ex1": (0.25, 0.0, 0.5, 0.5, 0.25, 0.25, 0.25, 0.25, 0.0, 0.0), "Ex2": (0.2, 0.0, 0.2, 0.0, 0.2, 0.0, 0.2, 0.0, 0.0, 0.0), "Ex3": (0.0, 0.0, 0.25, 0.0, 0.25, 0.25, 0.25, 0.25, 0.25, 0.25), "Ex4": (0.1667, 0.0, 0.0, 0.0, 0.1667, 0.0, 0.1667, 0.1667, 0.1667, 0.0)}
_ROWS = ", ".join(f"('{u}', '{m}', CAST({r[2 * i]} AS DOUBLE), CAST({r[2 * i + 1]} AS DOUBLE))" for u, r in _RATES.items() for i, m in enumerate("ABCDE"))

_PAIRS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(samples.ERROR_PAIRS))

_SHARE_SQL = "CAST('0x' || left(md5(CAST(i AS VARCHAR)), 8) AS BIGINT) / 4294967296.0"
_TRANSCRIPTS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(samples.TRANSCRIPTS))
_NUMBER_TEXTS = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(samples.NUMBER_TEXTS)) + ") r(seg_id, text)"
_CELL = lambda q, name, key, column, value: f"SELECT '{name}' AS report, {key} AS key, '{column}' AS column, {value} AS value FROM ({q})"
_DOUBLE = lambda c: f"CAST(CAST(round({c} * 10000) AS BIGINT) AS VARCHAR)"
_TEXT = lambda c: f"CAST({c} AS VARCHAR)"
_REPORTS = [
    _CELL(quality.SQL[query], name, key, column, show(column))
    for name, query, key, columns in (
        ("sampled_errors", "sample_display", "CAST(id AS VARCHAR)", (("severity", _TEXT), ("wer", _DOUBLE), ("reference", _TEXT), ("prediction", _TEXT))),
        ("fix_results", "repair_delta", "cat", (("utterances", _TEXT), ("before", _DOUBLE), ("after", _DOUBLE), ("delta", _DOUBLE))),
        ("wer_table", "corpus_wer_by_run", "coalesce(run_id, '-') || ' ' || model", (("utterances", _TEXT), ("errors", _TEXT), ("words", _TEXT), ("wer", _DOUBLE))),
    )
    for column, show in columns
]

SQL = {
    "cycled_transcripts": f"SELECT i AS id, text, floor(4000 + 14000 * ({_SHARE_SQL})) / 1000 AS duration FROM (SELECT i, {norm_sql('t')} AS text FROM range(200) g(i) JOIN (VALUES {_TRANSCRIPTS}) v(k, t) ON k = i % 30) WHERE text <> ''",
    "idiom_examples": f"""
WITH RECURSIVE {numbers_sql(_NUMBER_TEXTS)}
SELECT n.seg_id, n.normed, count(y.seg_id) AS runs, count(*) FILTER (y.kept) AS kept FROM n LEFT JOIN y USING (seg_id) GROUP BY ALL""",
    "taxonomy_file": quality.SQL["edit_ops"],
    "report_files": " UNION ALL ".join(_REPORTS),
    "replicated_predictions": f"SELECT i AS id, {norm_sql('a')} AS reference, CASE WHEN {_SHARE_SQL} < 0.3 THEN '' ELSE {norm_sql('b')} END AS baseline_pred, {norm_sql('b')} AS ft_pred FROM range(350) g(i) JOIN (VALUES {_PAIRS}) v(k, a, b) ON k = i % 20",
    "json_csv_roundtrip": """
SELECT format, id, rid, run_id, reference, baseline_pred, ft_pred
FROM predictions, (VALUES ('json'), ('csv'), ('parquet')) v(format)""",
    "lm_corpus_file": f"""
WITH p AS (SELECT {norm_sql('text')} AS line FROM rid_transcription UNION ALL SELECT {norm_sql('reference')} FROM predictions)
SELECT line, count(*) AS n FROM p WHERE line <> '' GROUP BY line""",
    "lattice_examples": f"SELECT utt, model, standard_wer, lattice_wer, lattice_wer < standard_wer AS unfair FROM (VALUES {_ROWS}) v(utt, model, standard_wer, lattice_wer)",
}
