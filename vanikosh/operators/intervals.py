"""Continuous periods and gaps of overlapping intervals (problem 2).

Sweep line: every interval becomes a plus and a minus event, the events of one
key and instant are summed, a prefix sum gives the number of intervals open after
each instant, and the instants at which it leaves or reaches zero bound the
periods and the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.operators.scans import running_sum

#: Length of the blocks into which long keys are cut, in units of the times.
BLOCK_MS = 3_600_000


def usable(start: Column, end: Column) -> Column:
    """Both are present, numbers (not NaN) and finite, ``start`` isn't below 0 and ``end`` is after it."""
    known = start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end)
    return known & (start >= 0) & (end > start) & to_ms(start).isNotNull() & to_ms(end).isNotNull()


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds; null where they don't fit 64 bits, as for infinity."""
    ms = F.round(seconds * 1000)
    return F.when(F.abs(ms) < 9e18, ms.try_cast("bigint"))


def periods_and_gaps(intervals: DataFrame, key: str, start: str, end: str, block: int = BLOCK_MS) -> DataFrame:
    """``key, kind, start, end``: one row per continuous period (``period``) and per gap between two of them (``gap``).

    ``start`` and ``end`` are whole numbers, ``start <= end``; rows with a null in
    any of the three columns take no part, repeated rows change nothing, other
    columns are ignored. Intervals that overlap, nest or touch form one period; an
    interval of no length outside all others is a period of no length. Events are
    pre-aggregated per instant, and long keys are cut into blocks of ``block`` units.
    """
    rows = intervals.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).where("k is not null and s is not null and e is not null")
    events = (
        rows.select("k", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("plus"), F.lit(0).alias("minus")), F.struct(F.col("e").alias("t"), F.lit(0).alias("plus"), F.lit(1).alias("minus")))).alias("x"))
        .select("k", F.floor(F.col("x.t") / F.lit(block)).alias("b"), F.col("x.t").alias("t"), F.col("x.plus").alias("plus"), F.col("x.minus").alias("minus"))
        .repartition("k", "b")  # what follows within blocks stays where it is
        .groupBy("k", "b", "t")
        .agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))
    )
    swept = running_sum(events, ["k"], "b", ["t"], F.col("plus") - F.col("minus"), "open")
    edges = swept.select(
        "k", "b", "t",
        ((F.col("plus") > 0) & (F.col("open") - F.col("plus") + F.col("minus") == 0)).alias("begins"),
        ((F.col("minus") > 0) & (F.col("open") == 0)).alias("ends"),
    ).where("begins or ends")
    numbered = running_sum(edges, ["k"], "b", ["t"], F.col("begins").cast("int"), "n")
    period, gap = F.lit("period").alias("kind"), F.lit("gap").alias("kind")
    none = F.lit(None).cast("bigint")
    side = lambda kind, n, s, e: F.struct(kind, n.cast("bigint").alias("n"), s.alias("s"), e.alias("e"))
    n, t = F.col("n"), F.col("t")
    begun = F.array(side(period, n, t, none), side(gap, n - 1, none, t))
    ended = F.array(side(period, n, none, t), side(gap, n, t, none))
    sides = F.concat(F.when(F.col("begins"), begun).otherwise(F.slice(begun, 1, 0)), F.when(F.col("ends"), ended).otherwise(F.slice(ended, 1, 0)))
    return (
        numbered.select("k", F.explode(sides).alias("x"))
        .groupBy("k", "x.kind", "x.n")
        .agg(F.min("x.s").alias("s"), F.max("x.e").alias("e"))
        .where("s is not null and e is not null")
        .select(F.col("k").alias(key), "kind", F.col("s").alias(start), F.col("e").alias(end))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of speech and silences of each recording, in whole milliseconds; rows whose times are not usable take no part."""
    rows = spark.read.parquet(f"{sf_dir}/rid_transcription.parquet").select("rid", "start", "end")
    ms = rows.where(usable(F.col("start"), F.col("end"))).select("rid", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"))
    return periods_and_gaps(ms, "rid", "start_ms", "end_ms").select("rid", "kind", "start_ms", "end_ms")


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": """
WITH u AS (
  SELECT rid, CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM rid_transcription
  WHERE rid IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND isfinite("start") AND isfinite("end")
    AND "start" >= 0 AND "end" > "start"),
m AS (SELECT rid, s, e, max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
g AS (SELECT rid, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM m),
p AS (SELECT rid, n, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY rid, n)
SELECT rid, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL
SELECT rid, 'gap' AS kind, prev_end AS start_ms, start_ms AS end_ms
FROM (SELECT rid, start_ms, lag(end_ms) OVER (PARTITION BY rid ORDER BY n) AS prev_end FROM p) WHERE prev_end IS NOT NULL
"""
}
