"""Ordered scans over keys of any size.

A running sum or fill-down in one window per key puts a hot key into one task.
Here every key is cut into blocks; the scan runs within blocks, which are spread
over all tasks, and one row per block carries its result to the later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inner(keys: list[str], block: str, order: list[str]):
    return Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: list[str], block: str):
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` from the key's first row to this one. ``order`` must rise with ``block``."""
    df = df.withColumn("_value", value)
    carry = df.groupBy(*keys, block).agg(F.sum("_value").alias("_total")).select(*keys, block, F.coalesce(F.sum("_total").over(_before(keys, block)), F.lit(0)).alias("_carry"))
    here = df.withColumn("_here", F.sum("_value").over(_inner(keys, block, order)))
    return here.join(carry, [*keys, block]).withColumn(out, F.col("_here") + F.col("_carry")).drop("_value", "_here", "_carry")


def fill_down(df: DataFrame, keys: list[str], block: str, order: list[str], value: str, filled: str, previous: str) -> DataFrame:
    """Adds ``filled``: the last non-null ``value`` up to this row, and ``previous``: the one before this row, null if there is none."""
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    blocks = df.groupBy(*keys, block).agg(last.alias("_last"))
    carry = blocks.select(*keys, block, F.last("_last", ignorenulls=True).over(_before(keys, block)).alias("_carry"))
    inner = _inner(keys, block, order)
    here = df.withColumn("_here", F.last(value, ignorenulls=True).over(inner)).withColumn("_prev", F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    return (
        here.join(carry, [*keys, block])
        .withColumn(filled, F.coalesce("_here", "_carry"))
        .withColumn(previous, F.coalesce("_prev", "_carry"))
        .drop("_here", "_prev", "_carry")
    )
