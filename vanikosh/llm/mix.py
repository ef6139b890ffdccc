"""Mixing sources to target weights (problem 7).

The total is the tokens of all documents; a source's budget is its share of it, or
what its documents give when each is used as often as allowed, if that is less.
Documents lie in pseudorandom order in their source. As many whole passes over the
source are taken as fit its budget; a last pass takes documents from the front
while they fit the rest, and then later ones until no unused document fits what is left.
The passes are packed into blocks of a fixed number of tokens. Each output shard has
a fixed number of slots; how many of them go to each source is a multinomial draw,
conditioned on each source's blocks being used up: given the totals, that is a draw
without replacement. It is drawn by halving: the counts of any shard follow from draws
seeded by its place in a binary tree, so that all tasks draw alike and none needs the
others. The slots of a source are numbered over the shards, and a pseudorandom
permutation of its block numbers maps slots to blocks, which are joined by number.
How often a document is used, and what each source gives, is counted in the blocks drawn.

Prefix sums run over hash buckets, so that a source of any size is spread over tasks.
Shards are drawn in volumes of ``VOLUME_SHARDS``, each with its proportion of every source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vanikosh.llm.bpe import encoded, token_counts
from vanikosh.operators.scans import running_sum
from vanikosh.operators.stage import stage
from vanikosh.session import ship_package

BLOCK_TOKENS = 2048
SHARD_BLOCKS = 1024
#: Shards of a volume: half a thousand million blocks, which the exact draw can handle.
VOLUME_SHARDS = 500_000
SEED = 20_240
#: Hash buckets of a source; each is ordered in one task.
BUCKETS = 4096
#: Most rows that the table of wanted shares may have; it is read to the driver.
MAX_SOURCES = 100_000


def sized_documents(documents: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """``row, doc_id, source, n_tokens`` (and ``ids``), with places (``bucket``, ``rank``) in the source's pseudorandom order, staged.

    ``row`` numbers the rows, so that documents that come again under one ``doc_id`` stay apart.
    """
    keep = ("doc_id", "source")
    sized = encoded(documents, path, keep=keep).withColumn("n_tokens", F.size("ids").cast("bigint")) if ids else token_counts(documents, path, keep=keep)
    return placed(stage(sized.withColumn("row", F.monotonically_increasing_id()), "p7-sizes"))


def placed(sized: DataFrame) -> DataFrame:
    rank = F.xxhash64("doc_id", F.lit(SEED))
    return sized.withColumn("bucket", F.shiftright(rank, 64 - BUCKETS.bit_length() + 1)).withColumn("rank", rank)


def source_plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """What each wanted source shall give; a row per source on the driver, whose number is bounded by ``MAX_SOURCES``.

    A null share counts as 0 and a null ``max_repeats`` as 1; of repeated sources the first by share is taken.
    """
    wanted = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("most"))
    wanted = wanted.groupBy("source").agg(F.max(F.struct("share", "most")).alias("w")).select("source", "w.*").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = {r.source: (r.n, r.docs) for r in sized.join(F.broadcast(sized.sparkSession.createDataFrame([(r.source,) for r in wanted], "source string")), "source").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()} if wanted else {}
    total = sized.agg(F.sum("n_tokens").alias("n")).first().n or 0
    plan = []
    for r in sorted(wanted, key=lambda r: r.source):
        size, docs = have.get(r.source, (0, 0))
        budget = max(0.0, r.share) * total
        passes = min(int(budget // size), r.most) if size else 0
        rest = budget - passes * size if size and passes < r.most else 0.0
        plan.append({"source": r.source, "share": float(r.share), "most": int(r.most), "size": int(size), "docs": int(docs), "budget": float(budget), "passes": passes, "rest": float(rest), "total": int(total)})
    return plan


_PLAN = "source string, share double, most int, size bigint, docs bigint, budget double, passes int, rest double, total bigint"


def passes(sized: DataFrame, plan: list[dict]) -> DataFrame:
    """``row, doc_id, source, n_tokens`` of the documents of wanted sources that have tokens, staged, with the number of whole passes
    (``passes``), whether the last pass has the document (``last``), and the numbers of the source's tokens in front of it in a
    whole (``at``) and in the last pass (``at_last``)."""
    spark = sized.sparkSession
    order = ["rank", "row"]
    small = F.broadcast(spark.createDataFrame(_rows(plan), _PLAN).select("source", "passes", "rest"))  # at most MAX_SOURCES rows
    rows = sized.where("n_tokens > 0").select("row", "doc_id", "source", "n_tokens", "bucket", "rank")
    named = running_sum(rows.join(small, "source"), ["source"], "bucket", order, F.col("n_tokens"), "upto")
    named = stage(named.withColumn("last", (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))), "p7-pass")
    while True:
        # a row per wanted source: what is left of its last pass, and the least document not in it
        left = named.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("last"), F.col("n_tokens")).otherwise(0))).alias("gap"), F.min(F.when(~F.col("last"), F.col("n_tokens"))).alias("least"))
        gaps = [(r.source, r.gap) for r in left.where("least <= gap").collect()]
        if not gaps:
            break
        gap = F.broadcast(spark.createDataFrame(gaps, "source string, gap double"))
        fits = named.join(gap, "source").where(~F.col("last") & (F.col("n_tokens") <= F.col("gap")))
        more = running_sum(fits, ["source"], "bucket", order, F.col("n_tokens"), "more").where("more <= gap").select("row", F.lit(True).alias("more"))
        named = stage(named.join(more, "row", "left").withColumn("last", F.col("last") | F.coalesce("more", F.lit(False))).drop("more"), "p7-pass")
    taken = F.when(F.col("last"), F.col("n_tokens")).otherwise(0)
    out = running_sum(named, ["source"], "bucket", order, taken, "upto_last")
    return stage(out.select("row", "doc_id", "source", "n_tokens", "passes", "last", (F.col("upto") - F.col("n_tokens")).alias("at"), (F.col("upto_last") - taken).alias("at_last")), "p7-pass")


def _rows(plan: list[dict]) -> list[tuple]:
    return [tuple(p[c.split(" ")[0]] for c in _PLAN.split(", ")) for p in plan]


def shares(drawn: DataFrame, plan: list[dict]) -> DataFrame:
    """Per wanted source its target and what the blocks drawn give: ``actual_share`` of the total of all documents, and ``mix_share`` of the mixture."""
    planned = drawn.sparkSession.createDataFrame(_rows(plan), _PLAN)
    given = drawn.groupBy("source", "row").agg(F.sum("n_tokens").alias("n"), F.countDistinct("pass").alias("times")).groupBy("source").agg(F.sum("n").alias("given"), F.max("times").alias("max_times"))
    out = planned.join(given, "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    whole = F.sum("given").over(Window.partitionBy())  # one row per source
    return out.select(
        "source", F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), "docs", F.col("size").alias("source_tokens"),
        F.round("budget").cast("bigint").alias("target_tokens"), F.col("given").alias("tokens"), F.coalesce("max_times", F.lit(0)).alias("max_times"),
        share(F.col("given"), F.col("total")).alias("actual_share"), share(F.col("given"), whole).alias("mix_share"),
        (F.col("size") * F.col("most") < F.col("budget")).alias("short"),
    )


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds on the next even power of two, walked until inside."""
    if n <= 1:
        return np.zeros_like(x)
    half = (max(2, int(n - 1).bit_length()) + 1) // 2
    mask = np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        v = out[todo]
        a, b = v >> np.uint64(half), v & mask
        for turn in range(4):
            mixed = (b + np.uint64((key * 1_000_003 + turn * 7919 + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, (a ^ (mixed >> np.uint64(31))) & mask
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def volume_counts(counts: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The blocks of each source in every volume of ``blocks`` blocks, in proportion to what is left."""
    left, out = counts.copy(), []
    while left.sum() > blocks:
        exact = [(int(n) * blocks, int(left.sum())) for n in left]
        take = np.array([a // b for a, b in exact], np.int64)
        over = sorted(range(len(left)), key=lambda i: (-(exact[i][0] % exact[i][1]), i))[: blocks - int(take.sum())]
        take[over] += 1
        out.append(take)
        left = left - take
    return [*out, left]


def shard_counts(counts: np.ndarray, shard: int, shards: int, shard_blocks: int, seed: int, volume_shards: int = VOLUME_SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source in a shard, and in all shards before it."""
    volumes = volume_counts(counts, volume_shards * shard_blocks)
    volume, shard = divmod(shard, volume_shards)
    before, counts = sum(volumes[:volume], np.zeros_like(counts)), volumes[volume]
    low, high = 0, min(volume_shards, shards - volume * volume_shards)
    total = int(counts.sum())
    while high - low > 1:
        mid = (low + high) // 2
        draw = np.random.default_rng((seed, volume, low, high))
        left = draw.multivariate_hypergeometric(counts, min(mid * shard_blocks, total) - low * shard_blocks, method="marginals")
        if shard < mid:
            counts, high = left, mid
        else:
            before, counts, low = before + left, counts - left, mid
    return counts, before


def slots(spark: SparkSession, blocks: list[tuple[str, int]], shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """``shard, slot, source, block``: every block of every source once. ``blocks``: source and number of its blocks."""
    ship_package(spark)
    names = [s for s, n in blocks if n > 0]
    counts = np.array([n for _, n in blocks if n > 0], np.int64)
    shards = -(-int(counts.sum()) // shard_blocks)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"].tolist():
                take, before = shard_counts(counts, shard, shards, shard_blocks, seed)
                begin = np.cumsum(take) - take
                for i in np.flatnonzero(take).tolist():
                    number = before[i] + np.arange(take[i])
                    yield pd.DataFrame({"shard": shard, "slot": begin[i] + np.arange(take[i]), "source": names[i], "block": permute(number, int(counts[i]), seed + i)})

    return spark.range(shards).mapInPandas(fill, "shard long, slot long, source string, block long")


def packed(used: DataFrame, plan: list[dict], block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The pieces of documents in every block, and the number of blocks of each source.

    The passes over a source follow each other without a gap, so only its last block
    can be short. Rows: ``source, block, offset, row, doc_id, pass, first_token, n_tokens``.
    """
    spark = used.sparkSession
    times = F.col("passes") + F.col("last").cast("int")
    ends = {r.source: r.n for r in used.groupBy("source").agg(F.sum(F.col("n_tokens") * times).alias("n")).collect()}  # a row per wanted source
    sizes = F.broadcast(spark.createDataFrame([(p["source"], p["size"]) for p in plan], "source string, pass_tokens long"))
    each = used.where(times > 0).join(sizes, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), times - 1)))
    begin = F.col("pass") * F.col("pass_tokens") + F.when(F.col("pass") < F.col("passes"), F.col("at")).otherwise(F.col("at_last"))
    each = each.select("source", "row", "doc_id", "pass", begin.alias("begin"), (begin + F.col("n_tokens")).alias("end"))
    block = F.explode(F.sequence(F.floor(F.col("begin") / block_tokens), F.floor((F.col("end") - 1) / block_tokens)))
    cut = each.select("*", block.alias("block"))
    low, high = F.greatest("begin", F.col("block") * block_tokens), F.least("end", (F.col("block") + 1) * block_tokens)
    rows = cut.select("source", "block", (low - F.col("block") * block_tokens).alias("offset"), "row", "doc_id", "pass", (low - F.col("begin")).alias("first_token"), (high - low).alias("n_tokens"))
    return rows, [(p["source"], -(-ends.get(p["source"], 0) // block_tokens)) for p in plan]


def drawn_pieces(used: DataFrame, plan: list[dict], block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``shard, slot`` and the pieces of documents of the blocks drawn for them, joined by the block's number."""
    rows, blocks = packed(used, plan, block_tokens)
    return slots(used.sparkSession, blocks, shard_blocks).join(rows, ["source", "block"])


def usage(sized: DataFrame, drawn: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, times`` of every document: how often the blocks drawn hold it whole. A document without tokens,
    of no wanted source, or left out, is used 0 times."""
    times = drawn.groupBy("row").agg(F.sum("n_tokens").alias("given"))
    out = sized.select("row", "doc_id", "source", "n_tokens").join(times, "row", "left")
    return out.select("doc_id", "source", "n_tokens", F.coalesce((F.col("given") / F.col("n_tokens")).cast("int"), F.lit(0)).alias("times"))


def token_blocks(sized: DataFrame, drawn: DataFrame) -> DataFrame:
    """``shard, slot, source, block, ids, pieces``: the blocks drawn with their token ids (at most a block's) and where these are from."""
    piece = drawn.join(sized.select("row", "ids"), "row").withColumn("ids", F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")))
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "pass", "first_token", "n_tokens", "ids")))  # pieces of one block
    blocks = piece.groupBy("shard", "slot", "source", "block").agg(parts.alias("parts"))
    return blocks.select("shard", "slot", "source", "block", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: p.dropFields("offset", "ids")).alias("pieces"))


def _prepare(spark: SparkSession, sf_dir: str, ids: bool = False) -> tuple[DataFrame, DataFrame, list[dict]]:
    sized = sized_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=ids)
    plan = source_plan(sized, spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))
    return sized, drawn_pieces(passes(sized, plan), plan), plan


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    sized, drawn, _ = _prepare(spark, sf_dir)
    return usage(sized, drawn)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share."""
    _, drawn, plan = _prepare(spark, sf_dir)
    return shares(drawn, plan)


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: for every slot of every shard its block of token ids, and the pieces of documents these are from."""
    sized, drawn, _ = _prepare(spark, sf_dir, ids=True)
    return token_blocks(sized, drawn)


QUERIES = {"p7_usage": p7_usage, "p7_shares": p7_shares, "p7_blocks": p7_blocks}
