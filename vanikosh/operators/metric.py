"""The evaluation metric of recognisers whose references and outputs are lists of token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanikosh.functions.align import token_distance
from vanikosh.functions.text import normalized, tokens

#: Stands for a place of the references that takes no part; it becomes padding.
IGNORED = -100


def decoded(rows: DataFrame, ids: str, vocabulary: DataFrame, pad: int, special: tuple[int, ...] = ()) -> DataFrame:
    """``row, text``: the pieces of the ids in order. Padding, ``special`` and unknown ids have none; a null list gives ''.

    ``rows``: ``row`` (unique) and the id column; ``vocabulary``: ``id, piece``, a tokenizer's table.
    """
    each = rows.select("row", F.posexplode(F.transform(ids, lambda i: F.when(i == IGNORED, pad).otherwise(i))).alias("pos", "id"))
    said = each.where(~F.col("id").isin(pad, *special)).join(vocabulary.select("id", "piece"), "id")
    texts = said.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return rows.select("row").join(texts, "row", "left").select("row", F.coalesce("text", F.lit("")).alias("text"))


def corpus_metric(rows: DataFrame, vocabulary: DataFrame, pad: int, special: tuple[int, ...] = ()) -> DataFrame:
    """``wer``: word error rate of the corpus in per cent, half-even to 4 places; null if no reference has a word.

    ``rows``: ``row, label_ids, pred_ids``. Both sides are decoded and normalised.
    """
    both = decoded(rows, "label_ids", vocabulary, pad, special).withColumnRenamed("text", "ref").join(decoded(rows, "pred_ids", vocabulary, pad, special).withColumnRenamed("text", "hyp"), "row")
    pairs = both.select(tokens(normalized(F.col("ref"))).alias("r"), tokens(normalized(F.col("hyp"))).alias("h"))
    sums = pairs.agg(F.sum(token_distance(F.col("r"), F.col("h"))).alias("errors"), F.sum(F.size("r")).alias("words"))
    return sums.select(F.when(F.col("words") > 0, F.bround(100 * F.col("errors") / F.col("words"), 4)).alias("wer"))
