"""Lattices of accepted words, built from the votes of several recognisers, and the error rates against them.

Everything is keyed by the utterance: aligned tokens are counted per position, words
that enough models agree on join the reference's word in its bin with their numeric
and spelling variants, and the bins of an utterance form its lattice.

Hypotheses are aligned once and staged. Votes are counted before they are moved, so an
utterance with very many models is spread over tasks; what is then gathered per
utterance is bounded by the different words said at its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanikosh.functions.align import align_tokens, lattice_error_rate, word_error_rate
from vanikosh.functions.errors import spelling_variants
from vanikosh.functions.numbers import numeric_equivalents
from vanikosh.functions.text import tokens
from vanikosh.operators.stage import stage

#: Share of the models that must agree on a word, or on leaving one out.
TRUST = 0.60


def hypotheses_of(references: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ref, model, hyp``: every output with the reference of its utterance.

    ``references``: ``keys, ref``, one row per utterance (of several the least ``ref`` is taken, a null one counts as '').
    ``outputs``: ``keys, model, hyp``. An output without a reference and a reference without outputs have no row.
    """
    once = references.groupBy(*keys).agg(F.min(F.coalesce("ref", F.lit(""))).alias("ref"))
    return outputs.select(*keys, "model", "hyp").join(once, keys).select(*keys, "ref", "model", "hyp")


def aligned(hyps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, model, r, h, said``: tokens of reference and hypothesis, and what the hypothesis says in place of each token
    of the reference, '' if it leaves it out. ``hyps``: ``keys``, ``ref``, ``model``, ``hyp``. Staged."""
    pairs = hyps.select(*keys, "model", tokens(F.col("ref")).alias("r"), tokens(F.col("hyp")).alias("h"))
    said = F.transform(F.filter(align_tokens(F.col("r"), F.col("h")), lambda p: p["ref"].isNotNull()), lambda p: F.coalesce(p["hyp"], F.lit("")))
    return stage(pairs.select(*keys, "model", "r", "h", said.alias("said")), "lattice")


def _votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    each = rows.select(*keys, F.posexplode(F.arrays_zip("r", "said")).alias("pos", "x"))
    return each.groupBy(*keys, "pos", F.col("x.r").alias("ref_token"), F.col("x.said").alias("token")).agg(F.count(F.lit(1)).alias("votes"))


def position_votes(hyps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, token, votes``: what the models say in place of each token of the reference; '' if they leave it out.

    Added tokens belong to no position.
    """
    return _votes(aligned(hyps, keys), keys).select(*keys, "pos", "token", "votes")


def _forms(token: Column) -> Column:
    return F.array_union(numeric_equivalents(token), spelling_variants(token))


def lattices(rows: DataFrame, keys: list[str], trust: float = TRUST) -> DataFrame:
    """``keys, bins``: per utterance ``array<struct(pos, ref_token, alternatives)>`` in order of position, from ``aligned`` rows.

    Every model has one vote per position, so the votes of a position add up to the models.
    """
    counted = F.collect_list(F.struct("pos", "ref_token", "token", "votes"))  # the different words at the positions
    spots = _votes(rows, keys).groupBy(*keys).agg(counted.alias("v"))

    def bin_of(pos: Column) -> Column:
        here = F.filter("v", lambda x: x["pos"] == pos)
        models = F.aggregate(here, F.lit(0).cast("bigint"), lambda a, x: a + x["votes"])
        trusted = F.transform(F.filter(here, lambda x: x["votes"] / models >= trust), lambda x: x["token"])
        own = F.element_at(here, 1)["ref_token"]
        alternatives = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_union(F.array(own), trusted), _forms))))
        return F.struct(pos.alias("pos"), own.alias("ref_token"), alternatives.alias("alternatives"))

    return spots.select(*keys, F.transform(F.array_sort(F.array_distinct("v.pos")), bin_of).alias("bins"))


def lattice_bins(hyps: DataFrame, keys: list[str], trust: float = TRUST) -> DataFrame:
    """``keys, pos, ref_token, alternatives``: the accepted words of each position, in order; '' if it may be left out.

    A reference without tokens has no bins.
    """
    return lattices(aligned(hyps, keys), keys, trust).select(*keys, F.explode("bins").alias("b")).select(*keys, "b.*")


def evaluate(hyps: DataFrame, keys: list[str], trust: float = TRUST) -> DataFrame:
    """``keys, model, standard_wer, lattice_wer, unfair`` of each hypothesis, rates half-even to 4 places."""
    rows = aligned(hyps, keys)
    empty = F.array().cast("array<array<string>>")
    scored = rows.drop("said").join(lattices(rows, keys, trust), keys, "left").withColumn("b", F.coalesce("bins.alternatives", empty))
    rates = scored.select(*keys, "model", F.bround(word_error_rate(F.col("r"), F.col("h")), 4).alias("standard_wer"), F.bround(lattice_error_rate(F.col("h"), F.col("b")), 4).alias("lattice_wer"))
    return rates.withColumn("unfair", F.col("lattice_wer") < F.col("standard_wer"))
