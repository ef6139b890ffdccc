"""Clean speaker turns from raw transcript segments (problem 4).

Every segment is read by the finite-state line parser, which cuts it into pieces at
the names of speakers and strips times, notes and hesitations. A piece belongs to
the speaker named, else to the segment's ``speaker_id``, else to the speaker of the
last kept piece before it. Consecutive pieces of one speaker form a turn.

Recordings are cut into blocks of time, so that a recording that holds a third of
all rows is spread over tasks; the scans of ``operators.scans`` carry the speaker
and the number of turns from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.llm.canon import canonical_series
from vanikosh.llm.speech import LineParser
from vanikosh.operators.intervals import to_ms, usable
from vanikosh.operators.scans import fill_down, running_sum
from vanikosh.operators.stage import spread, stage
from vanikosh.session import ship_package

#: Length of a block in milliseconds; the text of a turn that runs over the end of a block comes out in parts.
BLOCK_MS = 3_600_000
#: Copies of each speaker's names, so that the names of a hot recording are looked up in several tasks.
SALT = 8

_ORDER = ["s", "e", "seg_id", "piece"]


def filler_terms(fillers: DataFrame, bound: int = 10_000) -> list[str]:
    """The hesitations of a small fixed table; more than ``bound`` of them are an error."""
    terms = [r.term for r in fillers.select("term").where("term is not null").distinct().orderBy("term").limit(bound + 1).collect()]
    if len(terms) > bound:
        raise ValueError(f"more than {bound} hesitations")
    return terms


def parse_segments(segments: DataFrame, fillers: list[str], text: bool) -> DataFrame:
    """Adds to ``rid, s, e, speaker_id, seg_id`` of each segment two hashes of its canonical text and its kept pieces
    (place, name, number of words and, if ``text``, the clean text)."""

    ship_package(segments.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = LineParser(fillers)
        for pdf in batches:
            forms = canonical_series(pdf["text"])
            pieces = [[{"piece": i, "ref": ref, "text": " ".join(w) if text else None} for i, (ref, w) in enumerate(parser.pieces(f)) if w] if f else [] for f in forms]
            yield pdf.drop(columns="text").assign(form=forms, pieces=pieces)

    cols = "rid string, s bigint, e bigint, speaker_id bigint, seg_id bigint"
    parsed = spread(segments.select("rid", "s", "e", "speaker_id", "seg_id", "text")).mapInPandas(
        lambda it: run(_whole(x) for x in it), cols + ", form string, pieces array<struct<piece:int,ref:string,text:string>>"
    )
    return parsed.withColumn("h1", F.xxhash64("form")).withColumn("h2", F.hash("form")).drop("form").where(F.size("pieces") > 0)


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nullable ids as integers, which pandas would otherwise turn into floats."""
    return pdf.assign(speaker_id=pdf["speaker_id"].astype("Int64"))


def speaker_names(speakers: DataFrame) -> DataFrame:
    """``rid, ref, named``: every way to name a speaker of a recording; of speakers that share one the smallest id."""
    low = F.lower(F.trim("role"))
    refs = F.array(F.concat(F.lit("n"), F.col("speaker_no").cast("string")), F.concat(F.lit("r"), low), F.concat(F.lit("i"), F.col("speaker_id").cast("string")))
    return (
        speakers.where("rid is not null and speaker_id is not null")
        .select("rid", "speaker_id", F.explode(refs).alias("ref"))
        .where("ref is not null")
        .groupBy("rid", "ref")
        .agg(F.min("speaker_id").alias("named"))
    )


def pieces(segments: DataFrame, speakers: DataFrame, fillers: list[str], text: bool = False, block: int = BLOCK_MS) -> DataFrame:
    """The kept pieces of usable segments, each once: ``rid, b, s, e, seg_id, piece, spoken_by`` (null if not known here) and ``text``.

    ``segments``: ``seg_id, rid, start, end, speaker_id, text``. Rows without a
    usable time, recording or text take no part; rows equal in recording, times,
    speaker and canonical text count once under the smallest ``seg_id``.
    """
    rows = segments.where(usable(F.col("start"), F.col("end")) & F.col("rid").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("rid", to_ms(F.col("start")).alias("s"), to_ms(F.col("end")).alias("e"), F.col("speaker_id").cast("bigint"), F.col("seg_id").cast("bigint"), "text")
    once = parse_segments(rows, fillers, text).groupBy("rid", "s", "e", "speaker_id", "h1", "h2").agg(F.min("seg_id").alias("seg_id"), F.min_by("pieces", "seg_id").alias("pieces"))
    each = once.select("rid", "s", "e", "speaker_id", "seg_id", F.explode("pieces").alias("p")).select("rid", "s", "e", "speaker_id", "seg_id", "p.*")
    salt = F.pmod(F.xxhash64("seg_id"), F.lit(SALT)).cast("int").alias("salt")
    names = speaker_names(speakers).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    # a segment without a name needs no look-up
    named = each.where("ref is not null").select("*", salt).join(names, ["rid", "ref", "salt"], "left").drop("salt")
    out = named.unionByName(each.where("ref is null").withColumn("named", F.lit(None).cast("bigint")))
    return out.select("rid", F.floor(F.col("s") / F.lit(block)).alias("b"), *_ORDER, F.coalesce("named", "speaker_id").alias("spoken_by"), *(["text"] if text else []))


def numbered_pieces(kept: DataFrame) -> DataFrame:
    """Adds ``speaker_id`` and the number of the turn (from 1) to staged pieces; drops pieces that no speaker precedes."""
    filled = fill_down(kept, ["rid"], "b", _ORDER, "spoken_by", "who", "before").where("who is not null")
    begins = F.when(F.col("who").eqNullSafe(F.col("before")), 0).otherwise(1)
    return running_sum(filled.drop("spoken_by"), ["rid"], "b", _ORDER, begins, "turn").withColumnRenamed("who", "speaker_id")


def turns(numbered: DataFrame) -> DataFrame:
    """``rid, turn, speaker_id, first_seg_id, last_seg_id, start_ms, end_ms``: one row per turn."""
    at = F.struct(*_ORDER)
    return numbered.groupBy("rid", "turn").agg(
        F.min("speaker_id").alias("speaker_id"), F.min_by("seg_id", at).alias("first_seg_id"), F.max_by("seg_id", at).alias("last_seg_id"),
        F.min("s").alias("start_ms"), F.max("e").alias("end_ms"),
    )


def _numbered(spark: SparkSession, sf_dir: str, text: bool) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    kept = pieces(read("rid_transcription"), read("speakers"), filler_terms(read("filler_terms")), text)
    return numbered_pieces(stage(kept, "p4-pieces"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two turns inside one segment can be equal in these columns
    return turns(_numbered(spark, sf_dir, False)).select("rid", "speaker_id", "first_seg_id", "last_seg_id").distinct()


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with their clean text; a turn that runs over several blocks of time has one row per block (``part``)."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, "text"))), lambda x: x["text"]), " ")
    return (
        _numbered(spark, sf_dir, True)
        .groupBy("rid", "turn", F.col("b").alias("part"))
        .agg(F.min("speaker_id").alias("speaker_id"), F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), said.alias("text"))
    )


QUERIES = {"p4_found": p4_found, "p4_turns": p4_turns}
