"""Occurrences and records of every distinct term, with marks for the rare and the common (problem 3).

Blocks of rows are counted where they lie: a block numbers its terms, turns its rows
into arrays of those integers, and accumulates two count arrays over them, one of
occurrences and one of records. The blocks' arrays then go to identifier ranges, which
share the terms by hash; there the terms, in order, form the range's part of the
global integer dictionary, and the counts of all blocks are summed into its arrays.
A range is read as a sorted stream, so neither its size nor the number of blocks is
bounded by a task's memory, and an identifier depends on the terms only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.llm.canon import canonical, canonical_column
from vanikosh.llm.tokentable import TokenTable, portions
from vanikosh.operators.stage import spread
from vanikosh.session import ship_package

#: A term is rare in fewer records than this, and common in more than this share of all records.
RARE_BELOW = 3
COMMON_OVER = 0.1
#: Distinct tokens after which a block is closed, which bounds the memory of a task.
BLOCK_TERMS = 300_000
#: Identifier ranges; a term's identifier is the number of its range times 2**32 plus its place there.
RANGES = 4096

_PARTIAL = "term string, occurrences bigint, records bigint"


def trimmed_term(token: str) -> str:
    """The token without leading and trailing characters that are not letters, marks or numbers; may be empty."""
    a, b = 0, len(token)
    while a < b and not _inner(token[a]):
        a += 1
    while b > a and not _inner(token[b - 1]):
        b -= 1
    return token[a:b]


def _inner(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c)[0] in "LMN"


def _terms_of(token: str) -> tuple[list[str], int]:
    return [term for part in canonical(token, "lower").split(" ") if (term := trimmed_term(part))], 0


def _value(value: str) -> tuple[list[str], int]:
    return [value], 0


class Block:
    """The two count arrays of a block over the numbers of its terms."""

    def __init__(self, parse, memory: int = BLOCK_TERMS):
        self.table = TokenTable(parse, memory)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.occurrences, self.records = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, terms: np.ndarray, times: np.ndarray | None, present: np.ndarray) -> None:
        """Numbers of terms, how often each comes (None: once), and the numbers of terms once per record that has them."""
        size = len(self.table.words)
        grown = [np.pad(a, (0, size - len(a))) for a in (self.occurrences, self.records)]
        said = np.bincount(terms, minlength=size) if times is None else np.bincount(terms, times, size).astype(np.int64)
        self.occurrences, self.records = grown[0] + said, grown[1] + np.bincount(present, minlength=size)

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame({"term": pd.Series(self.table.words, dtype=object), "occurrences": self.occurrences, "records": self.records})
        self.clear()
        return out


def text_counts(texts: DataFrame, column: str) -> DataFrame:
    """Partial counts ``term, occurrences, records`` of the terms of a text column; every row with a text is a record."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(_terms_of)
        for pdf in batches:
            rows = pdf["text"].tolist()
            for part in portions(rows):
                if block.table.full:
                    yield block.frame()
                of, terms, _ = block.table.read(rows[part])
                width = max(1, len(block.table.words))
                block.add(terms, None, np.unique(of * width + terms) % width)
        yield block.frame()

    return spread(texts.select(F.col(column).alias("text")).where("text is not null")).mapInPandas(run, _PARTIAL)


def value_counts(values: DataFrame, column: str, record: str) -> DataFrame:
    """Partial counts of whole values; a record is a distinct ``record``. Rows with a null ``record`` count as occurrences only."""
    ship_package(values.sparkSession)
    form = F.lower(canonical_column(F.col(column)))
    each = values.select(F.col(record).alias("record"), form.alias("term")).where("term is not null and term <> ''")
    once = each.groupBy("record", "term").agg(F.count(F.lit(1)).alias("times")).select("term", "times", F.col("record").isNotNull().alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(_value)
        for pdf in batches:
            if block.table.full:
                yield block.frame()
            terms = block.table.numbers_of(pdf["term"].tolist())
            block.add(terms, pdf["times"].to_numpy(), terms[pdf["held"].to_numpy(bool)])
        yield block.frame()

    return once.mapInPandas(run, _PARTIAL)


def sum_by_range(partial: DataFrame, keys: str) -> DataFrame:
    """Sums partial counts: ``keys``, ``term_id``, ``term``, ``occurrences``, ``records``, one row per key and term."""
    ship_package(partial.sparkSession)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, place = None, None, 0  # the unfinished term, the range at hand, and the place of its next term
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            field, number, term = (pdf[c].to_numpy() for c in (keys, "range", "term"))
            new_range = np.concatenate([[True], (field[1:] != field[:-1]) | (number[1:] != number[:-1])])
            starts = np.flatnonzero(new_range | np.concatenate([[True], term[1:] != term[:-1]]))
            sums = [np.add.reduceat(pdf[c].to_numpy(), starts) for c in ("occurrences", "records")]
            held = pdf.iloc[[starts[-1]]].assign(occurrences=sums[0][-1], records=sums[1][-1])
            done = starts[:-1]
            if len(done):
                first = new_range[done].copy()
                first[0] = (field[0], number[0]) != last
                at = np.arange(len(done))
                begin = np.maximum.accumulate(np.where(first, at, 0))
                places = at - begin + np.where(np.cumsum(first) == 0, place, 0)
                last, place = (field[done[-1]], number[done[-1]]), int(places[-1]) + 1
                yield pd.DataFrame({keys: field[done], "term_id": number[done].astype(np.int64) << np.int64(32) | places, "term": term[done], "occurrences": sums[0][:-1], "records": sums[1][:-1]})
        if held is not None:
            row = held.iloc[0]
            place = place if (row[keys], row["range"]) == last else 0
            yield pd.DataFrame({keys: [row[keys]], "term_id": [int(row["range"]) << 32 | place], "term": [row["term"]], "occurrences": [row["occurrences"]], "records": [row["records"]]})

    ranged = partial.withColumn("range", F.pmod(F.xxhash64("term"), F.lit(RANGES)).cast("int"))
    ordered = ranged.repartition("range").sortWithinPartitions(keys, "range", "term")
    return ordered.mapInPandas(add, f"{keys} string, term_id bigint, term string, occurrences bigint, records bigint")


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, term_id, term, occurrences, records, mark`` of both fields; ``mark`` is ``rare``, ``common`` or null.

    Null texts are no records, empty ones are records without terms; repeated and
    unusable rows count like all others.
    """
    texts = spark.read.parquet(f"{sf_dir}/rid_transcription.parquet").select("text")
    words = spark.read.parquet(f"{sf_dir}/word_result.parquet").select("sheet_id", "word")
    fields = {"rid_transcription.text": text_counts(texts, "text"), "word_result.word": value_counts(words, "word", "sheet_id")}
    totals = {"rid_transcription.text": texts.select(F.count("text").alias("total")), "word_result.word": words.where("word is not null").select(F.countDistinct("sheet_id").alias("total"))}
    label = lambda frames: [df.withColumn("field", F.lit(name)) for name, df in frames.items()]
    partial = label(fields)
    total = label(totals)
    summed = sum_by_range(partial[0].unionByName(partial[1]), "field")
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > F.col("total") * COMMON_OVER, "common")
    return summed.join(F.broadcast(total[0].unionByName(total[1])), "field").select("field", "term_id", "term", "occurrences", "records", mark.alias("mark"))


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_table(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_table(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}
