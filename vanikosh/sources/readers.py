"""Reading recordings' segments, manifests, word lists and audio files."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanikosh.functions.text import WHITE
from vanikosh.session import ship_package

SEGMENT_ARRAY = "array<struct<start:double,end:double,speaker_id:bigint,text:string>>"
#: Names of a first row that is a header and not a word.
WORD_HEADERS = ("word", "words", "unique words", "unique_words")


def segment_files(spark: SparkSession, path: str) -> DataFrame:
    """``rid, seg_no, start, end, speaker_id, text`` of files that hold a JSON list of segments each; ``rid`` is the file's name up to its first ``_`` or ``.``."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_[^/]*)?\.[^/.]+$", 1).alias("rid"), F.from_json("value", SEGMENT_ARRAY).alias("segments"))
    return rows.select("rid", F.posexplode("segments").alias("seg_no", "s")).select("rid", "seg_no", "s.*")


def recording_texts(segments: DataFrame) -> DataFrame:
    """The text of each recording given as an array column ``segments``, in the array's order."""
    return segments.select("rid", F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("text"))


def manifest(spark: SparkSession, path: str, lang: str | None = "hi") -> DataFrame:
    """A table of recordings in CSV with a header, as strings; only those of ``lang`` if one is given."""
    df = spark.read.option("header", True).csv(path)
    return df.where(F.lower(F.trim("lang")) == lang) if lang else df


def word_list(words: DataFrame, order: str = "ord", column: str = "word", *lists: str) -> DataFrame:
    """``word, ord``: distinct words without white space at their ends, each with its first place; blank ones are left out, and a
    header if it is the first row that isn't blank (of each list, where columns name several)."""
    word = F.regexp_replace(column, rf"^[{WHITE}]+|[{WHITE}]+$", "")
    clean = words.select(word.alias("word"), F.col(order).alias("ord"), *lists).where("word <> ''")
    first = clean.groupBy(*lists).agg(F.min("ord").alias("ord"))  # one row per list
    header = first.join(clean.where(F.lower("word").isin(list(WORD_HEADERS))), ["ord", *lists], "left_semi")
    return clean.join(header, ["ord", *lists], "left_anti").groupBy("word").agg(F.min("ord").alias("ord"))


def word_file(spark: SparkSession, path: str) -> DataFrame:
    """The first column of CSV files as a word list; the place is that of the row in its file and partition."""
    rows = spark.read.csv(path).select(F.col("_c0").alias("word"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    return word_list(rows, "ord", "word", "file")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, rate, channels, seconds`` of WAV files, from their headers; the samples aren't decoded."""
    head = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.hex(F.substring("content", 1, 44)).alias("h"))
    little = lambda at, size: F.conv(F.concat(*[F.substring("h", 2 * (at + size - 1 - i) + 1, 2) for i in range(size)]), 16, 10).cast("bigint")
    wav = head.where(F.substring("h", 1, 8) == "52494646").withColumns({"rate": little(24, 4), "channels": little(22, 2), "per_second": little(28, 4), "data": little(40, 4)})
    return wav.select("path", "bytes", "rate", "channels", F.when(F.col("per_second") > 0, F.col("data") / F.col("per_second")).alias("seconds"))


def audio_samples(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """``path, rate, seconds, samples`` of 16-bit WAV files: channels averaged to one, values from -1 to 1, resampled to ``rate`` by
    linear interpolation. A file that is no such WAV has null samples. A recording is decoded in one piece, below 2 GB."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("path", F.lit(rate).alias("rate"), _samples(F.col("content"), F.lit(rate)).alias("samples")).select("path", "rate", (F.size("samples") / F.col("rate")).alias("seconds"), "samples")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _samples(contents: pd.Series, rates: pd.Series) -> pd.Series:
    return pd.Series([_decoded(c, int(r)) for c, r in zip(contents, rates)], dtype=object)


def _decoded(content: bytes, rate: int) -> np.ndarray | None:
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2:
                return None
            own, channels = w.getframerate(), w.getnchannels()
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2")
    except (wave.Error, EOFError):
        return None
    mono = raw[: len(raw) // channels * channels].reshape(-1, channels).mean(axis=1) / 32768
    if own != rate and len(mono):
        mono = np.interp(np.arange(round(len(mono) * rate / own)) * own / rate, np.arange(len(mono)), mono)
    return mono.astype(np.float32)
