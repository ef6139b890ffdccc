"""Writing results. All replace what is at the path, and write from all tasks at once unless one file is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: How CSV tells a null from an empty text; for reading as well.
CSV = {"header": True, "nullValue": "\\N", "escape": "\"", "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header and the options ``CSV``. One file only for small reports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**CSV).csv(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """A text a line, as a language model's corpus wants it."""
    df.select(column).write.mode("overwrite").text(path)


def write_batches(df: DataFrame, path: str, rows: int = 5000) -> None:
    """Parquet files of at most ``rows`` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
