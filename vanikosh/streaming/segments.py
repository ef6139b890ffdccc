"""Segments as a stream: stateless cleanup, and counts in windows of the time of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.functions.codeswitch import cleanup
from vanikosh.operators.stage import scratch, spread
from vanikosh.plans.cleanup import SQL as cleanup_sql

#: How late a segment may come and still be counted in its window.
LATENESS = "2 days"


def segment_stream(spark: SparkSession, sf_dir: str, table: str = "rid_transcription") -> DataFrame:
    """A stream of the Parquet files of a table, be it one file or a folder of files."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream to the end of what is there, into Parquet files that are read back."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleanup of every segment, as it would come out of an endless stream."""
    rows = spread(segment_stream(spark, sf_dir).where("text is not null").select("seg_id", "text")).select("seg_id", cleanup(F.col("text")).alias("c"))
    return _drain(rows.select("seg_id", F.col("c.tagged").alias("tagged"), F.size("c.en_tags").alias("tags")), "stream-cleanup")


def arrivals(segments: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``day, segments, texts`` of a stream with ``received_at`` and ``text``: a day comes out once, when the watermark has passed its
    end. The state is one row per open day; a segment of a day that has come out is not counted."""
    timed = segments.where("received_at is not null").withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", lateness)
    counted = timed.groupBy(F.window("received_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("segments"), F.count("text").alias("texts"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "segments", "texts")


def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments per day of arrival, of the days that are over: those that end by ``LATENESS`` before the newest segment."""
    return _drain(arrivals(segment_stream(spark, sf_dir).select("received_at", "text")), "stream-arrivals")


QUERIES = {"stream_cleanup": stream_cleanup, "stream_arrivals": stream_arrivals}

SQL = {
    "stream_cleanup": f"SELECT seg_id, tagged, tags FROM ({cleanup_sql['cleanup_pipeline']})",
    "stream_arrivals": """
SELECT strftime(received_at, '%Y-%m-%d') AS day, count(*) AS segments, count(text) AS texts FROM rid_transcription WHERE received_at IS NOT NULL
GROUP BY date_trunc('day', received_at), day HAVING date_trunc('day', received_at) + INTERVAL 1 DAY <= (SELECT max(received_at) FROM rid_transcription) - INTERVAL 2 DAY"""
}
