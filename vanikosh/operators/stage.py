"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Session setting: the number of partitions over which the rows of small inputs are dealt before work per row. Unset,
#: rows stay where they lie. It is for tables of one file on a machine of many cores; ``local_session`` sets it.
DEAL = "spark.vanikosh.deal"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets a temporary one; on a cluster, whose
    machines don't share such a folder, that is an error."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or getattr(spark, "_vanikosh_dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vanikosh-")
        spark._vanikosh_dir = path
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the setting ``DEAL`` says, if it is set."""
    parts = df.sparkSession.conf.get(DEAL, None)
    return df.repartition(int(parts)) if parts else df


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: what follows neither repeats its work nor
    depends on the executors that did it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
