"""Where intermediate tables go, rows dealt out on request only, and streams that forget late rows."""

import datetime
import os
from types import SimpleNamespace

import pytest

from vanikosh.operators import stage
from vanikosh.streaming.segments import arrivals


def _session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        stage.shared_dir(_session(**{"spark.master": master}))
    assert stage.shared_dir(_session(**{"spark.master": master, stage.CHECKPOINT_DIR: "/shared/x/"})) == "/shared/x"


def test_a_local_session_needs_none():
    session = _session(**{"spark.master": "local[4]"})
    assert stage.shared_dir(session).startswith("file:///") and stage.shared_dir(session) == stage.shared_dir(session)


def test_rows_are_dealt_on_request_only(spark):
    df = spark.range(10).coalesce(1)
    held = spark.conf.get(stage.DEAL)
    try:
        spark.conf.unset(stage.DEAL)
        assert stage.spread(df) is df
        spark.conf.set(stage.DEAL, "3")
        assert stage.spread(df).rdd.getNumPartitions() == 3
    finally:
        spark.conf.set(stage.DEAL, held)


def test_a_late_row_is_not_counted(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n, 12)
    for i, rows in enumerate([[(day(10), "a"), (day(10), None)], [(day(9), "in time"), (day(20), "b"), (None, "c")], [(day(2), "late"), (day(30), "d")]]):
        spark.createDataFrame(rows, "received_at timestamp, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in os.listdir(f"{tmp_path}/in"):
            if f.endswith(".parquet") and not f.startswith("done"):
                os.rename(f"{tmp_path}/in/{f}", f"{tmp_path}/in/done{i}.parquet")
                os.utime(f"{tmp_path}/in/done{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema("received_at timestamp, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = arrivals(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.day: (r.segments, r.texts) for r in spark.table("late").collect()}
    assert got == {"2024-01-09": (1, 1), "2024-01-10": (2, 1), "2024-01-20": (1, 1)}
