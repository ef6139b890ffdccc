import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vanikosh.session import local_session, ship_package  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Values of a column expression over the given strings."""

    def run(values, expression):
        from pyspark.sql import functions as F

        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, "i int, a string").repartition(2)
        return [r.x for r in df.select("i", expression(F.col("a")).alias("x")).orderBy("i").collect()]

    return run
