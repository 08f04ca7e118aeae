import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mailloom import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "mailloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a Column built by ``fn`` on each of the given texts."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]

    return run
