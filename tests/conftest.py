import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from groundwell import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one text."""
    from pyspark.sql import functions as F

    def run(expression, value="", **more):
        names = ["x", *more]
        row = spark.createDataFrame([(value, *more.values())], ", ".join(f"{n} string" for n in names))
        return row.select(expression(*[F.col(n) for n in names]).alias("out")).first()["out"]

    return run
