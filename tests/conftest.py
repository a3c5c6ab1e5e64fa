import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from fleetlens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests", "local[8]", spark_sql_shuffle_partitions="4", spark_driver_memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def no_broadcast(spark):
    """Joins without broadcasts of lookups."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def frame(spark):
    """Rows and a DDL schema to a DataFrame; texts are cast, so times can be written as text."""

    def make(schema, *rows):
        fields = [f.strip().split(" ", 1) for f in schema.split(",")]
        texts = [tuple(None if v is None else str(v) for v in r) for r in rows]
        df = spark.createDataFrame(texts, ", ".join(f"{n} string" for n, _ in fields))
        return df.selectExpr(*[f"cast({n} as {t}) as {n}" for n, t in fields])

    return make


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan AQE ended with."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
