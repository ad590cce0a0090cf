import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(f"{DATA}/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Runs a query on the smallest tables by Spark and its SQL by DuckDB, and compares all rows."""

    def run(query, sql):
        got, want = query(spark, f"{DATA}/sf0.001").toArrow(), duck.sql(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        names = sorted(got.column_names)
        rows = [sorted(map(repr, zip(*(t[c].to_pylist() for c in names), strict=True))) for t in (got, want)]
        assert rows[0] == rows[1]

    return run
