import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("shared")
    options = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": str(place), "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=options).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Rows of a query and of its SQL over the same tables, columns by name."""
    import duckdb

    def run(spark, query, sql, sf_dir):
        con = duckdb.connect()
        con.sql("set timezone = 'UTC'")
        for name in sorted(p.stem for p in Path(sf_dir).glob("*.parquet")):
            con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
        got = query(spark, sf_dir)
        names = sorted(got.columns)
        want = con.sql(sql)
        assert names == sorted(want.columns)
        order = lambda rows: sorted(rows, key=repr)
        return order(tuple(r[n] for n in names) for r in got.collect()), order(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())

    return run
