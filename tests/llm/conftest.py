import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text) rows, with further columns whose names operators use inside."""

    def make(rows, **extra):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name, value in extra.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make
