import pytest
from corpus_rows import EXTRA, SCHEMA, messy_rows
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).withColumns({k: F.lit(v) for k, v in EXTRA.items()}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(100 + i, 1, int(i % 4 == 0)) for i in range(40)] + [(3, 1, None), (None, 1, 1), (100, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
