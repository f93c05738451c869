import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/tessela-warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make
