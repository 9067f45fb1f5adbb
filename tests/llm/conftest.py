import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def documents(spark):
    """docs(texts) -> DataFrame with ids from 0, and a clashing extra column."""

    def make(texts, ids=None, extra="fp"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra} string")

    return make
