import pytest
from pyspark.sql import DataFrame


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators like to use."""

    def made(rows, source="a") -> DataFrame:
        full = [(i, t, None, source, None if t is None else len(t), "x", 7, 8.0) for i, t in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(full, f"{kinds}, size string, _digest int, component_id double")

    return made
