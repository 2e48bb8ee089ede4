import pytest

#: Edge rows shared by the tests: null, empty and very long texts, ties, repeated rows, clashing extra columns.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, row string, size string, label double"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([tuple(r) + (None,) * (9 - len(r)) for r in rows] if schema == SCHEMA else rows, schema)


@pytest.fixture
def docs(spark):
    return lambda rows: make(spark, rows)
