import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)
        return df.selectExpr("*", "'x' AS rank", "1 AS bucket", "2 AS node", "'k' AS key", "0 AS size", "1 AS row", "2 AS words") if extra else df

    return make
