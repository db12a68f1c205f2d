import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        if extra:  # columns whose names the operators use inside
            df = df.selectExpr("*", "'x' as lang", "1 as key", "2 as block", "cast(null as string) as sha", "'y' as line", "3 as score", "'z' as _text")
        return df

    return make
