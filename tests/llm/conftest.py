import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of (id, text) rows, with extra columns of clashing names."""

    def build(rows, extra=True):
        full = [(i, t, None, "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(3)
        clashing = ("row", "name", "n", "k1", "label", "score", "bin", "used", "kept", "rep", "length", "offset", "cluster")
        for c in clashing if extra else ():
            df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return build
