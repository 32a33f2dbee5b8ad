import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text[, lang, source]) rows."""

    def make(*rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s1")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing(docs):
    """Documents with columns named like those that operators use inside."""

    def make(*rows):
        from pyspark.sql import functions as F

        d = docs(*rows)
        for c in ("score", "measures", "kept", "copies", "n", "size", "rate", "target", "bands", "toxicity", "secrets", "language", "seed"):
            d = d.withColumn(c, F.lit("mine"))
        return d

    return make
