import pytest
from pyspark.sql import Row, types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for themselves
    T.StructField("score", T.DoubleType()), T.StructField("k", T.LongType()), T.StructField("doc", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("h", T.LongType()), T.StructField("c", T.StringType()),
])

LONG = " ".join(f"word{i % 977} and{i % 13} it{i % 7}." for i in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank today"


@pytest.fixture(scope="session")
def messy(spark):
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one"), (None, "x y"), (None, None),
             (8, LONG), (9, "a" * 500), (10, "ÄÖÜ ß — 東京 \u0000 !"), (11, PROSE + " once more")]
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 3 else f"s{(i or 0) % 3}", len(t or ""), 0.5, 7, "doc", "t", 9, "c") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([Row(doc_id=i, quality=q, toxic=t, text="clash", score=1.0) for i, q, t in
                                  [(1, 1, 0), (2, 1, 0), (8, 0, 1), (9, 0, 1), (None, 1, 1), (5, None, None), (77, 1, 0)]],
                                 "doc_id long, quality int, toxic int, text string, score double")
