import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

#: Sizes and cases that every operator has to take.
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ODD = [
    None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "the same text", "the same text", "the  same\ntext", "THE same text", LINE, LINE, f"x {LINE} y", f"{LINE} {LINE}",
    f"unlike {LINE[4:]} and on", "word " * 4000, "wörd späce İstanbul \U0001f600 $$$ ### \x00 \x1c", "<|endoftext|> <s> ▁ x", "x" * 30000, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    rows = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(ODD)]
    rows += [rows[10], (None, LINE, "en", None, 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("block_id", "data", "kept", "bucket", "digest", "score", "keep_id", "n_words", "replies")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def same_ids(spark):
    """Null and repeated ids, with equal, near and different texts, and texts that share passages."""
    base = " ".join(f"word{k}" for k in range(60))
    texts = [
        (1, base), (1, base), (1, base.replace(" ", "  ")), (2, base.replace("word7 ", "other ")), (2, f"clean text of two {LINE}"), (3, "a b c"), (3, "a   b   c"), (3, LINE), (5, "alone"), (5, "alone"),
        (None, base), (None, None), (None, ""), (None, f"tail {LINE} of nothing"), (None, "  "), (None, "alone"), (7, f"{LINE} tail seven"), (7, f"{base} second row of seven"), (7, None), (None, "only here  it is"),
    ]
    return spark.createDataFrame([(i, t, "en", f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)], DOCS).repartition(4)
