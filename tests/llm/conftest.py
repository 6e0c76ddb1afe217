import pytest

LONG = "lorem ipsum dolor sit amet " * 20000
#: Nulls, empty and very long texts, ties, repeated rows; further columns with names that operators use inside.
ROWS = [
    (0, "The cat sat on the mat. The dog sat on the log and barked.\nA line of its own that is long enough.", "en", "src0"),
    (1, "the CAT sat on the mat. The dog sat on the log and barked!\nA line of its own that is long enough.", "en", "src1"),
    (2, None, "en", "src0"),
    (3, "", None, None),
    (4, " \t\n ", "de", "src2"),
    (5, "123 456 !!!", "de", "src2"),
    (6, "one", "fr", "src3"),
    (7, "one", "fr", "src3"),
    (7, "one", "fr", "src3"),
    (None, "a row without an id but with some words in it", "en", "src4"),
    (8, LONG, "es", "src0"),
    (9, LONG + "end", "es", "src0"),
    (10, "Über die Straße größer ñandú ça été 日本語 \U0001f600 text", None, "src5"),
]


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clash = {"id": 1, "n": 2, "shard": 3, "slot": 4, "digest": "x", "a": 5, "h": 6, "bucket": 7, "size": 8, "component_id": 9, "kept": False, "epoch": 1, "hits": "y", "language": "z", "tokens": 3, "placed": 1, "mixed": 1}
    from pyspark.sql import functions as F

    return docs.withColumns({k: F.lit(v) for k, v in clash.items()})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
