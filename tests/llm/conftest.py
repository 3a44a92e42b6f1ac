import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Names that operators use inside.
CLASHES = "id a b bucket component size row removed rate seed copy n kept host line first text_key source_key times anchor block value".split()


def edge_rows(long_text):
    words = " ".join(f"w{i}" for i in range(80))
    return [
        (1, words), (2, words), (2, words), (3, None), (None, words), (None, None), (4, ""), (5, " \n\t "), (6, "one"), (7, words + " tail"),
        (8, long_text), (9, "é😀 ü\nsecond line of some length here\n\nsecond line of some length here"), (10, words, None), (11, "a b c d e"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    long_text = " ".join(f"word{i % 5000}" for i in range(400_000)) + " " + "x" * 1_000_000
    df = frame(spark, edge_rows(long_text))
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [(1, "x")]).where("doc_id > 1")
