import public_tokenizers
import pytest

#: Rows that every operator on texts must take: nulls, empty and long texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six seven."), (4, "One two three four five six seven."), (5, "One two three four five six seven."),
       (None, "no id here at all"), (6, "lang" * 3000 + " " + "é1 " * 4000), (7, "▁ a  b\n\nc <|endoftext|> </s> 日本語 'll don't \x1c\x85"), (8, "word")]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = ("row", "word", "n", "fp", "score", "mark", "place", "block", "ids", "items", "spans", "host", "n_words", "n_removed", "_cut", "source")
    return df.withColumns({c: F.lit("x") for c in clash}).withColumn("source", F.concat(F.lit("s"), F.coalesce("doc_id", F.lit(0)))).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path


def pytest_configure(config):
    config.addinivalue_line("markers", "llm: operators for training data")
