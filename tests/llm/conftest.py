import pyarrow.parquet as pq
import pytest

# Clashing names, nulls, empty and long texts, repeated rows.
SCHEMA = "doc_id long, text string, id string, start int, n_tokens int, value int, label string, kept string, size int"


@pytest.fixture(scope="session")
def documents(data):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}


@pytest.fixture(scope="session")
def odd_texts():
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    same = "The same words\tagain and again.\nThe same words again."
    return [(1, None), (2, ""), (3, " \n\t "), (4, same), (5, same.replace("\n", "  ")), (5, same.replace("\n", "  ")), (6, long), (7, long + " end"), (8, "x" * 100_000), (None, same), (None, None), (9, "été 'tis <|endoftext|> ▁ naïve 😀 1.2.3.4 a@b.cd token = \"0123456789abcdef0123456789abcdef\"")]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame([(k, t, "i", None, 1, None, "l", None, 2) for k, t in odd_texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
