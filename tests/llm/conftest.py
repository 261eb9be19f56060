import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = "alpha beta gamma delta epsilon " * 8000
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", "   \t\n", "one", "two words", BASE, BASE, BASE + " tail", "x " + BASE, LONG, LONG,
    "line a\nline b\nline a\n\n", "Ünïcödé ▁ mark\x00 　 wide \U0001f642 \r\n end", "a" * 5000,
    "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "# * $ % & | < >", "...\n...\n...",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, BASE, None, None, None), (None, None, None, None, None), (100, BASE, "de", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_words", "kept", "id", "key", "row", "host", "n", "rank", "page", "copy", "k1", "_n", "of", "u", "b", "shard", "words", "tag", "_m", "_row"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
