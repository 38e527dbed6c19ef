import duckdb
import pytest

LONG = " ".join(f"w{i % 97}" for i in range(30_000))
ODD_TEXTS = [
    None, "", " \n\t ", "***", "!!!", "one", "one two three", "ONE two\nthree", LONG, LONG, "é ß ſ 中文 🙂 <|endoftext|> \x00", "a" * 5000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], rows[6], (None, "a null id", None, None, None), (None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, kinds)
    extra = "n_words shard position curve key class_id id bucket votes hits contamination judgement start length offset host g_host".split()
    return frame.selectExpr("*", *[f"'x' as `{c}`" for c in extra], "'y' as __key", "'z' as __bucket")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(sf):
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())
