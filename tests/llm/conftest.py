import pytest

SMALL = "/root/testdata/sf0.001"

#: Nulls, empty and very long texts, ties, repeated rows and foreign scripts.
HARD_TEXTS = [None, "", " ", "\n\t", "one", "One two three four five six", "One two three four five six", "naïve café Ünïcode ŒUVRE — “quoted” it's we're $5.00!!", "x" * 5000, "word " * 30000, "a\x1cb c d é \U0001f600", "<|endoftext|> ordinary", "İstanbul ǅ ΣΑΣ"]


@pytest.fixture(scope="session")
def hard_docs(spark):
    rows = [(i * 3, t, "en", f"src{i % 3}", len(t or ""), "extra", i) for i, t in enumerate(HARD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, start long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
