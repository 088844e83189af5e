import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from texts, or from (doc_id, text) pairs."""

    def make(*texts, schema=DOCS):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def real(spark):
    """The documents of the smallest test folder, and odd ones: (DataFrame, rows as a list)."""
    import os

    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [
        (10_001, None), (10_002, ""), (10_003, " \t\n "), (10_004, "one"), (10_005, "one two"),
        (10_006, "ÀÉ 漢字 😀 naïve İstanbul ΑΣ"), (10_007, "x" * 5000), (10_008, "a b c d " * 3000),
        (10_008, "a b c d " * 3000), (None, "a row without an id, once more and again"),
        (10_010, "<|endoftext|> between <|startoftext|>words<|endoftext|>"), (10_011, "a  b \n\n c\t d "),
    ]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    both = docs.unionByName(more)
    return both, [(r["doc_id"], r["text"]) for r in both.select("doc_id", "text").collect()]


SF_DIR = "/root/testdata/sf0.001"
