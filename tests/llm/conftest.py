import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def docs(spark):
    """Builds a table of documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with results."""
    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for c in ("shard", "size", "score", "target", "copies", "node", "owner", "row", "salt", "key", "n", "group", "range", "block"):
            df = df.selectExpr("*", f"'x' AS {c}")
        return df
    return make


#: Nulls, empty and odd texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (5, "the same text of a few words here"), (6, "the same text of a few words here"), (None, "no id at all here, none"), (None, None),
       (7, "x" * 70_000), (8, "word " * 30_000), (9, "é漢字 ñ 😀 'll 12"), (10, "\x1c\x85  ")]


@pytest.fixture
def odd(docs):
    return docs(*ODD)
