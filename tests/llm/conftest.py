import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text[, source]) rows."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)
    return make


#: Nulls, empty and very long texts, repeated rows, a null id.
ODD = [(1, "one two three four five"), (2, None), (3, ""), (4, "x" * 300_000), (5, "one two three four five"), (5, "one two three four five"),
       (None, "no id at all"), (7, " \n\t "), (8, "wörter und ▁mehr <|endoftext|> ende"), (9, "word " * 40_000)]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def odd_rows():
    return ODD


@pytest.fixture
def clashing():
    """Extra columns whose names clash with what the operators make."""
    from pyspark.sql import functions as F

    def add(df):
        for c in ("key", "fp", "fingerprint", "row", "rank", "hash", "bucket", "score", "host", "unit", "part", "label"):
            df = df.withColumn(c, F.lit("clash"))
        return df.withColumn("TEXT2", F.col("text")) if "text" in df.columns else df
    return add
