import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts, with a column whose name clashes with inner ones."""

    def make(texts, langs=None, extra=False):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "place", "signals", "kept", "contamination", "score", "n_words", "cutoff", "text_crc32", "part"):
                df = df.withColumn(name, F.lit(name))
        return df

    return make
