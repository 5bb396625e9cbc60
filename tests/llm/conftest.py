import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from texts, or from (doc_id, text) or (doc_id, text, source) tuples."""

    def make(rows, extra=()):
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else tuple(r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, DOC)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make
