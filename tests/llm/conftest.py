import pytest


@pytest.fixture
def docs_of(spark):
    """Documents (doc_id, text) with further columns whose names the operators use themselves."""
    clashes = ("key", "digest", "uid", "keep", "spans", "kept", "slot", "shard", "score", "wanted", "n_docs", "term", "pos", "host", "rate", "copies")

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        for name in clashes:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(name))
        return df

    return make
