import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents, with columns whose names operators use themselves."""

    def build(rows, extra=True):
        full = [(i, t, *more, *([None] * (3 - len(more)))) for i, t, *more in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("score", "size", "start", "copies", "class", "name", "hash", "key", "h1", "shard", "quality", "links"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("clash"))
        return df

    return build


@pytest.fixture
def sf(spark, tmp_path):
    """A data directory with the given tables."""

    def build(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return build
