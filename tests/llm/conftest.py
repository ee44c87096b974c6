import pytest
from pyspark.sql import functions as F

#: Columns that no operator may stumble over.
CLASHES = ["id", "run", "place", "n", "best", "node", "comp", "key", "size", "target", "score", "label", "copies", "host", "path", "kind"]


@pytest.fixture(scope="session")
def documents(spark):
    """rows of (doc_id, text, lang, source) as a table with clashing extra columns."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string"):
        df = spark.createDataFrame([tuple(r) + (None,) * (len(schema.split(", ")) - len(r)) for r in rows], schema)
        have = set(df.columns)
        return df.withColumns({c: F.lit("x") for c in CLASHES if c not in have})

    return make


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
