import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents as a table with further columns whose names clash with inner ones."""

    def make(rows, schema=DOCUMENT):
        df = spark.createDataFrame(rows, schema).repartition(3)
        for name in ("id", "k", "d", "g", "v", "b", "fp", "_raw", "_k", "component", "text_", "value", "size", "cell", "label_"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make

