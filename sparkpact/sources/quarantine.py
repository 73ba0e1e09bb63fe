"""Reading documents, and parting valid records from invalid ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, column: str = "document") -> DataFrame:
    """A JSON-lines file or folder, one document a row, unparsed: missing keys, nulls and types stay apart."""
    return spark.read.text(path).select(F.col("value").alias(column))


def split(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records as columns, invalid rows with their issues) of an engine's ``decode``.

    Both are lazy; persist the decoded frame if both are written.
    """
    good = decoded.where(F.size("issues") == 0).select("value.*")
    return good, decoded.where(F.size("issues") > 0).drop("value")
