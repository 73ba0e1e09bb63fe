"""A stream that is decoded and written in two parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.quarantine import split


def quarantine_stream(stream: DataFrame, engine: Engine, cls: type, good: str, bad: str, checkpoint: str, document: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that appends valid records to ``good`` and invalid rows to ``bad`` (Parquet folders).

    Every batch is decoded once and kept while both parts are written.
    """
    decoded = engine.decode(stream, cls, document=document)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            valid, invalid = split(batch)
            # a folder of its own for each batch: a batch that is run again replaces what it wrote
            valid.write.mode("overwrite").parquet(f"{good}/batch={number}")
            invalid.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            batch.unpersist()

    writer = decoded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
