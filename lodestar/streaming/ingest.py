"""Streaming ingest of operations into a collection, micro-batch by micro-batch.

An extension: the batch engine has no streams. Each micro-batch is one committed bulk write
of puts and deletes; within a batch the last operation of an id wins. A batch that was
committed before a failure is replayed without effect, since the last operation of an id
decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..database import Database
from ..operators.replay import last_of_each


def ingest(ops: DataFrame, db: Database, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """ops: a streaming DataFrame (ordinal, op, id, vector, metadata)."""

    def write(batch: DataFrame, _: int) -> None:
        last = last_of_each(batch.select("ordinal", "id", "op", "vector", "metadata"))
        db.write_ops(name, last.select("id", "op", "vector", "metadata"))

    out = ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def watch(spark, path: str, schema) -> DataFrame:
    """Operations from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path).withColumn("id", F.col("id").cast("long"))
