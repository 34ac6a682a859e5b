"""Incremental forms of the merge and of counts over late events.

An extension: batches of collected documents merge into the table on arrival,
and events are counted per window under a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessitura.functions.times import instant_micros
from tessitura.operators.ingest import latest_per_key
from tessitura.schemas import DOCUMENT_KEY


def merge_stream(spark: SparkSession, incoming: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into versions of the table below ``target``.

    Every batch writes ``version=<batch>``, so a batch that is repeated after a
    failure writes the same folder again; readers take the largest version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        path = f"{target}/version={number:08d}"
        rows = batch.select(*incoming.columns)
        if number:
            rows = spark.read.schema(incoming.schema).parquet(f"{target}/version={number - 1:08d}").unionByName(rows)
        order = [instant_micros(F.col("scraped_at")).desc(), F.desc("registro")]
        latest_per_key(rows, DOCUMENT_KEY, *order).write.mode("overwrite").parquet(path)

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events, users and values per window and type; later ones than ``late`` are dropped."""
    stamped = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def without_repeats(docs: DataFrame, time: str, keys: tuple[str, ...] = DOCUMENT_KEY, within: str = "7 days") -> DataFrame:
    """Documents without those collected again within a time."""
    return docs.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", within).dropDuplicatesWithinWatermark(list(keys))
