"""Progress events as a stream: running counters with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.restore import counters
from ..sources.storage import materialised, table


def running_counters(events: DataFrame) -> DataFrame:
    """Live counters (ok, skipped, failed, bytes_done) of a stream or table of (k, b)."""
    return counters(events)


def counters_from_stream(spark: SparkSession, folder: str, kind: Column) -> DataFrame:
    """The counters of the events table, read as a stream until all that is there now has been taken in.

    The sink keeps each batch's whole result (one row) in shared storage; the last one is returned.
    """
    schema = table(spark, folder, "events").schema
    # a file source streams folders; a table of one file is written to one of its own
    source = materialised(table(spark, folder, "events"), "events").inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    events = stream.select(kind.alias("k"), F.floor(F.col("value") * 1000).cast("long").alias("b"))
    at = f"{source}-stream-{uuid.uuid4().hex}"
    query = (
        running_counters(events).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/result"))
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{at}/result")
