"""Extensions on Structured Streaming: a graph that follows a stream of facts, and windowed activity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..folders import join, read_text, replace_text, there
from ..operators.diff import patched


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and value by window and type; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("window.start", "event_type", "n", "value")


def follow(stream: DataFrame, folder: str, checkpoint: str, key: str = "id", apply: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Upserts each micro-batch into the table at `folder`; the batch number is the table's revision, so a batch that runs again changes nothing."""

    def upsert(batch: DataFrame, revision: int) -> None:
        spark, pointer = batch.sparkSession, join(folder, "CURRENT")
        last = int(read_text(spark, pointer)) if there(spark, pointer) else -1
        if revision <= last:
            return
        new = batch.dropDuplicates([key])
        if last >= 0:
            old = spark.read.parquet(join(folder, str(last)))
            new = patched(old, new, new.select(key).limit(0), key)
        new.write.mode("overwrite").parquet(join(folder, str(revision)))
        replace_text(spark, pointer, str(revision))
        if apply:
            apply(new, revision)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
