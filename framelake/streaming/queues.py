"""Job messages: idempotent intake, routing with retries and dead letters, and the latest state of every job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.jobs import latest, route

MESSAGE = "seq long, queue string, message_id string, body string, attempts int, job_failed boolean, ts timestamp"


def once(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Redelivered messages are passed on once within the watermark."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["queue", "message_id"])


def write_routed(messages: DataFrame, folder: str, checkpoint: str, max_attempts: int = 4):
    """Starts a query that appends every micro-batch to one Parquet table, partitioned by route. A batch that is run again
    replaces its own files, which are named by its number."""

    def write(batch: DataFrame, number: int) -> None:
        routed = route(batch, max_attempts).withColumn("batch", F.lit(number))
        routed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "route").parquet(folder)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def write_latest(events: DataFrame, folder: str, checkpoint: str, key: str = "job_id", order: tuple[str, ...] = ("ts", "seq")):
    """Starts a query that keeps the latest event of each key: batch n reads the snapshot of batch n - 1 and writes its own,
    so that a batch that is run again starts from the same one. The one before that goes."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _snapshot(spark, folder, number - 1, batch)
        both = batch if old is None else old.unionByName(batch)
        latest(both, key, *order).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number - 2}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _snapshot(spark: SparkSession, folder: str, number: int, like: DataFrame) -> DataFrame | None:
    if number < 0:
        return None
    return spark.read.schema(like.schema).parquet(f"{folder}/batch={number}")


def run_available(writer, then: Callable | None = None) -> None:
    """Runs a query over what there is, to its end."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if then:
        then(q)
