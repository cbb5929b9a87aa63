"""Frames as a stream: each micro-batch is a job that sees the cameras as they were when it began."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.detect import frame_results

_BOX = "det_idx int, x1 double, y1 double, x2 double, y2 double, score double"
FRAME = f"image_id long, camera_id string, width int, height int, faces array<struct<{', '.join(f.replace(' ', ':') for f in _BOX.split(', '))}>>, persons array<struct<{', '.join(f.replace(' ', ':') for f in _BOX.split(', '))}>>"


def write_results(frames: DataFrame, cameras: Callable[[], DataFrame], folder: str, checkpoint: str, **limits):
    """Starts a query over frames (see FRAME) that appends a row per frame, as ``frame_results`` gives it, to a Parquet table
    partitioned by batch. ``cameras`` reads the state table; it is read once a batch and written down beside the results,
    so that a batch that is run again, and every frame of it, sees the same states whatever happens to the cameras meanwhile."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = f"{folder}-states/batch={number}"
        path = spark._jvm.org.apache.hadoop.fs.Path
        if not path(seen).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{seen}/_SUCCESS")):
            cameras().write.mode("overwrite").parquet(seen)
        states = spark.read.parquet(seen)
        boxes = lambda c: batch.select("image_id", F.explode(c).alias("b")).select("image_id", "b.*")
        out = frame_results(batch.select("image_id", "camera_id", "width", "height"), boxes("faces"), boxes("persons"), states, **limits)
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
