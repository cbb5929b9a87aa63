"""Writers: detections, ledgers, states and reports as files that are whole or not there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder to a name that is free."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def _replace(df: DataFrame, folder: str, write) -> None:
    """Writes beside the folder, then puts the new one in its place; the old one goes last."""
    spark, turn = df.sparkSession, uuid.uuid4().hex
    write(df, f"{folder}.{turn}.new")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(path(folder))
    if there:
        _move(spark, folder, f"{folder}.{turn}.old")
    _move(spark, f"{folder}.{turn}.new", folder)
    if there:
        fs.delete(path(f"{folder}.{turn}.old"), True)


def append_detections(detections: DataFrame, folder: str) -> None:
    """Appends Parquet files by the day of ``captured_at``, which is what reads and retention are by."""
    detections.withColumn("day", F.to_date("captured_at")).write.mode("append").partitionBy("day").parquet(folder)


def prune_detections(spark: SparkSession, folder: str, before: Column) -> tuple[int, int]:
    """Rewrites the table without detections from before a time; (deleted, left)."""
    at = spark.read.parquet(folder)
    gone = F.col("captured_at") < before
    deleted, left = at.agg(F.count_if(gone), F.count_if(~F.coalesce(gone, F.lit(False)))).first()
    if deleted:
        _replace(at.where(~F.coalesce(gone, F.lit(False))), folder, lambda df, to: df.write.partitionBy("day").parquet(to))
    return deleted, left


def append_ledger(rows: DataFrame, folder: str, newest: str = "finished_at", keep: int = 500, max_bytes: int = 200_000) -> bool:
    """Appends JSON lines; if the folder then has more than max_bytes, only the newest ``keep`` rows stay. Whether it was cut."""
    spark = rows.sparkSession
    rows.write.mode("append").json(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    size = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path(folder)).getLength()
    if size <= max_bytes:
        return False
    last = spark.read.schema(rows.schema).json(folder).orderBy(F.desc(newest)).limit(keep)
    _replace(last, folder, lambda df, to: df.coalesce(1).write.json(to))
    return True


def write_state(state: DataFrame, folder: str) -> None:
    """One JSON document in place of the last: a classifier's state or a run's audit, a row or a few."""
    _replace(state, folder, lambda df, to: df.coalesce(1).write.json(to))


def write_report(lines: DataFrame, folder: str, order: str = "line_no", text: str = "line") -> None:
    """A text report in place of the last: short by nature, so one file."""
    _replace(lines, folder, lambda df, to: df.orderBy(order).select(text).coalesce(1).write.text(to))
