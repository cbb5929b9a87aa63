"""JSON-lines ledgers, metrics files and service logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the fields of ledger lines and metrics documents, and the levels of a log
LEDGER = "input string, output string, processed_images long, error_count long, output_size long, started_at timestamp, finished_at timestamp, duration_ms long, errors array<struct<entry:string,error:string>>"
METRICS = "val_accuracy double, val_samples long, exported_at timestamp, real_samples_used long, fp_samples_used long"
LEVELS = ("INFO", "WARN", "ERROR")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Blank and torn lines are passed over."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where("input IS NOT NULL")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metrics documents of a path; those that can't be read give no row."""
    return spark.read.schema(METRICS).option("multiLine", "true").option("pathGlobFilter", "metrics_*.json").json(path).where("val_accuracy IS NOT NULL AND exported_at IS NOT NULL")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, level, module, message) of lines that have these; terminal colours go first. The first two words are the stamp, in
    UTC, and the level; the third ends in the colon before the message."""
    line = F.regexp_replace("value", "\x1b\\[[0-9;]*m", "")
    words = spark.read.text(path).select(F.split(line, r"\s+", 4).alias("w")).where("size(w) = 4 AND endswith(w[0], 'Z') AND endswith(w[2], ':')")
    rows = words.select(F.try_to_timestamp(F.col("w")[0]).alias("ts"), F.col("w")[1].alias("level"), F.rtrim(F.col("w")[2], F.lit(":")).alias("module"), F.col("w")[3].alias("message"))
    return rows.where(F.col("ts").isNotNull() & F.col("level").isin(*LEVELS) & (F.col("module") != ""))
