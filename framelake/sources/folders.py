"""Folders of extracted entries and of images as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str, max_bytes: int = 256 << 20) -> DataFrame:
    """(name, declared_size, data, error) of all files under a folder of extracted entries, names from the folder on. A file
    over max_bytes is an error row, and is not read. Other files are split over tasks by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.regexp_replace(F.lit(path.rstrip("/")), r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    name = F.when(F.startswith(plain, root), F.ltrim(F.substring(plain, F.length(root) + 1, F.length(plain)), F.lit("/"))).otherwise(plain)
    small = files.where(F.col("length") <= max_bytes).select(name.alias("name"), F.col("length").alias("declared_size"), F.col("content").alias("data"), F.lit(None).cast("string").alias("error"))
    large = files.where(F.col("length") > max_bytes).select(name.alias("name"), F.col("length").alias("declared_size"), F.lit(None).cast("binary").alias("data"), F.lit("limit: file too large").alias("error"))
    return small.unionByName(large)


def read_images(spark: SparkSession, path: str, max_side: int = 10_000, max_bytes: int = 512 << 20) -> DataFrame:
    """(name, width, height, channels, pixels, error) of the images under a folder, decoded by Spark's own reader. What cannot
    be decoded, is wider or higher than max_side, or takes more than max_bytes of pixels is a row with an error and no
    pixels."""
    i = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    size = F.col("width").cast("long") * F.col("height") * F.col("nChannels")
    error = F.when((F.col("height") <= 0) | (F.col("width") <= 0), "undecodable").when((F.col("width") > max_side) | (F.col("height") > max_side), "limit: side").when(size > max_bytes, "limit: bytes")
    return i.select(F.col("origin").alias("name"), "width", "height", F.col("nChannels").alias("channels"), F.when(error.isNull(), F.col("data")).alias("pixels"), error.alias("error"))
