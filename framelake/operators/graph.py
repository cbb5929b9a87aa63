"""Connected components of links, a shuffle a step; no step holds a node's neighbours in one place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet in spark.checkpoint.dir, which the driver and all executors share, and reads them again. Only in
    local mode is a folder made if it is unset. Unlike a checkpoint, which hands on the size that was estimated for it, the files
    have the size they have: joins multiply estimates, so in a loop their digits grow by a power until they fill the driver."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="framelake-")
        sc.setCheckpointDir(path)
    path = f"{path.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``checkpointed`` has written."""
    jvm = df.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def smallest_reachable(nodes: DataFrame, links: DataFrame, key: str, node: str = "node") -> DataFrame:
    """(key, node, least) of nodes (key, node) and links (key, u, v), both ways: the smallest node reachable. Each step a node
    takes the least label of its neighbours, hands it to the node it is named after, and then takes the label of that which it is
    named after now. So names of whole groups meet, and chains halve."""
    at = checkpointed(nodes.select(key, node, F.col(node).alias("old"), F.col(node).alias("least")))
    while True:
        named = at.select(key, F.col(node).alias("v"), F.col("least").alias("of_v"))
        around = links.join(named, [key, "v"]).groupBy(key, F.col("u").alias(node)).agg(F.min("of_v").alias("near"))
        near = checkpointed(at.join(around, [key, node], "left").select(key, node, F.col("least").alias("old"), F.least("least", "near").alias("near")))
        handed = near.groupBy(key, F.col("old").alias(node)).agg(F.min("near").alias("handed"))
        new = near.join(handed, [key, node], "left").select(key, node, "old", F.least("near", "handed").alias("first"))
        up = new.select(key, F.col(node).alias("first"), F.col("first").alias("then"))
        new = checkpointed(new.join(up, [key, "first"]).select(key, node, "old", F.least("first", "then").alias("least")))
        _dropped(at)
        _dropped(near)
        at = new
        if at.where("old <> least").isEmpty():
            return at.drop("old")
