"""Detector evaluation: threshold sweeps, average precision, recall at false positives per image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators.running import running_sums

STEPS = 1000


def thresholds(spark: SparkSession, steps: int = STEPS) -> DataFrame:
    """(k, thr): 1 - (k + 1) / steps."""
    return spark.range(steps).select(F.col("id").alias("k"), (1 - (F.col("id") + 1) / F.lit(float(steps))).alias("thr"))


def pr_sweep(labels: DataFrame, faces: DataFrame, steps: int = STEPS) -> DataFrame:
    """(k, thr, tp, proposals, precision, recall) at each threshold; EXCLUDED labels do not count.

    A score's first step is read off the table of thresholds by one binary step search per distinct score, then counts are
    cumulated over the steps: the window is over ``steps`` rows, whatever the number of detections."""
    spark = labels.sparkSession
    t = thresholds(spark, steps)
    per_score = labels.where("label <> 'EXCLUDED'").groupBy("score").agg(F.count_if(F.col("label") == "TP").alias("tp"), F.count(F.lit(1)).alias("n"))
    # the arithmetic guess may be off by one step in binary; the table decides
    guess = F.floor((1 - F.col("score")) * steps).cast("long") - 1
    near = per_score.select("score", "tp", "n", F.explode(F.sequence(guess - 1, guess + 2)).alias("k")).where((F.col("k") >= 0) & (F.col("k") < steps))
    near = near.withColumn("thr", 1 - (F.col("k") + 1) / F.lit(float(steps))).where("thr <= score")
    first = near.groupBy("score").agg(F.min("k").alias("k"), F.first("tp").alias("tp"), F.first("n").alias("n"))
    per_k = first.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    at = t.join(per_k, "k", "left").select("k", "thr", F.sum(F.coalesce("tp", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("proposals"))
    total = faces.agg(F.count(F.lit(1)).alias("faces"))
    at = at.crossJoin(F.broadcast(total))
    return at.select("k", "thr", "tp", "proposals", F.when(F.col("proposals") > 0, F.col("tp") / F.col("proposals")).otherwise(0.0).alias("precision"), F.when(F.col("faces") > 0, F.col("tp") / F.col("faces")).otherwise(0.0).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Area under the precision envelope."""
    w = Window.orderBy("k")
    step = curve.select((F.col("recall") - F.lag("recall", 1, 0.0).over(w)).alias("dr"), F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("p"))
    return step.agg(F.sum(F.col("dr") * F.col("p")).alias("ap"))


def operating_points(curve: DataFrame, confidences: tuple[float, ...] = (0.5, 0.25, 0.1, 0.05, 0.02)) -> DataFrame:
    """Precision and recall at the lowest threshold not below each confidence, which is compared as a 32-bit number."""
    c = F.explode(F.array(*[F.lit(x) for x in confidences])).alias("conf")
    at = curve.select("*", c).where(F.col("thr") + 1e-9 >= F.col("conf").cast("float").cast("double"))
    return at.groupBy("conf").agg(F.max_by("k", "k").alias("k"), F.max_by("precision", "k").alias("precision"), F.max_by("recall", "k").alias("recall"))


def fppi_curve(labels: DataFrame, images: DataFrame, faces: DataFrame) -> DataFrame:
    """One point per distinct score, from the highest: (score, fppi, recall), over the numbers of rows of images and faces. Counts are summed by score, then run over
    thousandths of the score, so equal scores are one point and no task has them all."""
    per = labels.groupBy("score").agg(F.count_if(F.col("label") == "TP").alias("t"), F.count_if(F.col("label") == "FP").alias("f"))
    summed = running_sums(per, -F.floor(F.col("score") * 1000), (F.desc("score"),), fp=F.col("f"), tp=F.col("t"))
    sizes = images.agg(F.count(F.lit(1)).cast("double").alias("images")).crossJoin(faces.agg(F.count(F.lit(1)).cast("double").alias("faces")))
    at = summed.crossJoin(F.broadcast(sizes))
    return at.select("score", F.try_divide(F.col("fp"), F.col("images")).alias("fppi"), F.try_divide(F.col("tp"), F.col("faces")).alias("recall"))


def fppi_points(curve: DataFrame, targets: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """Recall at the last point with at most so many false positives per image; 0 if there is none."""
    t = F.explode(F.array(*[F.lit(x) for x in targets])).alias("target")
    at = curve.select("*", t)
    return at.groupBy("target").agg(F.coalesce(F.max(F.when(F.col("fppi") <= F.col("target"), F.col("recall"))), F.lit(0.0)).alias("recall"))
