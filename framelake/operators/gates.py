"""Classifier thresholds, holdouts, balance and swap gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.running import running_sums


def threshold_table(samples: DataFrame, score: str, thresholds: tuple[float, ...], a: Column, b: Column, c: Column) -> DataFrame:
    """Per threshold: recall on sets a and b, false positives on c, accuracy on a and c. One pass over the samples."""
    over = samples.select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("thr"), F.col(score).alias("p"), a.alias("a"), b.alias("b"), c.alias("c"))
    hit = F.col("p") >= F.col("thr")
    n = lambda x: F.count_if(x)
    rate = lambda x, y: F.try_divide(x, y)
    return over.groupBy("thr").agg(
        rate(n(F.col("a") & hit), n(F.col("a"))).alias("recall_a"),
        rate(n(F.col("b") & hit), n(F.col("b"))).alias("recall_b"),
        n(F.col("c") & hit).alias("fp_c"),
        rate(n(F.col("a") & hit) + n(F.col("c") & ~hit), n(F.col("a") | F.col("c"))).alias("accuracy"),
    )


def recommended(table: DataFrame, min_a: float, min_b: float, default: float = 0.5) -> DataFrame:
    """The last threshold, going up, before the first that misses a recall; the default if the first already does."""
    ok = (F.round("recall_a", 4) >= min_a) & F.coalesce(F.round("recall_b", 4) >= min_b, F.lit(True))
    all_ok = F.bool_and(ok).over(Window.orderBy("thr").rowsBetween(Window.unboundedPreceding, 0))
    return table.select("thr", all_ok.alias("ok")).agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("thr"))), F.lit(default)).alias("threshold"))


def swap_decision(real: Column, fp: Column, candidate: Column, validated: Column, deployed: Column, least: float, eps: float) -> Column:
    """What a retraining run ends in."""
    return (
        F.when((real < 2) | (fp < 2), "skipped").when(candidate < least, "rejected_python").when(validated < least, "rejected_validation").when(deployed.isNotNull() & (validated < deployed - eps), "rejected_regression").otherwise("swapped")
    )


def first_per_class(samples: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first n of each class by a total order."""
    return samples.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("r") <= n).drop("r")


def class_balance(samples: DataFrame, label: str, order: str, ratio: float, bucket: Column | None = None) -> DataFrame:
    """Classes capped at max(round(smaller class * ratio), 2), halves rounded to even: the first of each by (bucket, order).

    Places are counted by buckets, so that no task has a whole class; classes are few. Without ``bucket``, which has to rise
    with the order, each value of ``order`` is one."""
    sizes = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    cap = sizes.agg(F.greatest(F.bround(F.min("n") * F.lit(ratio), 0).cast("long"), F.lit(2)).alias("cap"))
    before = sizes.select(F.col(label), F.coalesce(F.sum("n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = running_sums(samples, F.struct(F.col(label).alias("l"), (F.col(order) if bucket is None else bucket).alias("b")), (order,), r=F.lit(1))
    return ranked.join(F.broadcast(before), label).crossJoin(F.broadcast(cap)).where("r - before <= cap").drop("r", "cap", "before")
