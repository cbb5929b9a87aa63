"""Typed settings: defaults, overrides by key, ranges; also as relations for settings that change while a stream runs."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What the operators are run with. Values outside their ranges are moved to the nearest end; numbers that are not
    finite fall back to the default."""

    confidence_learning: float = 0.25
    confidence_active: float = 0.35
    classifier_threshold: float = 0.25
    learning_days: int = 7
    window_days: int = 30
    min_iou: float = 0.7
    eps: float = 60.0
    min_samples: int = 3
    retention_days: int = 30
    retention_bytes: int = 600_000_000
    segmenter_min_box: int = 64
    max_attempts: int = 4
    head_fallback: bool = True


#: Least and greatest value of each number.
RANGES: dict[str, tuple[float, float]] = {
    "confidence_learning": (0, 1), "confidence_active": (0, 1), "classifier_threshold": (0, 1), "learning_days": (0, 365), "window_days": (1, 365), "min_iou": (0, 1),
    "eps": (1, 10_000), "min_samples": (1, 10_000), "retention_days": (0, 3650), "retention_bytes": (0, 2**62), "segmenter_min_box": (0, 4096), "max_attempts": (1, 100),
}
_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def _parsed(name: str, value, default):
    if isinstance(default, bool):
        word = str(value).strip().lower()
        if word in _TRUE or word in _FALSE:
            return word in _TRUE
        raise ValueError(f"{name}: {value!r} is neither true nor false")
    try:
        number = float(str(value).strip())
    except ValueError:
        raise ValueError(f"{name}: {value!r} is no number") from None
    if not math.isfinite(number):
        return default
    low, high = RANGES[name]
    return type(default)(min(max(number, low), high))


def override(base: Settings, values: dict[str, object]) -> Settings:
    """The settings with values in place of defaults; an unknown key or a value of another type is an error."""
    known = {f.name for f in fields(Settings)}
    if unknown := sorted(set(values) - known):
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return replace(base, **{k: _parsed(k, v, getattr(base, k)) for k, v in values.items()})


def from_environment(environment: dict[str, str], prefix: str = "FRAMELAKE_") -> Settings:
    """Settings from variables such as FRAMELAKE_MIN_IOU; empty ones count as not set."""
    return override(Settings(), {k[len(prefix) :].lower(): v for k, v in environment.items() if k.startswith(prefix) and v.strip()})


def as_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(key, value, low, high): one row a number."""
    rows = [(k, float(v), float(RANGES[k][0]), float(RANGES[k][1])) for k, v in asdict(settings).items() if k in RANGES]
    return spark.createDataFrame(rows, "key string, value double, low double, high double")


def effective(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value, status) of live overrides (key, value as text) over defaults: ``default``, ``override``, ``clamped``,
    ``invalid`` (no finite number; the default holds) or ``unknown``. A key is overridden once at most."""
    number = F.expr("try_cast(trim(given) AS DOUBLE)")
    at = defaults.withColumnRenamed("value", "base").join(overrides.select("key", F.col("value").alias("given")), "key", "full_outer").withColumn("number", F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number))
    value = F.least(F.greatest("number", "low"), "high")
    status = F.when(F.col("base").isNull(), "unknown").when(F.col("given").isNull(), "default").when(F.col("number").isNull(), "invalid").when(value != F.col("number"), "clamped").otherwise("override")
    return at.select("key", F.when(F.col("base").isNotNull(), F.when(F.col("number").isNull(), F.col("base")).otherwise(value)).alias("value"), status.alias("status"))
