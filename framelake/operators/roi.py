"""Regions of interest learned from where a camera detects faces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.operators.detect import clustered_places


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Hull vertices from the lowest x, y on, counter-clockwise in a y-up frame; collinear points go. Each step works on the
    chain so far."""
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-1] - out[-2], p - out[-2]
                if ax * by - ay * bx > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def column_ends(points: np.ndarray) -> np.ndarray:
    """Of the points of each x the lowest and the highest: no other can be a hull vertex."""
    if not len(points):
        return points
    pts = points[np.lexsort((points[:, 1], points[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], pts[1:, 0] != pts[:-1, 0])))
    return np.concatenate((pts[first], pts[np.append(first[1:], len(pts)) - 1]))


def farthest_pair(ring: np.ndarray) -> tuple[int, int]:
    """The first two vertices, by place, that are farthest apart; a row of distances at a time."""
    best, pair = -1.0, (0, 0)
    for i in range(len(ring) - 1):
        d = ((ring[i + 1 :] - ring[i]) ** 2).sum(1)
        k = int(d.argmax())
        if d[k] > best:
            best, pair = d[k], (i, i + 1 + k)
    return pair


def simplify_ring(ring: np.ndarray, epsilon: float) -> np.ndarray:
    """Ramer-Douglas-Peucker on the two chains between the ring's farthest vertices, with an explicit stack."""
    ring = np.asarray(ring, float)
    n = len(ring)
    if n <= 3 or epsilon <= 0:
        return ring
    i, j = farthest_pair(ring)
    order = [*range(i, j + 1), *range(j + 1, n), *range(0, i + 1)]
    keep = {0, j - i, len(order) - 1}
    todo = [(0, j - i), (j - i, len(order) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = ring[order[a]], ring[order[b]], ring[order[a + 1 : b]]
        along = q - p
        length = float(along @ along)
        foot = p + np.outer(((mid - p) @ along) / length, along) if length else np.broadcast_to(p, mid.shape)
        far = ((mid - foot) ** 2).sum(1)
        k = int(far.argmax())
        if far[k] > epsilon * epsilon:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[[order[k] for k in sorted(keep)[:-1]]]


def hull_candidates(points: DataFrame, key: str = "camera_id") -> DataFrame:
    """Per camera only points that can be hull vertices: the vertices of the hulls of each partition's points, a batch after
    another. The hull of hulls is the hull of all, for coordinates of any kind; no detection is shuffled."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hulls: dict[str, np.ndarray] = {}
        for rows in batches:
            for k, part in rows.groupby(key):
                hulls[k] = convex_hull(np.concatenate((hulls.get(k, np.zeros((0, 2))), column_ends(part[["x", "y"]].to_numpy(float)))))
        for k, ring in hulls.items():
            yield pd.DataFrame({key: k, "x": ring[:, 0], "y": ring[:, 1]})

    return points.select(F.col(key).cast("string").alias(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(f"{key} IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").mapInPandas(partial, f"{key} string, x double, y double")


def extract_roi(points: DataFrame, cameras: DataFrame, eps: float = 50.0, min_samples: int = 15, epsilon: float = 5.0, margin: float = 0.1, area_min: float = 0.02, area_max: float = 0.9) -> DataFrame:
    """(camera_id, outcome, polygon, area_ratio) of each camera with points and known geometry.

    Points in no dense neighbourhood go; the hull of all others together is simplified, grown by ``margin`` about its
    centre, and valid if its area, after growing, is area_min to area_max of the frame. Outcomes: polygon, invalid,
    insufficient.
    """
    kept = clustered_places(points, eps, min_samples)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ring = simplify_ring(convex_hull(rows[["x", "y"]].to_numpy()), epsilon) if len(rows) >= 3 else np.zeros((0, 2))
        return pd.DataFrame({"camera_id": [key[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in ring]]})

    rings = hull_candidates(kept).groupBy("camera_id").applyInPandas(one, "camera_id string, ring array<struct<x:double,y:double>>")
    at = cameras.where("frame_width IS NOT NULL").join(points.select("camera_id").distinct(), "camera_id", "left_semi").join(rings, "camera_id", "left")
    grown = G.scale_ring(F.col("ring"), 1 + margin)
    at = at.withColumn("polygon", F.when(F.size(F.coalesce("ring", F.array().cast("array<struct<x:double,y:double>>"))) >= 3, grown))
    ratio = G.polygon_area(F.col("polygon")) / (F.col("frame_width") * F.col("frame_height"))
    outcome = F.when(F.col("polygon").isNull(), "insufficient").when(ratio.between(area_min, area_max), "polygon").otherwise("invalid")
    return at.select("camera_id", outcome.alias("outcome"), "polygon", ratio.alias("area_ratio"))


def finalized(points: DataFrame, cameras: DataFrame, learning_days: int, **how) -> DataFrame:
    """(camera_id, outcome, polygon, area_ratio, state) of the cameras that are due: LEARNING, of known geometry, and for at
    least ``learning_days``. A region from all their detections that is valid makes them ACTIVE; otherwise they stay."""
    due = cameras.where("state = 'LEARNING' AND frame_width IS NOT NULL AND frame_height IS NOT NULL").where(F.col("learning_days_elapsed") >= learning_days)
    found = extract_roi(points.join(F.broadcast(due.select("camera_id")), "camera_id", "left_semi"), due, **how)
    every = due.select("camera_id").join(found, "camera_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("insufficient")))
    return every.withColumn("state", F.when(F.col("outcome") == "polygon", "ACTIVE").otherwise("LEARNING"))


def readopted(points: DataFrame, cameras: DataFrame, now: Column, window_days: int, min_iou: float, width: int, height: int, **how) -> DataFrame:
    """(camera_id, outcome, overlap, decision) of ACTIVE cameras, whose regions follow a sliding window of detections.

    cameras: also ``ring`` (the region in use, null if none), ``ring_width`` and ``ring_height`` (the geometry it was made
    for). A valid candidate is adopted if there is no region, if the geometry has changed, or if the two overlap less than
    min_iou; else the region is kept. Without a valid candidate it is kept as well."""
    act = cameras.where("state = 'ACTIVE' AND frame_width IS NOT NULL")
    recent = points.where(F.col("captured_at") >= now - F.make_dt_interval(F.lit(window_days))).join(F.broadcast(act.select("camera_id")), "camera_id", "left_semi")
    found = extract_roi(recent, act.drop("ring", "ring_width", "ring_height"), **how)
    at = act.select("camera_id", F.col("ring").alias("in_use"), "ring_width", "ring_height", F.col("frame_width").alias("width"), F.col("frame_height").alias("height")).join(found, "camera_id", "left")
    same = (F.col("ring_width") == F.col("width")) & (F.col("ring_height") == F.col("height"))
    valid = F.coalesce(F.col("outcome") == "polygon", F.lit(False))
    overlap = F.when(valid & F.col("in_use").isNotNull(), F.round(polygon_iou(F.col("in_use"), F.col("polygon"), width, height), 9))
    decision = F.when(~valid, "keep_no_candidate").otherwise(decide(F.col("in_use").isNotNull(), F.coalesce(same, F.lit(False)), overlap, min_iou))
    return at.select("camera_id", F.coalesce("outcome", F.lit("insufficient")).alias("outcome"), overlap.alias("overlap"), decision.alias("decision"))


def polygon_iou(a: Column, b: Column, width: int, height: int) -> Column:
    """Overlap of two rings by samples on a grid of 96 cells along the longer side."""
    cell = max(1, -(-max(width, height) // 96))
    xs, ys = (F.transform(F.sequence(F.lit(0), F.lit(n - 1), F.lit(cell)), lambda v: v.cast("double")) for n in (width, height))
    both = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: G.point_in_polygon(a, x, y).cast("int") + 2 * G.point_in_polygon(b, x, y).cast("int"))))
    count = lambda v: F.size(F.filter(both, v))
    return F.coalesce(F.try_divide(count(lambda v: v == 3), count(lambda v: v > 0)), F.lit(0.0))


def decide(has_current: Column, same_geometry: Column, overlap: Column, min_iou: float) -> Column:
    return F.when(~has_current, "replace").when(~same_geometry, "geometry_changed").when(overlap >= min_iou, "keep_stable").otherwise("replace")
