"""Queries over cameras, their detections and regions of interest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.fixtures import table
from framelake.functions import geometry as G
from framelake.operators import detect as D
from framelake.operators import roi as R

EPS, MIN_SAMPLES = 60.0, 3


def _cam(spark, sf):
    return table(spark, sf, "fx_cameras")


def _det(spark, sf):
    return table(spark, sf, "fx_detections")


def cameras_all(spark, sf) -> DataFrame:
    return _cam(spark, sf).orderBy("camera_id")


def cameras_learning(spark, sf) -> DataFrame:
    return _cam(spark, sf).where("state = 'LEARNING'").orderBy("camera_id")


def camera_by_id(spark, sf) -> DataFrame:
    return _cam(spark, sf).where("camera_id = 'CAM_007'")


def state_counts(spark, sf) -> DataFrame:
    s = F.col("state")
    return _cam(spark, sf).groupBy(F.when(s.isin("INITIAL", "LEARNING", "ACTIVE"), s).otherwise("INITIAL").alias("state")).agg(F.count(F.lit(1)).alias("cameras"))


def camera_merge(spark, sf) -> DataFrame:
    """Cameras after a batch's updates: the first known geometry stays, state follows."""
    up = _det(spark, sf).groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), F.max("x").cast("int").alias("w"), F.max("y").cast("int").alias("h"))
    c = _cam(spark, sf).join(up, "camera_id", "full_outer")
    state = F.when(F.col("state").isNull() | ((F.col("state") == "INITIAL") & (F.col("n") > 0)), "LEARNING").otherwise(F.col("state"))
    return c.select("camera_id", state.alias("state"), F.coalesce("frame_width", "w").alias("frame_width"), F.coalesce("frame_height", "h").alias("frame_height"), F.coalesce("n", F.lit(0)).alias("detections"))


def polygon_area(spark, sf) -> DataFrame:
    ring = G.rectangle("roi_x0", "roi_y0", "roi_x1", "roi_y1")
    return _cam(spark, sf).select("camera_id", G.polygon_area(ring).alias("area"), G.polygon_area(G.scale_ring(ring, 1.5)).alias("grown"))


def polygon_iou(spark, sf) -> DataFrame:
    """Stored against candidate region, and what is decided."""
    a = G.rectangle("roi_x0", "roi_y0", "roi_x1", "roi_y1")
    b = G.rectangle(F.col("roi_x0") + 150, "roi_y0", F.col("roi_x1") + 150, F.col("roi_y1") - 90)
    overlap = F.round(R.polygon_iou(a, b, 1920, 1080), 9)
    c = _cam(spark, sf).withColumn("overlap", overlap)
    return c.select("camera_id", "overlap", R.decide(F.col("state") == "ACTIVE", F.col("frame_width").isNotNull(), F.col("overlap"), 0.7).alias("decision"))


def knob_clamp(spark, sf) -> DataFrame:
    """Settings clamped to their ranges; a value that is not finite falls back."""
    c = _cam(spark, sf)
    d = F.col("learning_days_elapsed")
    thr = F.when(d % 9 == 0, F.lit(float("nan"))).otherwise(d / 20)
    return c.select("camera_id", G.clamp(F.when(F.isnan(thr), F.lit(0.5)).otherwise(thr), 0.0, 1.0).alias("threshold"), G.clamp(d - 5, 1, 20).cast("long").alias("days"), (thr > 0.25).alias("above"))


def next_run(spark, sf) -> DataFrame:
    """Seconds until the next 03:30; exactly then, a whole day."""
    now = F.col("learning_days_elapsed") * 2100
    until = F.lit(12600) - now
    return _cam(spark, sf).select("camera_id", F.when(until > 0, until).otherwise(until + 86400).cast("long").alias("seconds"))


def detections_for_camera(spark, sf) -> DataFrame:
    return _det(spark, sf).where("camera_id = 'CAM_003'")


def detections_since(spark, sf) -> DataFrame:
    d = _det(spark, sf)
    cut = d.agg((F.max("captured_at") - F.expr("INTERVAL 10 DAYS")).alias("cut"))
    return d.where("camera_id = 'CAM_003'").join(F.broadcast(cut), F.col("captured_at") >= F.col("cut")).select("event_id", "camera_id", "x", "y", "confidence", "captured_at")


def prune_detections(spark, sf) -> DataFrame:
    """What a run of 30 days would delete and leave, per camera."""
    d = _det(spark, sf)
    cut = d.agg((F.max("captured_at") - F.expr("INTERVAL 15 DAYS")).alias("cut"))
    old = F.col("captured_at") < F.col("cut")
    return d.crossJoin(F.broadcast(cut)).groupBy("camera_id").agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("remaining"))


def eps_neighbors(spark, sf) -> DataFrame:
    """Points that density clustering keeps, with their neighbour counts."""
    d = _det(spark, sf)
    at = ["camera_id", "x", "y"]
    kept = D.clustered_places(d, EPS, MIN_SAMPLES).join(D.neighbourhoods(d, EPS), at)
    return d.join(kept, at).select("camera_id", "event_id", "neighbors", "core")


def roi_gate(spark, sf) -> DataFrame:
    """Per camera, detections inside its region; without geometry all count."""
    ring = G.rectangle("roi_x0", "roi_y0", "roi_x1", "roi_y1")
    c = _cam(spark, sf).select("camera_id", F.when(F.col("frame_width").isNotNull(), ring).alias("ring"))
    inside = F.col("ring").isNull() | G.point_in_polygon(F.col("ring"), F.col("x"), F.col("y"))
    return _det(spark, sf).join(F.broadcast(c), "camera_id").groupBy("camera_id").agg(F.count(F.lit(1)).alias("detections"), F.count_if(inside).alias("inside"))


def confidence_gate(spark, sf) -> DataFrame:
    thr = F.when(F.col("state") == "ACTIVE", 0.35).otherwise(0.25)
    return _det(spark, sf).join(F.broadcast(_cam(spark, sf).select("camera_id", "state")), "camera_id").groupBy("camera_id", "state").agg(F.count_if(F.col("confidence") >= thr).alias("kept"), F.count(F.lit(1)).alias("detections"))


def fp_candidates(spark, sf) -> DataFrame:
    c = _cam(spark, sf).where("state = 'LEARNING'").select("camera_id")
    return _det(spark, sf).where("confidence >= 0.25 AND confidence < 0.4").join(F.broadcast(c), "camera_id", "left_semi").select("event_id", "camera_id", "confidence")


def convex_hull(spark, sf) -> DataFrame:
    """Vertices of the hull of all detections, per camera."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ring = R.convex_hull(rows[["x", "y"]].to_numpy())
        return pd.DataFrame({"camera_id": key[0], "x": ring[:, 0], "y": ring[:, 1]})

    return R.hull_candidates(_det(spark, sf)).groupBy("camera_id").applyInPandas(one, "camera_id string, x double, y double")


def extract_roi(spark, sf) -> DataFrame:
    """Regions learned from all detections (density clustering, hull, simplification, growth, area check)."""
    r = R.extract_roi(_det(spark, sf), _cam(spark, sf), EPS, MIN_SAMPLES, 5.0, 0.1, 0.02, 1.5)
    return r.select("camera_id", "outcome", F.size("polygon").cast("long").alias("vertices"), F.round("area_ratio", 6).alias("area_ratio"))


def camera_fsm(spark, sf) -> DataFrame:
    """State after each camera's events in order: an operator's reset, a first frame, a finished learning period."""
    event = F.when(F.col("event_id") % 97 == 0, "reset").when(F.col("event_id") % 31 == 0, "learned").otherwise("frame")
    e = _det(spark, sf).select("camera_id", F.struct("captured_at", "event_id", event.alias("e")).alias("s"))
    # only the last reset or learned event matters, and whether a frame came after a reset
    last = e.groupBy("camera_id").agg(F.max(F.when(F.col("s.e") != "frame", F.col("s"))).alias("last"), F.max(F.when(F.col("s.e") == "frame", F.struct("s.captured_at", "s.event_id"))).alias("frame"))
    after = F.coalesce(F.col("frame") > F.struct("last.captured_at", "last.event_id"), F.lit(False))
    state = F.when(F.col("last").isNull(), "LEARNING").when(F.col("last.e") == "learned", "ACTIVE").when(after, "LEARNING").otherwise("INITIAL")
    return last.select("camera_id", state.alias("state"))


def busiest_days(spark, sf) -> DataFrame:
    """The three days with most detections of each camera."""
    d = _det(spark, sf).groupBy("camera_id", F.to_date("captured_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("n"), "day"))
    return d.withColumn("r", r.cast("long")).where("r <= 3").select("camera_id", F.col("day").cast("string").alias("day"), "n", "r")


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_NEAR = "p AS (SELECT a.camera_id, a.event_id AS a, b.event_id AS b FROM fx_detections a JOIN fx_detections b ON a.camera_id = b.camera_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 3600), n AS (SELECT camera_id, a, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT DISTINCT p.camera_id, p.b FROM p JOIN n ON p.a = n.a AND n.n >= 3)"

# lowest and highest points of each x whose edges to the left are all flatter (below) or steeper (above) than those to the right
_HULL = (
    "lo AS (SELECT camera_id, x, min(y) AS y FROM {points} GROUP BY 1, 2), up AS (SELECT camera_id, x, -max(y) AS y FROM {points} GROUP BY 1, 2), "
    "s AS (SELECT 1 AS f, * FROM lo UNION ALL SELECT -1 AS f, * FROM up), "
    "k AS (SELECT p.f, p.camera_id, p.x, p.y, max((p.y-q.y)/(p.x-q.x)) FILTER (WHERE q.x < p.x) AS l, min((p.y-q.y)/(p.x-q.x)) FILTER (WHERE q.x > p.x) AS r FROM s p LEFT JOIN s q ON p.f = q.f AND p.camera_id = q.camera_id AND p.x <> q.x GROUP BY 1, 2, 3, 4), "
    "h AS (SELECT DISTINCT camera_id, x, f * y AS y FROM k WHERE l IS NULL OR r IS NULL OR l < r)"
)

ORACLES = {
    "cameras_all": "SELECT * FROM fx_cameras",
    "cameras_learning": "SELECT * FROM fx_cameras WHERE state = 'LEARNING'",
    "camera_by_id": "SELECT * FROM fx_cameras WHERE camera_id = 'CAM_007'",
    "state_counts": "SELECT state, count(*) AS cameras FROM fx_cameras GROUP BY 1",
    "camera_merge": "WITH u AS (SELECT camera_id, count(*) AS n, CAST(max(x) AS INT) AS w, CAST(max(y) AS INT) AS h FROM fx_detections GROUP BY 1) SELECT camera_id, CASE WHEN state IS NULL OR (state = 'INITIAL' AND n > 0) THEN 'LEARNING' ELSE state END AS state, coalesce(frame_width, w) AS frame_width, coalesce(frame_height, h) AS frame_height, coalesce(n, 0) AS detections FROM fx_cameras FULL JOIN u USING (camera_id)",
    "polygon_area": "SELECT camera_id, (roi_x1-roi_x0)*(roi_y1-roi_y0) AS area, (roi_x1-roi_x0)*(roi_y1-roi_y0)*2.25 AS grown FROM fx_cameras",
    "polygon_iou": "WITH g AS (SELECT x*20 AS x, y*20 AS y FROM range(96) a(x), range(54) b(y)), s AS (SELECT camera_id, state, frame_width, count(*) FILTER (WHERE x >= roi_x0 AND x < roi_x1 AND y >= roi_y0 AND y < roi_y1) AS a, count(*) FILTER (WHERE x >= roi_x0+150 AND x < roi_x1+150 AND y >= roi_y0 AND y < roi_y1-90) AS b, count(*) FILTER (WHERE x >= roi_x0+150 AND x < roi_x1 AND y >= roi_y0 AND y < roi_y1-90) AS i FROM fx_cameras, g GROUP BY 1, 2, 3), o AS (SELECT *, round(i / (a + b - i), 9) AS overlap FROM s) SELECT camera_id, overlap, CASE WHEN state <> 'ACTIVE' THEN 'replace' WHEN frame_width IS NULL THEN 'geometry_changed' WHEN overlap >= 0.7 THEN 'keep_stable' ELSE 'replace' END AS decision FROM o",
    "knob_clamp": "SELECT camera_id, CASE WHEN learning_days_elapsed % 9 = 0 THEN 0.5 ELSE least(greatest(learning_days_elapsed/20, 0), 1) END AS threshold, least(greatest(learning_days_elapsed - 5, 1), 20) AS days, learning_days_elapsed % 9 = 0 OR learning_days_elapsed/20 > 0.25 AS above FROM fx_cameras",
    "next_run": "SELECT camera_id, CASE WHEN 12600 - learning_days_elapsed*2100 > 0 THEN 12600 - learning_days_elapsed*2100 ELSE 99000 - learning_days_elapsed*2100 END AS seconds FROM fx_cameras",
    "detections_for_camera": "SELECT * FROM fx_detections WHERE camera_id = 'CAM_003'",
    "detections_since": "SELECT * FROM fx_detections WHERE camera_id = 'CAM_003' AND captured_at >= (SELECT max(captured_at) FROM fx_detections) - INTERVAL 10 DAYS",
    "prune_detections": "WITH c AS (SELECT max(captured_at) - INTERVAL 15 DAYS AS cut FROM fx_detections) SELECT camera_id, count(*) FILTER (WHERE captured_at < cut) AS deleted, count(*) FILTER (WHERE captured_at >= cut) AS remaining FROM fx_detections, c GROUP BY 1",
    "eps_neighbors": f"WITH {_NEAR} SELECT m.camera_id, m.b AS event_id, n.n AS neighbors, n.n >= 3 AS core FROM m JOIN n ON m.b = n.a",
    "roi_gate": "SELECT d.camera_id, count(*) AS detections, count(*) FILTER (WHERE c.frame_width IS NULL OR (x >= roi_x0 AND x < roi_x1 AND y >= roi_y0 AND y < roi_y1)) AS inside FROM fx_detections d JOIN fx_cameras c ON d.camera_id = c.camera_id GROUP BY 1",
    "confidence_gate": "SELECT d.camera_id, c.state, count(*) FILTER (WHERE confidence >= CASE WHEN state = 'ACTIVE' THEN 0.35 ELSE 0.25 END) AS kept, count(*) AS detections FROM fx_detections d JOIN fx_cameras c ON d.camera_id = c.camera_id GROUP BY 1, 2",
    "fp_candidates": "SELECT event_id, d.camera_id, confidence FROM fx_detections d JOIN fx_cameras c ON d.camera_id = c.camera_id WHERE state = 'LEARNING' AND confidence >= 0.25 AND confidence < 0.4",
    "convex_hull": f"WITH {_HULL.format(points='fx_detections')} SELECT camera_id, x, y FROM h",
    "camera_fsm": "WITH e AS (SELECT camera_id, captured_at, event_id, CASE WHEN event_id % 97 = 0 THEN 'reset' WHEN event_id % 31 = 0 THEN 'learned' ELSE 'frame' END AS e FROM fx_detections), r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY captured_at DESC, event_id DESC) AS rn, row_number() OVER (PARTITION BY camera_id, e <> 'frame' ORDER BY captured_at DESC, event_id DESC) AS rk FROM e), s AS (SELECT camera_id, max(CASE WHEN e <> 'frame' AND rk = 1 THEN e END) AS last, max(CASE WHEN e <> 'frame' AND rk = 1 THEN rn END) AS newest FROM r GROUP BY 1) SELECT camera_id, CASE WHEN last IS NULL THEN 'LEARNING' WHEN last = 'learned' THEN 'ACTIVE' WHEN newest > 1 THEN 'LEARNING' ELSE 'INITIAL' END AS state FROM s",
    "busiest_days": "WITH d AS (SELECT camera_id, CAST(CAST(captured_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM fx_detections GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, day) AS r FROM d) SELECT * FROM r WHERE r <= 3",
}
