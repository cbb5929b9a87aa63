"""Queries over settings, clusters, scheduled regions, whole frames, retention and batch errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.fixtures import table
from framelake.functions import geometry as G
from framelake.operators import detect as D
from framelake.operators import jobs as J
from framelake.operators import roi as R
from framelake.operators import settings as S

EPS, MIN_SAMPLES = 60.0, 3


def settings_effective(spark, sf) -> DataFrame:
    """Live overrides, a few per nation, over the defaults."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    names = F.array(*map(F.lit, ["min_iou", "eps", "window_days", "learning_days", "no_such_key"]))
    rows = n.where("n_nationkey < 5").select(F.element_at(names, (k + 1).cast("int")).alias("key"), F.when(k == 1, "not a number").when(k == 2, " 900 ").otherwise((k * 3).cast("string")).alias("value"))
    return S.effective(S.as_table(spark, S.Settings()), rows)


def dbscan_labels(spark, sf) -> DataFrame:
    return D.cluster_ids(table(spark, sf, "fx_detections"), EPS, MIN_SAMPLES)


def roi_finalize(spark, sf) -> DataFrame:
    """Cameras whose learning is over: hull of their clustered detections, grown by a tenth, valid by area."""
    r = R.finalized(table(spark, sf, "fx_detections"), table(spark, sf, "fx_cameras"), 7, eps=EPS, min_samples=MIN_SAMPLES, epsilon=0.0, margin=0.1, area_min=0.02, area_max=1.1)
    return r.select("camera_id", "outcome", F.size("polygon").cast("long").alias("vertices"), F.round("area_ratio", 6).alias("area_ratio"), "state")


def roi_dynamic(spark, sf) -> DataFrame:
    """Regions in use against those of the last ten days of detections."""
    d = table(spark, sf, "fx_detections")
    ring = G.rectangle("roi_x0", "roi_y0", "roi_x1", "roi_y1")
    c = table(spark, sf, "fx_cameras").select("*", F.when(F.col("learning_days_elapsed") % 3 != 0, ring).alias("ring"), F.lit(1920).alias("ring_width"), F.when(F.col("learning_days_elapsed") % 4 == 0, 720).otherwise(1080).alias("ring_height"))
    newest = d.agg(F.max("captured_at").alias("now"))
    return R.readopted(d.crossJoin(F.broadcast(newest)), c, F.col("now"), 10, 0.7, 1920, 1080, eps=EPS, min_samples=2, epsilon=5.0, margin=0.1, area_min=0.02, area_max=1.5)


def frame_branches(spark, sf) -> DataFrame:
    """What happens to each image: its camera by number, faces and persons by score, some frames or boxes damaged."""
    boxes = table(spark, sf, "fx_dets")
    i = F.col("image_id")
    cam = F.concat(F.lit("CAM_"), F.lpad((i % 27).cast("string"), 3, "0"))
    frames = boxes.select("image_id").distinct().select("image_id", cam.alias("camera_id"), F.when(i % 31 != 0, 1920).alias("width"), F.lit(1080).alias("height"))
    faces = boxes.where("score >= 0.3").withColumn("x1", F.when((i % 37 != 0) | (F.col("det_idx") != 1), F.col("x1")))
    return D.frame_results(frames, faces, boxes.where("score < 0.2"), table(spark, sf, "fx_cameras"), 0.6, 0.5)


def retention_rules(spark, sf) -> DataFrame:
    """The age rule, then the size rule on what it leaves."""
    files = table(spark, sf, "fx_jobs").select("job_idx", F.col("output_size").alias("length"), F.col("finished_at").alias("mtime"))
    ok = F.col("job_idx") % 10 != 0
    r = J.retention(files, F.lit("1993-01-01").cast("timestamp_ntz"), 500_000_000, ok, ("mtime", "job_idx"))
    return r.groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def batch_errors(spark, sf) -> DataFrame:
    """Errors of entries and of whole archives as one list, its length, and the first 50 for a response header."""
    entries = table(spark, sf, "fx_entries").where("size > 190000").select(F.col("archive_id").alias("at"), F.col("entry_idx").cast("long").alias("idx"), F.concat(F.lit("entry "), F.col("path")).alias("error"))
    hard = table(spark, sf, "fx_jobs").where("st = 'F' AND job_idx % 5 = 0").select(F.col("job_idx").alias("at"), F.lit(0).cast("long").alias("idx"), F.concat(F.lit("archive "), F.col("input")).alias("error"))
    return J.first_errors(entries.unionByName(hard), ("at", "idx"))


def covered_faces(spark, sf) -> DataFrame:
    """Faces that some detection of score 0.6 or more overlaps by more than 0.45."""
    d = table(spark, sf, "fx_dets").where("score >= 0.6").alias("d")
    g = table(spark, sf, "fx_gt").alias("g")
    o = G.iou("d.x1", "d.y1", "d.x2", "d.y2", "g.x1", "g.y1", "g.x2", "g.y2")
    return g.join(d, (F.col("g.image_id") == F.col("d.image_id")) & (o > 0.45), "left_semi").select("image_id", "gt_idx")


def segmenter_applies(spark, sf) -> DataFrame:
    """Boxes that a segmenter is run on: all if the least width is not positive, else those as wide."""
    w = F.col("x2") - F.col("x1")
    at = table(spark, sf, "fx_dets").select("image_id", w.alias("w"), F.explode(F.array(F.lit(0.0), F.lit(64.0), F.lit(100.0))).alias("least"))
    return at.groupBy("least").agg(F.count_if(G.segmenter_applies(F.col("w"), F.col("least"))).alias("applies"), F.count(F.lit(1)).alias("boxes"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_IOU = "(greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)))"
_OVERLAP = f"{_IOU} / ((d.x2-d.x1)*(d.y2-d.y1) + (g.x2-g.x1)*(g.y2-g.y1) - {_IOU})"
_DEFAULTS = " UNION ALL ".join(f"SELECT '{k}' AS key, CAST({getattr(S.Settings(), k)} AS DOUBLE) AS base, CAST({a} AS DOUBLE) AS low, CAST({b} AS DOUBLE) AS high" for k, (a, b) in S.RANGES.items())
_CORES = "p AS (SELECT a.camera_id, a.event_id AS a, b.event_id AS b FROM fx_detections a JOIN fx_detections b ON a.camera_id = b.camera_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 3600), n AS (SELECT camera_id, a FROM p GROUP BY 1, 2 HAVING count(*) >= 3), l AS (SELECT p.camera_id, p.a, p.b FROM p JOIN n u ON p.a = u.a JOIN n v ON p.b = v.a)"

ORACLES = {
    "settings_effective": f"WITH f AS ({_DEFAULTS}), o AS (SELECT ['min_iou','eps','window_days','learning_days','no_such_key'][n_nationkey+1] AS key, CASE n_nationkey WHEN 1 THEN 'not a number' WHEN 2 THEN ' 900 ' ELSE CAST(n_nationkey*3 AS VARCHAR) END AS given FROM nation WHERE n_nationkey < 5), j AS (SELECT coalesce(f.key, o.key) AS key, base, low, high, given, TRY_CAST(trim(given) AS DOUBLE) AS num FROM f FULL JOIN o ON f.key = o.key) SELECT key, CASE WHEN base IS NOT NULL THEN CASE WHEN num IS NULL THEN base ELSE least(greatest(num, low), high) END END AS value, CASE WHEN base IS NULL THEN 'unknown' WHEN given IS NULL THEN 'default' WHEN num IS NULL THEN 'invalid' WHEN least(greatest(num, low), high) <> num THEN 'clamped' ELSE 'override' END AS status FROM j",
    "dbscan_labels": f"WITH RECURSIVE {_CORES}, r(camera_id, a, b) AS (SELECT camera_id, a, b FROM l UNION SELECT r.camera_id, r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT camera_id, a, min(b) AS least FROM r GROUP BY 1, 2), i AS (SELECT camera_id, a, dense_rank() OVER (PARTITION BY camera_id ORDER BY least) - 1 AS cluster FROM c) SELECT p.camera_id, p.b AS event_id, min(i.cluster) AS cluster FROM p JOIN i ON p.a = i.a GROUP BY 1, 2",
    "roi_finalize": "WITH " + _CORES + ", due AS (SELECT * FROM fx_cameras WHERE state = 'LEARNING' AND frame_width IS NOT NULL AND learning_days_elapsed >= 7), "
    "m AS (SELECT DISTINCT d.camera_id, d.x, d.y FROM p JOIN n ON p.a = n.a JOIN fx_detections d ON d.event_id = p.b JOIN due ON due.camera_id = d.camera_id), "
    "lo AS (SELECT camera_id, x, min(y) AS y FROM m GROUP BY 1, 2), up AS (SELECT camera_id, x, -max(y) AS y FROM m GROUP BY 1, 2), s AS (SELECT 1 AS f, * FROM lo UNION ALL SELECT -1 AS f, * FROM up), "
    "k AS (SELECT p.f, p.camera_id, p.x, p.y, max((p.y-q.y)/(p.x-q.x)) FILTER (WHERE q.x < p.x) AS lft, min((p.y-q.y)/(p.x-q.x)) FILTER (WHERE q.x > p.x) AS rgt FROM s p LEFT JOIN s q ON p.f = q.f AND p.camera_id = q.camera_id AND p.x <> q.x GROUP BY 1, 2, 3, 4), "
    "h AS (SELECT camera_id, x, f * y AS y, max(f) AS f FROM k WHERE lft IS NULL OR rgt IS NULL OR lft < rgt GROUP BY 1, 2, 3), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY f DESC, f * x, f * y) AS r, count(*) OVER (PARTITION BY camera_id) AS n FROM h), "
    "a AS (SELECT o.camera_id, max(o.n) AS n, abs(sum(o.x * w.y - w.x * o.y)) / 2 * 1.21 / (1920 * 1080) AS ratio FROM o JOIN o w ON o.camera_id = w.camera_id AND w.r = o.r % o.n + 1 GROUP BY 1) "
    "SELECT due.camera_id, CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient' WHEN ratio BETWEEN 0.02 AND 1.1 THEN 'polygon' ELSE 'invalid' END AS outcome, CASE WHEN n >= 3 THEN n END AS vertices, CASE WHEN n >= 3 THEN round(ratio, 6) END AS area_ratio, CASE WHEN n >= 3 AND ratio BETWEEN 0.02 AND 1.1 THEN 'ACTIVE' ELSE 'LEARNING' END AS state FROM due LEFT JOIN a ON due.camera_id = a.camera_id",
    "frame_branches": "WITH i AS (SELECT DISTINCT image_id, 'CAM_' || lpad(CAST(image_id % 27 AS VARCHAR), 3, '0') AS camera_id FROM fx_dets), f AS (SELECT i.*, coalesce(c.state, 'LEARNING') AS state, roi_x0, roi_y0, roi_x1, roi_y1 FROM i LEFT JOIN fx_cameras c ON i.camera_id = c.camera_id), "
    "b AS (SELECT f.*, d.det_idx, d.score, CASE WHEN d.image_id % 37 = 0 AND d.det_idx = 1 THEN NULL ELSE d.x1 END AS fx, f.state <> 'ACTIVE' OR f.roi_x0 IS NULL OR ((d.x1+d.x2)/2 >= roi_x0 AND (d.x1+d.x2)/2 < roi_x1 AND (d.y1+d.y2)/2 >= roi_y0 AND (d.y1+d.y2)/2 < roi_y1) AS gate FROM fx_dets d JOIN f ON d.image_id = f.image_id), "
    "g AS (SELECT image_id, camera_id, state, count(*) FILTER (WHERE score >= 0.3 AND fx IS NOT NULL AND gate AND score >= CASE WHEN state = 'ACTIVE' THEN 0.5 ELSE 0.6 END) AS k, count(*) FILTER (WHERE score >= 0.3 AND fx IS NULL) AS bad, count(*) FILTER (WHERE score < 0.2 AND gate) AS h FROM b GROUP BY 1, 2, 3), "
    "r AS (SELECT *, CASE WHEN image_id % 31 = 0 THEN 'dropped' WHEN bad > 0 OR state = 'INITIAL' THEN 'full_frame' WHEN k > 0 THEN 'faces' WHEN h > 0 THEN 'heads' ELSE 'nothing' END AS branch FROM g) "
    "SELECT image_id, camera_id, branch, CASE WHEN branch = 'faces' THEN k ELSE 0 END AS kept, CASE WHEN branch = 'heads' THEN h ELSE 0 END AS heads, CASE WHEN image_id % 31 = 0 THEN 'undecodable frame' WHEN bad > 0 THEN 'damaged boxes' END AS error FROM r",
    "retention_rules": "WITH f AS (SELECT job_idx, output_size AS length, finished_at AS mtime, job_idx % 10 <> 0 AS ok FROM fx_jobs), a AS (SELECT *, ok AND mtime < TIMESTAMP '1993-01-01' AS aged FROM f), s AS (SELECT *, ok AND sum(length) OVER () - coalesce(sum(CASE WHEN ok THEN length ELSE 0 END) OVER (ORDER BY mtime, job_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 500000000 AS sized FROM a WHERE NOT aged), r AS (SELECT 'age' AS rule, length FROM a WHERE aged UNION ALL SELECT CASE WHEN sized THEN 'size' ELSE 'kept' END, length FROM s) SELECT rule, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM r GROUP BY 1",
    "batch_errors": "WITH e AS (SELECT archive_id AS k, CAST(entry_idx AS BIGINT) AS idx, 'entry ' || path AS error FROM fx_entries WHERE size > 190000 UNION ALL SELECT job_idx, 0, 'archive ' || input FROM fx_jobs WHERE st = 'F' AND job_idx % 5 = 0), t AS (SELECT * FROM e ORDER BY k, idx LIMIT 50) SELECT (SELECT count(*) FROM e) AS errors, url_encode('[' || string_agg('\"' || replace(error, chr(92), chr(92) || chr(92)) || '\"', ',' ORDER BY k, idx) || ']') AS header FROM t",
    "covered_faces": f"SELECT g.image_id, g.gt_idx FROM fx_gt g WHERE EXISTS (SELECT 1 FROM fx_dets d WHERE d.image_id = g.image_id AND d.score >= 0.6 AND {_OVERLAP} > 0.45)",
    "segmenter_applies": "SELECT least, count(*) FILTER (WHERE least <= 0 OR x2 - x1 >= least) AS applies, count(*) AS boxes FROM fx_dets, (VALUES (CAST(0 AS DOUBLE)), (64), (100)) t(least) GROUP BY 1",
}
