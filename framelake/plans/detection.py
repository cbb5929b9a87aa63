"""Queries over boxes, detections and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.fixtures import table
from framelake.functions import geometry as G
from framelake.operators import detect as D
from framelake.operators import evaluate as E
from framelake.operators.running import running_sums

_IOU = "CASE WHEN least({a}.x2,{b}.x2) > greatest({a}.x1,{b}.x1) AND least({a}.y2,{b}.y2) > greatest({a}.y1,{b}.y1) THEN (least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) / (({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)-(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))) ELSE 0 END"
_DIFF = "CASE WHEN least(x2-x1,y2-y1) >= 60 AND blur=0 AND illum=0 AND occ=0 AND pose=0 THEN 'easy' WHEN least(x2-x1,y2-y1) < 30 OR blur=2 OR occ=2 THEN 'hard' ELSE 'medium' END"


def _dets(spark, sf):
    return table(spark, sf, "fx_dets")


def _gt(spark, sf):
    g = table(spark, sf, "fx_gt")
    c = F.col
    return g.withColumn("difficulty", D.difficulty(c("x2") - c("x1"), c("y2") - c("y1"), c("blur"), c("illum"), c("occ"), c("pose")))


def box_iou(spark, sf) -> DataFrame:
    d, g = _dets(spark, sf).alias("d"), table(spark, sf, "fx_gt").alias("g")
    o = G.iou("d.x1", "d.y1", "d.x2", "d.y2", "g.x1", "g.y1", "g.x2", "g.y2")
    return d.join(g, "image_id").select("image_id", "d.det_idx", "g.gt_idx", F.round(o, 9).alias("iou")).where("iou > 0")


def expand_box(spark, sf) -> DataFrame:
    b = G.expand_box("x1", "y1", "x2", "y2", G.learning_margin("x1", "y1", "x2", "y2"), 960, 720)
    return _dets(spark, sf).select("image_id", "det_idx", *[F.round(v, 6).alias(k) for k, v in b.items()])


def crop_clamp(spark, sf) -> DataFrame:
    return _dets(spark, sf).select("image_id", "det_idx", *[v.alias(k) for k, v in G.crop_clamp("x1", "y1", "x2", "y2", 800, 600).items()])


def letterbox(spark, sf) -> DataFrame:
    return _dets(spark, sf).select("image_id", "det_idx", *[F.round(v, 6).alias(k) for k, v in G.letterbox(F.col("x2") + 10, F.col("y2") + 10, 640).items()])


def sigma_feather(spark, sf) -> DataFrame:
    w = F.col("x2") - F.col("x1")
    return _dets(spark, sf).select("image_id", "det_idx", G.blur_sigma(w).alias("sigma"), F.greatest(F.lit(1), F.round(G.blur_sigma(w) * 0.5).cast("long")).alias("feather"))


def ellipse_bbox(spark, sf) -> DataFrame:
    b = G.ellipse_bbox((F.col("x2") - F.col("x1")) / 2, (F.col("y2") - F.col("y1")) / 2, F.col("score"), F.col("x1"), F.col("y1"))
    return _dets(spark, sf).select("image_id", "det_idx", *[F.round(v, 6).alias(k) for k, v in b.items()])


def downscale_dims(spark, sf) -> DataFrame:
    s = G.downscaled((F.col("x2") * 3).cast("long"), (F.col("y2") * 2 + 9).cast("long"), 640)
    return _dets(spark, sf).select("image_id", "det_idx", *[v.alias(k) for k, v in s.items()])


def difficulty(spark, sf) -> DataFrame:
    return _gt(spark, sf).select("image_id", "gt_idx", "difficulty")


def gt_counts(spark, sf) -> DataFrame:
    return _gt(spark, sf).where("ignored = 0").groupBy("difficulty", "pose").agg(F.count(F.lit(1)).alias("faces"))


def seed_filter(spark, sf) -> DataFrame:
    """Faces at least as hard as medium that are not ignored, of images that keep any."""
    kept = _gt(spark, sf).where((D.difficulty_rank(F.col("difficulty")) >= 1) & (F.col("ignored") == 0))
    return kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("faces"), F.min("gt_idx").alias("first_face"))


def yolo_label_norm(spark, sf) -> DataFrame:
    """Label lines `cls cx cy w h`; whether a file is in shares of the frame is told by its first box."""
    b = table(spark, sf, "fx_boxes")
    scale = F.when(F.col("image_id") % 2 == 0, 1000.0).otherwise(1.0)
    line = F.concat_ws(" ", F.lit("0"), *[(F.col(c) / scale).cast("string") for c in ("x1", "y1", "w", "h")])
    parts = F.split("line", " ")
    v = b.select("image_id", "idx", line.alias("line")).select("image_id", "idx", *[F.element_at(parts, k + 2).cast("double").alias(n) for k, n in enumerate(("cx", "cy", "w", "h"))])
    first = F.first(F.greatest(*[F.abs(F.col(c)) for c in ("cx", "cy", "w", "h")]) <= 1.5).over(Window.partitionBy("image_id").orderBy("idx"))
    v = v.withColumn("normalised", first)
    px = lambda c: F.round(F.when(F.col("normalised"), F.col(c) * 1000).otherwise(F.col(c)), 6)
    return v.select("image_id", "idx", "normalised", *[px(c).alias(c) for c in ("cx", "cy", "w", "h")])


def stride_sample(spark, sf) -> DataFrame:
    """Every third image that can be read, 200 at most; those that can't be read do not count."""
    i = _dets(spark, sf).select("image_id").distinct()
    i = running_sums(i, F.floor(F.col("image_id") / 1000), ("image_id",), n=F.lit(1)).withColumn("pos", F.col("n") - 1)
    return i.where("pos % 3 = 0 AND image_id % 11 <> 0").orderBy("pos").limit(200).select("image_id", F.col("pos").cast("long").alias("pos"))


def match_wider(spark, sf) -> DataFrame:
    return D.label_detections(_dets(spark, sf), _gt(spark, sf), 0.5, (F.col("ignored") == 0) & (F.col("difficulty") == "medium")).select("image_id", "det_idx", "label")


def match_pose(spark, sf) -> DataFrame:
    return D.label_detections(_dets(spark, sf), _gt(spark, sf), 0.5, (F.col("ignored") == 0) & (F.col("pose") == 1)).select("image_id", "det_idx", "label")


def match_fddb(spark, sf) -> DataFrame:
    return D.label_detections(_dets(spark, sf), _gt(spark, sf), 0.5).select("image_id", "det_idx", "label")


def _curve(spark, sf):
    gt = _gt(spark, sf)
    labels = D.label_detections(_dets(spark, sf), gt, 0.5, (F.col("ignored") == 0) & (F.col("difficulty") == "medium"))
    return E.pr_sweep(labels, gt.where("ignored = 0 AND difficulty = 'medium'"))


def pr_sweep(spark, sf) -> DataFrame:
    return _curve(spark, sf).select("k", "tp", "proposals", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def voc_ap(spark, sf) -> DataFrame:
    return E.average_precision(_curve(spark, sf)).select(F.round("ap", 9).alias("ap"))


def operating_points(spark, sf) -> DataFrame:
    return E.operating_points(_curve(spark, sf)).select("conf", "k", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def _fddb(spark, sf):
    gt, dets = _gt(spark, sf), _dets(spark, sf)
    return E.fppi_curve(D.label_detections(dets, gt, 0.5), dets.select("image_id").distinct(), gt)


def fppi_curve(spark, sf) -> DataFrame:
    return _fddb(spark, sf).select("score", F.round("fppi", 9).alias("fppi"), F.round("recall", 9).alias("recall"))


def fppi_points(spark, sf) -> DataFrame:
    return E.fppi_points(_fddb(spark, sf)).select("target", F.round("recall", 9).alias("recall"))


def nms(spark, sf) -> DataFrame:
    return D.nms(_dets(spark, sf), 0.1).select("image_id", "det_idx")


def missed_faces(spark, sf) -> DataFrame:
    """Faces that no detection of score 0.6 or more overlaps by more than 0.45."""
    d = _dets(spark, sf).where("score >= 0.6").alias("d")
    g = table(spark, sf, "fx_gt").alias("g")
    o = G.iou("d.x1", "d.y1", "d.x2", "d.y2", "g.x1", "g.y1", "g.x2", "g.y2")
    return g.join(d, (F.col("g.image_id") == F.col("d.image_id")) & (o > 0.45), "left_anti").select("image_id", "gt_idx")


def head_fallback(spark, sf) -> DataFrame:
    d = _dets(spark, sf)
    return D.head_boxes(d.where("score < 0.5"), d.where("score >= 0.5"), 0.35, 600.0).select("image_id", "det_idx", F.round("y2", 6).alias("y2"))


def fallback_hist(spark, sf) -> DataFrame:
    per = head_fallback(spark, sf).groupBy("image_id").agg(F.count(F.lit(1)).alias("heads"))
    return per.groupBy("heads").agg(F.count(F.lit(1)).alias("images"))


def clf_benefit(spark, sf) -> DataFrame:
    p = F.col("score")
    d = _dets(spark, sf).withColumn("p_face", (F.col("det_idx") * 37 + F.col("image_id")) % 100 / 100)
    kept = F.col("p_face") >= 0.25
    a = d.agg(F.count_if(p >= 0.3).alias("without"), F.count_if((p >= 0.3) & kept).alias("with_classifier"), F.count_if((p >= 0.3) & ~kept & (F.col("p_face") < 0.1)).alias("dubious"), F.count_if((p >= 0.9) & ~kept).alias("lost"))
    return a.select("*", F.round((F.col("without") - F.col("with_classifier")) * 100.0 / F.col("without"), 6).alias("reduction_pct"))


def blur_quality(spark, sf) -> DataFrame:
    """State by face width, with totals (a rollup)."""
    d = _dets(spark, sf).withColumn("w", F.col("x2") - F.col("x1")).withColumn("ratio", (F.col("det_idx") * 13 + F.col("image_id")) % 100 / 100)
    state = F.when((F.col("score") > 0.6) & (F.col("ratio") < 0.45), "BLURRED").when(F.col("ratio") >= 0.8, "CLEAR").otherwise("PARTIAL")
    bucket = F.when(F.col("w") < 40, "SMALL").when(F.col("w") < 120, "MED").otherwise("BIG")
    r = d.select(bucket.alias("bucket"), state.alias("state"), "score").rollup("bucket", "state").agg(F.count(F.lit(1)).alias("faces"), F.round(F.avg("score"), 9).alias("mean_alpha"))
    return r.select(F.coalesce("bucket", F.lit("ALL")).alias("bucket"), F.coalesce("state", F.lit("ALL")).alias("state"), "faces", "mean_alpha")


def camera_summary(spark, sf) -> DataFrame:
    """Images, detections and the branch of the lowest image, per camera."""
    d = _dets(spark, sf).withColumn("camera_id", F.concat(F.lit("CAM_"), F.lpad((F.col("image_id") % 25).cast("string"), 3, "0")))
    branch = F.element_at(F.array(F.lit("learning"), F.lit("active"), F.lit("initial")), (F.col("image_id") % 3 + 1).cast("int"))
    return d.groupBy("camera_id").agg(F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("detections"), F.count_if(F.col("score") < 0.2).alias("fp_crops"), F.min_by(branch, "image_id").alias("branch"))


def inference_stats(spark, sf) -> DataFrame:
    """Runs and mean milliseconds by stage in fixed order, 0 for a stage that did not run."""
    stages = spark.createDataFrame([(0, "detector"), (1, "classifier"), (2, "segmenter")], "pos int, stage string")
    runs = _dets(spark, sf).select(F.when(F.col("score") > 0.5, "detector").otherwise("classifier").alias("stage"), ((F.col("x1") + F.col("y1")) % 50).alias("ms"))
    a = runs.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("m"))
    return F.broadcast(stages).join(a, "stage", "left").select("pos", "stage", F.coalesce("n", F.lit(0)).alias("runs"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("avg_ms"))


def background_anti(spark, sf) -> DataFrame:
    """Background crops that keep 8 pixels from every box of 10 pixels or more of their image."""
    e = _dets(spark, sf)
    crops = e.select("image_id", "det_idx", ((F.col("x1") * 7) % 700).alias("left"), ((F.col("y1") * 5) % 500).alias("top"), (80 + (F.col("x1") % 140)).alias("cw"), (80 + (F.col("y1") % 140)).alias("ch"))
    boxes = table(spark, sf, "fx_boxes").where("least(w, h) >= 10").select(F.col("image_id").alias("i"), "x1", "y1", "w", "h")
    c = F.col
    apart = (c("left") + c("cw") < c("x1") - 8) | (c("left") > c("x1") + c("w") + 8) | (c("top") + c("ch") < c("y1") - 8) | (c("top") > c("y1") + c("h") + 8)
    return crops.join(boxes, (c("image_id") == c("i")) & ~apart, "left_anti")


def per_image_cap(spark, sf) -> DataFrame:
    """Up to 4 faces of an image, by score, and 1,000 in all."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_idx"))
    return _dets(spark, sf).withColumn("r", rank).where("r <= 4").orderBy("image_id", "r").limit(1000).select("image_id", "det_idx", F.col("r").cast("long").alias("r"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_M = f"g AS (SELECT *, {_DIFF} AS difficulty FROM fx_gt), o AS (SELECT d.image_id, d.det_idx, d.score, g.gt_idx, g.ignored, g.difficulty, g.pose, {_IOU.format(a='d', b='g')} AS iou FROM fx_dets d LEFT JOIN g ON d.image_id = g.image_id), b AS (SELECT *, row_number() OVER (PARTITION BY image_id, det_idx ORDER BY coalesce(iou, 0) DESC, gt_idx) AS rn FROM o), m AS (SELECT *, coalesce(iou, 0) >= 0.5 AS hit FROM b WHERE rn = 1)"


def _labelled(counted: str) -> str:
    return _M + f", u AS (SELECT *, hit AND ({counted}) AS use FROM m), l AS (SELECT image_id, det_idx, score, CASE WHEN NOT hit THEN 'FP' WHEN NOT ({counted}) THEN 'EXCLUDED' WHEN row_number() OVER (PARTITION BY image_id, gt_idx, use ORDER BY score DESC, det_idx) = 1 THEN 'TP' ELSE 'FP' END AS label FROM u)"


_SWEEP = _labelled("ignored = 0 AND difficulty = 'medium'") + ", t AS (SELECT k, 1 - (k + 1) / 1000.0::DOUBLE AS thr FROM range(1000) r(k)), f AS (SELECT count(*) AS faces FROM g WHERE ignored = 0 AND difficulty = 'medium'), s AS (SELECT score, count(*) FILTER (WHERE label = 'TP') AS tp, count(*) AS n FROM l WHERE label <> 'EXCLUDED' GROUP BY 1), c AS (SELECT t.k, t.thr, CAST(coalesce(sum(s.tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS proposals FROM t LEFT JOIN s ON s.score >= t.thr GROUP BY 1, 2), v AS (SELECT k, thr, tp, proposals, CASE WHEN proposals > 0 THEN tp / proposals ELSE 0 END AS precision, CASE WHEN faces > 0 THEN tp / faces ELSE 0 END AS recall FROM c, f)"
_FDDB = _labelled("true") + ", i AS (SELECT count(DISTINCT image_id) AS images FROM fx_dets), f AS (SELECT count(*) AS faces FROM fx_gt), s AS (SELECT score, count(*) FILTER (WHERE label = 'TP') AS t, count(*) FILTER (WHERE label = 'FP') AS f FROM l GROUP BY 1), c AS (SELECT score, sum(s.f) OVER (ORDER BY score DESC) / images AS fppi, sum(s.t) OVER (ORDER BY score DESC) / faces AS recall FROM s, i, f)"
_KEPT_HEADS = "h AS (SELECT image_id, det_idx, round(least(y1 + greatest((y2 - y1) * 0.35, 8), 600), 6) AS y2 FROM fx_dets d WHERE score < 0.5 AND NOT EXISTS (SELECT 1 FROM fx_dets k WHERE k.image_id = d.image_id AND k.score >= 0.5))"
_QUALITY = "q AS (SELECT CASE WHEN x2-x1 < 40 THEN 'SMALL' WHEN x2-x1 < 120 THEN 'MED' ELSE 'BIG' END AS bucket, CASE WHEN score > 0.6 AND (det_idx*13+image_id)%100/100 < 0.45 THEN 'BLURRED' WHEN (det_idx*13+image_id)%100/100 >= 0.8 THEN 'CLEAR' ELSE 'PARTIAL' END AS state, score FROM fx_dets)"

ORACLES = {
    "box_iou": f"SELECT * FROM (SELECT d.image_id, d.det_idx, g.gt_idx, round({_IOU.format(a='d', b='g')}, 9) AS iou FROM fx_dets d JOIN fx_gt g ON d.image_id = g.image_id) x WHERE iou > 0",
    "expand_box": "WITH m AS (SELECT *, greatest(x2-x1, y2-y1) * 0.15 AS m FROM fx_dets) SELECT image_id, det_idx, round(least(greatest(x1-m,0),960),6) AS x0, round(least(greatest(y1-m,0),720),6) AS y0, round(least(greatest(x2+m,0),960),6) AS x1, round(least(greatest(y2+m,0),720),6) AS y1 FROM m",
    "crop_clamp": "WITH c AS (SELECT image_id, det_idx, CAST(least(greatest(floor(x1),0),792) AS BIGINT) AS x, CAST(least(greatest(floor(y1),0),592) AS BIGINT) AS y, ceil(x2-x1) AS bw, ceil(y2-y1) AS bh FROM fx_dets) SELECT image_id, det_idx, x, y, CAST(least(greatest(bw,8),800-x) AS BIGINT) AS w, CAST(least(greatest(bh,8),600-y) AS BIGINT) AS h FROM c",
    "letterbox": "WITH s AS (SELECT image_id, det_idx, x2+10 AS w, y2+10 AS h, least(640/(x2+10), 640/(y2+10)) AS scale FROM fx_dets) SELECT image_id, det_idx, round(scale,6) AS scale, round((640-w*scale)/2,6) AS pad_x, round((640-h*scale)/2,6) AS pad_y FROM s",
    "sigma_feather": "WITH s AS (SELECT image_id, det_idx, least(greatest((x2-x1)/4, 5), 50) AS sigma FROM fx_dets) SELECT image_id, det_idx, sigma, greatest(1, CAST(round(sigma*0.5) AS BIGINT)) AS feather FROM s",
    "ellipse_bbox": "WITH e AS (SELECT image_id, det_idx, x1, y1, sqrt(pow((x2-x1)/2*cos(score),2)+pow((y2-y1)/2*sin(score),2)) AS hw, sqrt(pow((x2-x1)/2*sin(score),2)+pow((y2-y1)/2*cos(score),2)) AS hh FROM fx_dets) SELECT image_id, det_idx, round(x1-hw,6) AS x1, round(y1-hh,6) AS y1, round(x1+hw,6) AS x2, round(y1+hh,6) AS y2 FROM e",
    "downscale_dims": "WITH s AS (SELECT image_id, det_idx, CAST(x2*3 AS BIGINT) AS w, CAST(y2*2+9 AS BIGINT) AS h FROM fx_dets) SELECT image_id, det_idx, CASE WHEN greatest(w,h) <= 640 THEN w ELSE greatest(w*640//greatest(w,h),1) END AS w, CASE WHEN greatest(w,h) <= 640 THEN h ELSE greatest(h*640//greatest(w,h),1) END AS h FROM s",
    "difficulty": f"SELECT image_id, gt_idx, {_DIFF} AS difficulty FROM fx_gt",
    "gt_counts": f"SELECT {_DIFF} AS difficulty, pose, count(*) AS faces FROM fx_gt WHERE ignored = 0 GROUP BY 1, 2",
    "seed_filter": f"SELECT image_id, count(*) AS faces, min(gt_idx) AS first_face FROM (SELECT *, {_DIFF} AS difficulty FROM fx_gt) g WHERE difficulty <> 'easy' AND ignored = 0 GROUP BY 1",
    "yolo_label_norm": "WITH v AS (SELECT image_id, idx, x1/s AS cx, y1/s AS cy, w/s AS w, h/s AS h FROM (SELECT *, CASE WHEN image_id % 2 = 0 THEN 1000.0 ELSE 1.0 END AS s FROM fx_boxes) b), n AS (SELECT *, first_value(greatest(abs(cx),abs(cy),abs(w),abs(h)) <= 1.5) OVER (PARTITION BY image_id ORDER BY idx) AS normalised FROM v) SELECT image_id, idx, normalised, round(CASE WHEN normalised THEN cx*1000 ELSE cx END,6) AS cx, round(CASE WHEN normalised THEN cy*1000 ELSE cy END,6) AS cy, round(CASE WHEN normalised THEN w*1000 ELSE w END,6) AS w, round(CASE WHEN normalised THEN h*1000 ELSE h END,6) AS h FROM n",
    "stride_sample": "WITH i AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS pos FROM (SELECT DISTINCT image_id FROM fx_dets) x) SELECT image_id, pos FROM i WHERE pos % 3 = 0 AND image_id % 11 <> 0 ORDER BY pos LIMIT 200",
    "match_wider": "WITH " + _labelled("ignored = 0 AND difficulty = 'medium'") + " SELECT image_id, det_idx, label FROM l",
    "match_pose": "WITH " + _labelled("ignored = 0 AND pose = 1") + " SELECT image_id, det_idx, label FROM l",
    "match_fddb": "WITH " + _labelled("true") + " SELECT image_id, det_idx, label FROM l",
    "pr_sweep": "WITH " + _SWEEP + " SELECT k, tp, proposals, round(precision, 9) AS precision, round(recall, 9) AS recall FROM v",
    "voc_ap": "WITH " + _SWEEP + ", e AS (SELECT recall - lag(recall, 1, 0) OVER (ORDER BY k) AS dr, max(precision) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM v) SELECT round(sum(dr * p), 9) AS ap FROM e",
    "operating_points": "WITH " + _SWEEP + " SELECT CAST(conf AS DOUBLE) AS conf, max(k) AS k, round(arg_max(precision, k), 9) AS precision, round(arg_max(recall, k), 9) AS recall FROM v, (SELECT unnest([0.5, 0.25, 0.1, 0.05, 0.02]) AS conf) c WHERE thr + 1e-9 >= CAST(CAST(conf AS FLOAT) AS DOUBLE) GROUP BY conf",
    "fppi_curve": "WITH " + _FDDB + " SELECT score, round(fppi, 9) AS fppi, round(recall, 9) AS recall FROM c",
    "fppi_points": "WITH " + _FDDB + " SELECT CAST(target AS DOUBLE) AS target, round(coalesce(max(CASE WHEN fppi <= target THEN recall END), 0), 9) AS recall FROM c, (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0]) AS target) t GROUP BY target",
    "nms": "WITH RECURSIVE o AS (SELECT image_id, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'i': det_idx} ORDER BY score DESC, det_idx) AS ds FROM fx_dets GROUP BY 1), r(image_id, ds, n, kept) AS (SELECT image_id, ds, 1, ds[1:1] FROM o UNION ALL SELECT image_id, ds, n + 1, CASE WHEN len(list_filter(kept, lambda a: " + _IOU.format(a="a", b="ds[n+1]") + " > 0.1)) > 0 THEN kept ELSE list_append(kept, ds[n+1]) END FROM r WHERE n < len(ds)) SELECT image_id, unnest(kept).i AS det_idx FROM r WHERE n = len(ds)",
    "missed_faces": f"SELECT g.image_id, g.gt_idx FROM fx_gt g WHERE NOT EXISTS (SELECT 1 FROM fx_dets d WHERE d.image_id = g.image_id AND d.score >= 0.6 AND {_IOU.format(a='d', b='g')} > 0.45)",
    "head_fallback": f"WITH {_KEPT_HEADS} SELECT * FROM h",
    "fallback_hist": f"WITH {_KEPT_HEADS}, p AS (SELECT image_id, count(*) AS heads FROM h GROUP BY 1) SELECT heads, count(*) AS images FROM p GROUP BY 1",
    "clf_benefit": "WITH d AS (SELECT score, (det_idx*37+image_id)%100/100 AS p FROM fx_dets), a AS (SELECT count(*) FILTER (WHERE score >= 0.3) AS without, count(*) FILTER (WHERE score >= 0.3 AND p >= 0.25) AS with_classifier, count(*) FILTER (WHERE score >= 0.3 AND p < 0.1) AS dubious, count(*) FILTER (WHERE score >= 0.9 AND p < 0.25) AS lost FROM d) SELECT *, round((without - with_classifier) * 100.0 / without, 6) AS reduction_pct FROM a",
    "blur_quality": f"WITH {_QUALITY} SELECT coalesce(bucket, 'ALL') AS bucket, coalesce(state, 'ALL') AS state, count(*) AS faces, round(avg(score), 9) AS mean_alpha FROM q GROUP BY ROLLUP (bucket, state)",
    "camera_summary": "SELECT 'CAM_' || lpad(CAST(image_id % 25 AS VARCHAR), 3, '0') AS camera_id, count(DISTINCT image_id) AS images, count(*) AS detections, count(*) FILTER (WHERE score < 0.2) AS fp_crops, CASE min(image_id) % 3 WHEN 0 THEN 'learning' WHEN 1 THEN 'active' ELSE 'initial' END AS branch FROM fx_dets GROUP BY 1",
    "inference_stats": "WITH s(pos, stage) AS (VALUES (0, 'detector'), (1, 'classifier'), (2, 'segmenter')), a AS (SELECT CASE WHEN score > 0.5 THEN 'detector' ELSE 'classifier' END AS stage, count(*) AS n, avg((x1+y1) % 50) AS m FROM fx_dets GROUP BY 1) SELECT pos, s.stage, coalesce(n, 0) AS runs, round(coalesce(m, 0), 6) AS avg_ms FROM s LEFT JOIN a ON s.stage = a.stage",
    "background_anti": "WITH c AS (SELECT image_id, det_idx, (x1*7)%700 AS \"left\", (y1*5)%500 AS top, 80+x1%140 AS cw, 80+y1%140 AS ch FROM fx_dets) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM fx_boxes b WHERE b.image_id = c.image_id AND least(b.w, b.h) >= 10 AND NOT (\"left\"+cw < b.x1-8 OR \"left\" > b.x1+b.w+8 OR top+ch < b.y1-8 OR top > b.y1+b.h+8))",
    "per_image_cap": "WITH r AS (SELECT image_id, det_idx, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_idx) AS r FROM fx_dets) SELECT * FROM r WHERE r <= 4 ORDER BY image_id, r LIMIT 1000",
}
