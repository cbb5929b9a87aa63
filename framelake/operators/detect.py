"""Detection post-processing: suppression, matching, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geometry import iou
from framelake.operators.graph import checkpointed, smallest_reachable


def _iou(a: Column, b: Column) -> Column:
    return iou(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"], b["x2"], b["y2"])


def nms(dets: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Greedy non-maximum suppression per group of ``keys`` (an image, so groups are small): by falling score, ties by
    det_idx, a box stays unless a box that stays overlaps it by more than the threshold."""
    box = F.struct((-F.col("score")).alias("o"), "det_idx", "x1", "y1", "x2", "y2")
    ordered = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("ds"))
    fold = F.aggregate("ds", F.slice("ds", 1, 0), lambda acc, d: F.when(F.exists(acc, lambda k: _iou(k, d) > threshold), acc).otherwise(F.concat(acc, F.array(d))))
    return ordered.select(*keys, F.explode(fold).alias("d")).select(*keys, "d.det_idx", (-F.col("d.o")).alias("score"))


def best_overlap(dets: DataFrame, gt: DataFrame) -> DataFrame:
    """Each detection with the ground-truth box of its image that it overlaps most (ties: the lowest), nulls if none."""
    pairs = dets.alias("d").join(gt.alias("g"), "image_id", "left")
    o = iou("d.x1", "d.y1", "d.x2", "d.y2", "g.x1", "g.y1", "g.x2", "g.y2")
    best = F.max(F.when(o > 0, F.struct(o.alias("iou"), (-F.col("g.gt_idx")).alias("neg"))))
    return pairs.groupBy("image_id", F.col("d.det_idx").alias("det_idx"), F.col("d.score").alias("score")).agg(best.alias("b")).select("image_id", "det_idx", "score", F.coalesce("b.iou", F.lit(0.0)).alias("iou"), (-F.col("b.neg")).alias("gt_idx"))


def label_detections(dets: DataFrame, gt: DataFrame, threshold: float, counted: Column | None = None) -> DataFrame:
    """Labels TP, FP or EXCLUDED. A detection whose best box overlaps it less than the threshold is FP; whose best box is not
    ``counted`` is EXCLUDED; of those with the same best box the first by score is TP, later ones FP."""
    flags = gt.select("image_id", "gt_idx", (counted if counted is not None else F.lit(True)).alias("counted"))
    m = best_overlap(dets, gt).join(flags, ["image_id", "gt_idx"], "left")
    hit = F.coalesce(F.col("iou") >= threshold, F.lit(False))
    first = F.row_number().over(Window.partitionBy("image_id", "gt_idx", "use").orderBy(F.desc("score"), "det_idx"))
    m = m.withColumn("use", hit & F.coalesce("counted", F.lit(False)))
    label = F.when(~hit, "FP").when(~F.col("counted"), "EXCLUDED").when(first == 1, "TP").otherwise("FP")
    return m.select("image_id", "det_idx", "score", "gt_idx", "iou", label.alias("label"))


def difficulty(w: Column, h: Column, blur: Column, illum: Column, occ: Column, pose: Column) -> Column:
    side = F.least(w, h)
    return F.when((side >= 60) & (blur == 0) & (illum == 0) & (occ == 0) & (pose == 0), "easy").when((side < 30) | (blur == 2) | (occ == 2), "hard").otherwise("medium")


def difficulty_rank(label: Column) -> Column:
    return F.when(label == "easy", 0).when(label == "medium", 1).otherwise(2)


def head_boxes(persons: DataFrame, kept: DataFrame, fraction: float, frame_height: float, least: float = 8.0) -> DataFrame:
    """Upper parts of the person boxes of images in which no face was kept."""
    p = persons.join(kept.select("image_id").distinct(), "image_id", "left_anti")
    head = F.greatest((F.col("y2") - F.col("y1")) * fraction, F.lit(least))
    return p.withColumn("y2", F.least(F.col("y1") + head, F.lit(frame_height)))


def places(points: DataFrame, key: str = "camera_id") -> DataFrame:
    """(key, x, y, points): each place once, however many points it has. A fixed camera sees the same pixels again and again."""
    return points.groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("points"))


def _near(a: DataFrame, b: DataFrame, eps: float, key: str) -> DataFrame:
    """Rows of a (key, ax, ay, ...) beside those of b (key, bx, by, ...) of the same key within eps: each place of a meets those
    of the nine cells of size eps around it, so the join is by equal cells."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = a.withColumn("o", around).withColumn("cx", F.floor(F.col("ax") / eps) + F.col("o.i")).withColumn("cy", F.floor(F.col("ay") / eps) + F.col("o.j")).drop("o")
    b = b.withColumn("cx", F.floor(F.col("bx") / eps)).withColumn("cy", F.floor(F.col("by") / eps))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.join(b, [key, "cx", "cy"]).where(dx * dx + dy * dy <= eps * eps).drop("cx", "cy")


def near_places(at: DataFrame, eps: float, key: str = "camera_id") -> DataFrame:
    """(key, ax, ay, bx, by, points of b) of places of a key within eps of each other, themselves included: grows with the pixels
    of a cell of size eps squared but not with its points."""
    a = at.select(key, F.col("x").alias("ax"), F.col("y").alias("ay"))
    return _near(a, at.select(key, F.col("x").alias("bx"), F.col("y").alias("by"), "points"), eps, key).select(key, "ax", "ay", "bx", "by", "points")


def neighbourhoods(points: DataFrame, eps: float, key: str = "camera_id") -> DataFrame:
    """(key, x, y, neighbors): the points within eps of each place, its own included."""
    near = near_places(places(points, key), eps, key)
    return near.groupBy(key, F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum("points").alias("neighbors"))


def clustered_places(points: DataFrame, eps: float, min_samples: int, key: str = "camera_id") -> DataFrame:
    """(key, x, y, core): the places of the points that density clustering keeps: cores, with at least min_samples points
    within eps (themselves counted), and what is within eps of a core."""
    near = near_places(places(points, key), eps, key)
    counts = near.groupBy(key, F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum("points").alias("n"))
    cores = counts.where(F.col("n") >= min_samples).select(key, F.col("x").alias("ax"), F.col("y").alias("ay"))
    members = near.join(cores, [key, "ax", "ay"]).select(key, F.col("bx").alias("x"), F.col("by").alias("y")).distinct()
    own = cores.select(key, F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(True).alias("core"))
    return members.join(own, [key, "x", "y"], "left").select(key, "x", "y", F.coalesce("core", F.lit(False)).alias("core"))


def cluster_ids(points: DataFrame, eps: float, min_samples: int, key: str = "camera_id", pid: str = "event_id") -> DataFrame:
    """(key, point, cluster) of the points that density clustering keeps. Cores within eps of each other are of one cluster;
    clusters are numbered from 0 per key by their smallest core; any other point is of the first cluster with a core within
    eps. Works on distinct places. All places of a tile, a square of side 0.7 eps, are within eps of each other: those of a tile
    of min_samples points are cores, and the cores of a tile are of one cluster, so what is linked is tiles, each named after its
    smallest core. Points without a key or with a coordinate that is null or not finite are near nothing."""
    side = 0.7 * eps
    finite = F.col(key).isNotNull() & (F.col("x") - F.col("x") == 0) & (F.col("y") - F.col("y") == 0)
    at = points.where(finite).groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("points"), F.min(pid).alias("first"))
    at = checkpointed(at.withColumn("tx", F.floor(F.col("x") / side)).withColumn("ty", F.floor(F.col("y") / side)))
    tile = [key, "tx", "ty"]
    full = at.join(at.groupBy(*tile).agg(F.sum("points").alias("n")).where(F.col("n") >= min_samples), tile, "left").withColumn("full", F.col("n").isNotNull())
    a = full.where("NOT full").select(key, F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = at.select(key, F.col("x").alias("bx"), F.col("y").alias("by"), "points")
    lone = _near(a, b, eps, key).groupBy(key, F.col("ax").alias("x"), F.col("ay").alias("y")).agg((F.sum("points") >= min_samples).alias("enough"))
    judged = checkpointed(full.join(lone, [key, "x", "y"], "left").select(key, "x", "y", "first", "tx", "ty", (F.col("full") | F.coalesce("enough", F.lit(False))).alias("core")))
    tiles = checkpointed(judged.where("core").groupBy(*tile).agg(F.min("first").alias("u")))
    cores = judged.where("core").join(tiles, tile).select(key, "x", "y", "u")
    a, b = (cores.select(key, F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y"), F.col("u").alias(v)) for e, v in (("a", "u"), ("b", "v")))
    links = _near(a, b, eps, key).where("u <> v").select(key, "u", "v").distinct()
    found = smallest_reachable(tiles.select(key, "u"), checkpointed(links), key, "u")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("least")) - 1
    numbers = found.select(key, "least").distinct().withColumn("cluster", rank.cast("long"))
    core_of = cores.join(found.join(numbers, [key, "least"]), [key, "u"]).select(key, "x", "y", "cluster")
    a = judged.where("NOT core").select(key, F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = core_of.select(key, F.col("x").alias("bx"), F.col("y").alias("by"), "cluster")
    rim = _near(a, b, eps, key).groupBy(key, F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.min("cluster").alias("cluster"))
    return points.select(key, pid, "x", "y").join(core_of.unionByName(rim), [key, "x", "y"]).select(key, pid, "cluster")


def frame_results(frames: DataFrame, faces: DataFrame, persons: DataFrame, cameras: DataFrame, learning: float = 0.25, active: float = 0.35, fraction: float = 0.35) -> DataFrame:
    """What happens to each frame, a row each: (image_id, camera_id, branch, kept, heads, error).

    frames: image_id, camera_id, width, height (null if undecodable); faces, persons: image_id, det_idx, box, score (faces);
    cameras: camera_id, state, roi_x0 to roi_y1 (null if unknown). The camera's state is that of the given snapshot: a frame
    does not see what other frames of its batch do to it. An undecodable frame is a row with an error and nothing else; an
    unknown camera is LEARNING. INITIAL: the whole frame. LEARNING: all faces over ``learning``. ACTIVE: faces over ``active``
    whose centre is in the region, if there is one. A frame without any kept face has the heads of its persons, in the region too
    when ACTIVE. A frame whose boxes are damaged (null) falls back to the whole frame, with an error."""
    cams = cameras.select("camera_id", "state", "roi_x0", "roi_y0", "roi_x1", "roi_y1")
    at = frames.join(cams, "camera_id", "left").withColumn("state", F.coalesce("state", F.lit("LEARNING"))).withColumn("readable", F.col("width").isNotNull() & F.col("height").isNotNull())
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = F.col("roi_x0").isNull() | ((cx >= F.col("roi_x0")) & (cx < F.col("roi_x1")) & (cy >= F.col("roi_y0")) & (cy < F.col("roi_y1")))
    gate = (F.col("state") != "ACTIVE") | inside
    own = at.select("image_id", "state", "roi_x0", "roi_y0", "roi_x1", "roi_y1")
    over = F.col("score") >= F.when(F.col("state") == "ACTIVE", active).otherwise(learning)
    damaged = F.col("x1").isNull() | F.col("y1").isNull() | F.col("x2").isNull() | F.col("y2").isNull() | F.col("score").isNull()
    kept = faces.join(own, "image_id").groupBy("image_id").agg(F.count_if(over & gate).alias("kept"), F.count_if(damaged).alias("damaged"))
    heads = persons.join(own, "image_id").groupBy("image_id").agg(F.count_if(gate).alias("heads"))
    n = lambda c: F.coalesce(c, F.lit(0))
    out = at.join(kept, "image_id", "left").join(heads, "image_id", "left")
    error = F.when(~F.col("readable"), "undecodable frame").when(n("damaged") > 0, "damaged boxes")
    boxes = F.col("readable") & (n("damaged") == 0) & (F.col("state") != "INITIAL")
    branch = F.when(~F.col("readable"), "dropped").when(~boxes, "full_frame").when(n("kept") > 0, "faces").when(n("heads") > 0, "heads").otherwise("nothing")
    return out.select("image_id", "camera_id", branch.alias("branch"), F.when(branch == "faces", n("kept")).otherwise(0).alias("kept"), F.when(branch == "heads", n("heads")).otherwise(0).alias("heads"), error.alias("error"))


def clustered(points: DataFrame, eps: float, min_samples: int, key: str = "camera_id", pid: str = "event_id") -> DataFrame:
    """(key, point, core) of the points at ``clustered_places``."""
    return points.select(key, pid, "x", "y").join(clustered_places(points, eps, min_samples, key), [key, "x", "y"]).select(key, pid, "core")
