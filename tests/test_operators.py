"""Relational forms against sequential ones on random relations."""

import random

import numpy as np
from pyspark.sql import functions as F

from framelake.operators import detect as D
from framelake.operators import evaluate as E
from framelake.operators import gates as K
from framelake.operators import jobs as J
from framelake.operators import roi
from framelake.operators.running import running_sums

BOX = "image_id long, {} long, x1 double, y1 double, x2 double, y2 double"


def boxes(rng, n, images):
    out = []
    for k in range(n):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        out.append((rng.randrange(images), k, float(x), float(y), float(x + rng.randint(5, 40)), float(y + rng.randint(5, 40))))
    return out


def overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return w * h / (area(a) + area(b) - w * h)


def test_suppression_and_matching(spark):
    rng = random.Random(1)
    dets = [(*b, rng.randrange(20) / 20) for b in boxes(rng, 300, 12)]
    gt = [(*b, rng.random() < 0.7) for b in boxes(rng, 120, 12)]
    d = spark.createDataFrame(dets, BOX.format("det_idx") + ", score double")
    g = spark.createDataFrame(gt, BOX.format("gt_idx") + ", ok boolean")

    kept = set()
    for image in range(12):
        stay = []
        for b in sorted((b for b in dets if b[0] == image), key=lambda b: (-b[6], b[1])):
            if all(overlap(k, b) <= 0.3 for k in stay):
                stay.append(b)
        kept |= {(b[0], b[1]) for b in stay}
    assert {(r.image_id, r.det_idx) for r in D.nms(d, 0.3).collect()} == kept

    labels = {}
    for image in range(12):
        used = set()
        for b in sorted((b for b in dets if b[0] == image), key=lambda b: (-b[6], b[1])):
            best, at = 0.0, None
            for t in (t for t in gt if t[0] == image):
                o = overlap(b, t)
                if o > best:
                    best, at = o, t
            if best < 0.4:
                labels[b[1]] = "FP"
            elif not at[6]:
                labels[b[1]] = "EXCLUDED"
            else:
                labels[b[1]] = "FP" if at[1] in used else "TP"
                used.add(at[1])
    out = D.label_detections(d, g, 0.4, F.col("ok"))
    assert {r.det_idx: r.label for r in out.collect()} == labels

    faces = g.where("ok")
    curve = {r.k: r for r in E.pr_sweep(out, faces).collect()}
    total = sum(t[6] for t in gt)
    counted = [(b[6], labels[b[1]]) for b in dets if labels[b[1]] != "EXCLUDED"]
    ps, rs = [], []
    for k in range(1000):
        thr = 1 - (k + 1) / 1000
        tp, n = sum(x == "TP" and s >= thr for s, x in counted), sum(s >= thr for s, x in counted)
        assert (curve[k].tp, curve[k].proposals) == (tp, n)
        ps.append(tp / n if n else 0.0)
        rs.append(tp / total)
    ap, last = 0.0, 0.0
    for k in range(1000):
        ap += (rs[k] - last) * max(ps[k:])
        last = rs[k]
    assert abs(E.average_precision(E.pr_sweep(out, faces)).first().ap - ap) < 1e-12
    points = E.operating_points(E.pr_sweep(out, faces)).orderBy("conf").collect()
    assert [r.k for r in points] == [979, 949, 898, 749, 499]


def test_neighbourhoods_and_regions(spark):
    rng = random.Random(2)
    pts = [("A", k, float(rng.randint(0, 400)), float(rng.randint(0, 300))) for k in range(250)] + [("B", k, 5.0, 5.0) for k in range(2)]
    p = spark.createDataFrame(pts, "camera_id string, event_id long, x double, y double")
    near = {(a[0], a[1]): [b for b in pts if b[0] == a[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 900] for a in pts}
    cores = {k for k, v in near.items() if len(v) >= 4}
    want = {(b[0], b[1], (b[0], b[1]) in cores) for k in cores for b in near[k]}
    assert {tuple(r) for r in D.clustered(p, 30.0, 4).collect()} == want
    cams = spark.createDataFrame([("A", 400, 300), ("B", 400, 300), ("C", 400, 300), ("D", None, None)], "camera_id string, frame_width int, frame_height int")
    got = {r.camera_id: r for r in roi.extract_roi(p, cams, 30.0, 4, 2.0, 0.1, 0.1, 1.5).collect()}
    assert got["A"].outcome == "polygon" and got["B"].outcome == "insufficient" and set(got) == {"A", "B"}
    kept = np.array([(b[2], b[3]) for b in pts if any((b[0], b[1]) == w[:2] for w in want) and b[0] == "A"])
    ring = roi.simplify_ring(roi.convex_hull(kept), 2.0)
    centre = ring.mean(0)
    assert np.allclose([(q.x, q.y) for q in got["A"].polygon], centre + (ring - centre) * 1.1)
    grid = spark.createDataFrame([("A", k, float(130 * (k % 12) + 150), float(130 * (k // 12) + 100)) for k in range(60)], "camera_id string, event_id long, x double, y double")
    full = spark.createDataFrame([("A", 1920, 1080)], "camera_id string, frame_width int, frame_height int")
    assert 0.1 < roi.extract_roi(grid, full, 130.0, 3).first().area_ratio < 0.9


def test_retention_and_latest(spark):
    rng = random.Random(3)
    files = [(k, rng.randint(1, 50), f"2024-01-{rng.randint(1, 9):02d} 0{rng.randint(0, 9)}:00:00", rng.random() < 0.7) for k in range(120)]
    f = spark.createDataFrame(files, "id long, length long, at string, old boolean").withColumn("mtime", F.to_timestamp("at"))
    total, gone = sum(x[1] for x in files), set()
    for k, n, _, old in sorted(files, key=lambda x: (x[2], x[0])):
        if total <= 900:
            break
        if old:
            total -= n
            gone.add(k)
    assert {r.id for r in J.size_retention(f, 900, F.col("old"), ("mtime", "id")).where("evicted").collect()} == gone
    events = [(rng.randrange(9), k, rng.randrange(5)) for k in range(80)]
    e = spark.createDataFrame(events, "job long, seq long, ts long")
    want = {j: max((t, s) for i, s, t in events if i == j) for j in {x[0] for x in events}}
    assert {r.job: (r.ts, r.seq) for r in J.latest(e, "job", "ts", "seq").collect()} == want


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = {r.k: r.s for r in running_sums(df, F.floor(F.col("k") / 37), ("k",), s=F.col("v")).collect()}
    assert [got[k] for k in range(500)] == np.cumsum([v for _, v in rows]).tolist()


def test_gates(spark):
    t = spark.createDataFrame([(0.25, 1.0, 0.99), (0.5, 0.99, None), (0.6, 0.9, 0.99), (0.75, 1.0, 1.0)], "thr double, recall_a double, recall_b double")
    assert K.recommended(t, 0.98, 0.95).first().threshold == 0.5
    assert K.recommended(t.where("thr = 0.6"), 0.98, 0.95).first().threshold == 0.5
    rows = [(1, 5, 0.9, 0.9, None), (5, 5, 0.8, 0.9, None), (5, 5, 0.9, 0.8, None), (5, 5, 0.9, 0.9, 0.95), (5, 5, 0.9, 0.9, 0.9)]
    d = spark.createDataFrame(rows, "real long, fp long, c double, v double, d double")
    c = F.col
    got = [r[0] for r in d.coalesce(1).select(K.swap_decision(c("real"), c("fp"), c("c"), c("v"), c("d"), 0.85, 0.0)).collect()]
    assert got == ["skipped", "rejected_python", "rejected_validation", "rejected_regression", "swapped"]
    s = spark.createDataFrame([(k, int(k < 5)) for k in range(40)], "k long, y int")
    assert {r.y: r["count"] for r in K.class_balance(s, "y", "k", 1.5).groupBy("y").count().collect()} == {0: 8, 1: 5}


def test_hull_of_any_coordinates(spark):
    """Fractions too: partial hulls lose no vertex, wherever the points are dealt."""
    rng = np.random.default_rng(6)
    clouds = [rng.normal(size=(400, 2)) * 50, rng.uniform(0, 1, (300, 2)), np.array([(0.0, 0.5), (0.9, 10), (0.95, 5), (0.1, 9.9), (0.5, 5)]), rng.integers(0, 9, (500, 2)).astype(float), np.array([(1.0, 1.0)] * 3)]
    data = [(f"c{k}", float(x), float(y)) for k, c in enumerate(clouds) for x, y in c]
    points = spark.createDataFrame(data, "camera_id string, x double, y double").repartition(5)
    got = {}
    for r in roi.hull_candidates(points).collect():
        got.setdefault(r.camera_id, []).append((r.x, r.y))
    for k, c in enumerate(clouds):
        want = {p for p in map(tuple, c.tolist()) if not _inside(p, c)}
        assert set(map(tuple, roi.convex_hull(np.array(got[f"c{k}"])).tolist())) == set(map(tuple, roi.convex_hull(c).tolist())) == want


def _inside(p, cloud):
    """Whether p is no vertex of the cloud's hull: the directions to all other points do not fit into an open half plane."""
    d = np.unique(cloud[(cloud != p).any(1)] - p, axis=0)
    if not len(d):
        return False
    angle = np.sort(np.arctan2(d[:, 1], d[:, 0]))
    gaps = np.diff(np.append(angle, angle[0] + 2 * np.pi))
    return gaps.max() <= np.pi + 1e-9


def test_places_count_their_points(spark):
    """Many detections on few pixels: neighbours are counted, not listed."""
    data = [("c", k, float(k % 5), float(k % 3)) for k in range(3000)] + [("c", 5000, 90.0, 90.0)]
    points = spark.createDataFrame(data, "camera_id string, event_id long, x double, y double")
    near = D.neighbourhoods(points, 1.0).collect()
    want = {(x, y): sum(1 for _, _, a, b in data if (a - x) ** 2 + (b - y) ** 2 <= 1) for x, y in {r[2:] for r in data}}
    assert {(r.x, r.y): r.neighbors for r in near} == want
    assert D.clustered(points, 1.0, 2).count() == 3000 and D.near_places(D.places(points), 1.0).count() < 100
