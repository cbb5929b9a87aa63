import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.functions import names as N
from framelake.functions import rasters as R
from framelake.operators import roi


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_classify(spark):
    want = {
        "CAM_001/foto.jpg": ("Image", "CAM_001", "jpg"),
        "./CAM_001/foto.JPEG": ("Image", "CAM_001", "jpg"),
        "/a/b/CAM-7/x.PNG": ("Image", "CAM-7", "png"),
        "CAM_001_foto.jpg": ("Image", "CAM_001", "jpg"),
        "CAM_001.jpg": ("Other", None, None),
        "../CAM_001/x.jpg": ("Other", None, None),
        "CAM_001/": ("Directory", None, None),
        "": ("Directory", None, None),
        "CAM_001/.jpg": ("Other", None, None),
        "CAM_001/x.txt": ("Other", None, None),
        "C\\x.png": ("Other", None, None),
        "CC\\x.png": ("Image", "CC", "png"),
    }
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", N.classify_entry(F.col("p")).alias("c"))
    got = {r.p: (r.c.kind, r.c.camera_id, r.c.format) for r in df.collect()}
    assert got == want


def test_messages(spark):
    r = one(
        spark,
        N.redact_paths(F.lit("open '/data/x.zip': no, C:\\a\\b and \\\\srv\\s but CAM_1/a.jpg, https://h/p.")),
        N.redact_url(F.lit("amqp://user:p@ss@host:5672/v")),
        N.redact_url(F.lit("amqp://host/v?x=a@b")),
        N.percent_encode(F.lit("a b*~+é")),
        N.sanitize_serial(F.lit("EOS 5D #42!")),
        N.sanitize_serial(F.lit("_-_-")),
    )
    assert tuple(r) == ("open '<path>': no, <path> and <path> but CAM_1/a.jpg, https://h/p.", "amqp://***@host:5672/v", "amqp://host/v?x=a@b", "a%20b%2A~%2B%C3%A9", "EOS_5D__42", None)


def test_boxes(spark):
    lb = G.letterbox(F.lit(1920), F.lit(1080), 640)
    d = G.downscaled(F.lit(48), F.lit(32), 16)
    e = G.ellipse_bbox(F.lit(30.0), F.lit(20.0), F.lit(0.0), F.lit(100.0), F.lit(100.0))
    r = one(spark, *[G.blur_sigma(F.lit(w)) for w in (80.0, 8.0, 1000.0)], *[G.backoff_ms(F.lit(n)) for n in (0, 1, 2, 30)], lb["pad_y"], d["w"], d["h"], *e.values())
    assert tuple(r) == (20.0, 5.0, 50.0, 5000, 10000, 20000, 300000, 140.0, 16, 10, 70.0, 80.0, 130.0, 120.0)


def test_polygons(spark):
    square = G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1920.0), F.lit(1080.0))
    half = G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(960.0), F.lit(1080.0))
    inside = lambda x, y: G.point_in_polygon(square, F.lit(x), F.lit(y))
    r = one(spark, roi.polygon_iou(square, half, 1920, 1080), G.polygon_area(half), inside(0.0, 0.0), inside(1920.0, 5.0), inside(5.0, 1080.0), G.point_in_polygon(F.slice(square, 1, 2), F.lit(1.0), F.lit(0.0)))
    assert 0.45 <= r[0] <= 0.55 and tuple(r)[1:] == (960.0 * 1080, True, False, False, False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_hull_holds_all_points(points):
    ring = roi.convex_hull(np.array(points, float).reshape(-1, 2))
    if len(ring) < 3:
        return
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in points)


def test_simplify():
    ring = np.array([(0, 0), (5, 0.2), (10, 0), (10, 10), (5, 9.9), (0, 10)], float)
    assert roi.simplify_ring(ring, 1.0).tolist() == [[0, 0], [10, 0], [10, 10], [0, 10]]
    assert len(roi.simplify_ring(ring, 0.0)) == 6


def naive_means(a, r, axis):
    out = np.zeros_like(a)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            w = a[max(0, y - r) : y + r + 1, x] if axis == 0 else a[y, max(0, x - r) : x + r + 1]
            out[y, x] = w.sum() // len(w)
    return out


def test_rasters():
    a = np.random.default_rng(1).integers(0, 256, (17, 23))
    for axis in (0, 1):
        assert (R.box_means(a, 4, axis) == naive_means(a, 4, axis)).all()
    assert R.mosaic(a, 5)[0, 0] == a[:5, :5].sum() // 25
    m = R.ellipse_mask(40, 40, (10, 10, 30, 20))
    assert R.mask_bounds(m) == (10, 10, 30, 20) and R.dilate(m, 2).sum() > m.sum()
    assert R.polygon_mask(10, 10, [(2, 2), (8, 2), (8, 8), (2, 8)]).sum() == 36
    rgb = np.repeat(a[..., None], 3, 2).astype(np.uint8)
    out = R.blend(rgb, R.box_blur(rgb, 3), np.zeros((17, 23), bool), 2)
    assert (out == rgb).all()


def test_detector_outputs():
    boxes = np.array([(0, 0, 10, 10), (1, 1, 11, 11), (20, 20, 30, 30)], float)
    assert R.suppress(boxes, np.array([0.9, 0.8, 0.7]), 0.45).tolist() == [0, 2]
    assert math.isclose(float(R.dfl_distances(np.zeros((64, 1)))[0, 0]), 7.5)
    out = np.zeros((20, 1))
    out[:5, 0] = (50, 50, 20, 10, 0.9)
    b, s, p = R.decode_anchors(out, 0.5)
    assert b.tolist() == [[40, 45, 60, 55]] and s.tolist() == [0.9] and p.shape == (1, 5, 2)
    grid = np.zeros((80, 1, 1))
    grid[64] = 5
    b, s, p = R.decode_grid(grid, 8, 0.5)
    assert b.round(6).tolist() == [[-56.0, -56.0, 64.0, 64.0]] and p == [None]
    grid[[67, 70, 73, 76, 79]] = 3
    assert R.decode_grid(grid, 8, 0.5)[2][0][0] == (0.0, 0.0)
