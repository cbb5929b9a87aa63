"""Settings, writers, folders of files, clusters and scheduled regions."""

import datetime
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import names, rasters
from framelake.operators import detect, graph, jobs, settings
from framelake.operators import roi as R
from framelake.sources import folders, sinks


def test_settings():
    base = settings.Settings()
    got = settings.override(base, {"min_iou": "1.5", "learning_days": "12", "eps": "nan", "head_fallback": "off"})
    assert (got.min_iou, got.learning_days, got.eps, got.head_fallback) == (1.0, 12, base.eps, False)
    with pytest.raises(KeyError):
        settings.override(base, {"no_such": 1})
    with pytest.raises(ValueError):
        settings.override(base, {"eps": "wide"})
    assert settings.from_environment({"FRAMELAKE_MIN_IOU": "0.5", "FRAMELAKE_EPS": " ", "OTHER": "1"}).min_iou == 0.5


def test_writers(spark, tmp_path):
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    d = spark.createDataFrame([("c", float(k), day(k % 10)) for k in range(100)] + [("c", 1.0, None)], "camera_id string, x double, captured_at timestamp")
    at = str(tmp_path / "detections")
    sinks.append_detections(d, at)
    sinks.append_detections(d.limit(0), at)
    assert sinks.prune_detections(spark, at, F.lit("2024-01-04").cast("timestamp")) == (30, 71)
    assert sinks.prune_detections(spark, at, F.lit("2024-01-04").cast("timestamp")) == (0, 71)
    assert spark.read.parquet(at).count() == 71
    ledger = spark.createDataFrame([(f"in{k}", day(k)) for k in range(300)], "input string, finished_at timestamp")
    at = str(tmp_path / "ledger")
    assert not sinks.append_ledger(ledger.limit(10), at)
    assert sinks.append_ledger(ledger, at, keep=40, max_bytes=2000)
    assert spark.read.json(at).agg(F.count("*"), F.min("input")).first() == (40, "in260")
    for text in ("a", "b"):
        sinks.write_state(spark.createDataFrame([(text, 0.9)], "model string, accuracy double"), str(tmp_path / "state"))
        sinks.write_report(spark.createDataFrame([(2, text), (1, "head")], "line_no int, line string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "state")).first().model == "b"
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["head", "b"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["detections", "ledger", "report", "state"]


def _png(width, height):
    raw = b"".join(b"\0" + b"".join(bytes([x, y, 9]) for x in range(width)) for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_folders(spark, tmp_path):
    root = tmp_path / "out"
    (root / "CAM_001").mkdir(parents=True)
    (root / "CAM_001" / "a.txt").write_bytes(b"abc")
    (root / "big.bin").write_bytes(b"x" * 5000)
    got = {r.name: (r.declared_size, bytes(r.data) if r.data is not None else None, r.error) for r in folders.read_folder(spark, str(root), max_bytes=1000).collect()}
    assert got == {"CAM_001/a.txt": (3, b"abc", None), "big.bin": (5000, None, "limit: file too large")}
    images = tmp_path / "images"
    images.mkdir()
    for name, data in (("ok.png", _png(4, 3)), ("wide.png", _png(40, 2)), ("bad.png", b"no image")):
        (images / name).write_bytes(data)
    got = {r.name.rsplit("/")[-1]: r for r in folders.read_images(spark, str(images), max_side=20).collect()}
    assert (got["ok.png"].width, got["ok.png"].height, got["ok.png"].error, len(got["ok.png"].pixels)) == (4, 3, None, 36)
    assert (got["wide.png"].error, got["wide.png"].pixels, got["bad.png"].error) == ("limit: side", None, "undecodable")


def _dbscan(points, eps, least):
    """Sequential density clustering in order of index."""
    near = [[j for j, q in enumerate(points) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in points]
    label, n = {}, 0
    for i in range(len(points)):
        if i in label or len(near[i]) < least:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j in label:
                continue
            label[j] = n
            if len(near[j]) >= least:
                todo += near[j]
        n += 1
    return label


def test_cluster_ids(spark):
    rng = random.Random(5)
    cams = {f"c{k}": [(float(rng.randrange(60)), float(rng.randrange(60))) for _ in range(n)] for k, n in enumerate((90, 40, 3))}
    cams["chain"] = [(float(k), 0.0) for k in rng.sample(range(50), 50)]
    rows = [(c, k, x, y) for c, ps in cams.items() for k, (x, y) in enumerate(ps)]
    got = detect.cluster_ids(spark.createDataFrame(rows, "camera_id string, event_id long, x double, y double"), 5.0, 3).collect()
    assert {(r.camera_id, r.event_id): r.cluster for r in got} == {(c, k): v for c, ps in cams.items() for k, v in _dbscan(ps, 5.0, 3).items()}


def test_cluster_ids_of_dense_and_odd_points(spark):
    """Tiles that are full, rims beside them, and points without a place or a camera."""
    rng = random.Random(6)
    cams = {"dense": [(float(rng.randrange(25)), float(rng.randrange(25))) for _ in range(400)], "negative": [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(120)], "edge": [(0.0, 0.0)] * 5 + [(5.0, 0.0), (10.0, 0.0), (3.4, 3.4), (-5.0, 0.0), (-5.1, 0.0)]}
    rows = [(c, k, x, y) for c, ps in cams.items() for k, (x, y) in enumerate(ps)]
    odd = [("odd", k, x, y) for k, (x, y) in enumerate([(None, 1.0), (1.0, None), (float("nan"), 1.0)] * 5)] + [(None, k, 1.0, 1.0) for k in range(5)]
    got = detect.cluster_ids(spark.createDataFrame(rows + odd, "camera_id string, event_id long, x double, y double"), 5.0, 5).collect()
    assert len(got) == len({(r.camera_id, r.event_id) for r in got})
    assert {(r.camera_id, r.event_id): r.cluster for r in got} == {(c, k): v for c, ps in cams.items() for k, v in _dbscan(ps, 5.0, 5).items()}


def test_components_of_long_chains(spark):
    """The driver's estimate of the result does not grow with the steps, of which there are few."""
    order = random.Random(7).sample(range(200), 200)
    links = [("c", u, v) for a, b in zip(order, order[1:]) for u, v in ((a, b), (b, a))]
    nodes = spark.createDataFrame([("c", k) for k in [*range(200), 777]], "camera_id string, node long")
    got = graph.smallest_reachable(nodes, spark.createDataFrame(links, "camera_id string, u long, v long"), "camera_id")
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64
    assert {r.node: r.least for r in got.collect()} == {k: 0 for k in range(200)} | {777: 777}


def test_readopted_regions(spark):
    """Kept where the new region is alike, replaced where it is not, none yet or made for another frame."""
    grid = [(float(x), float(y)) for x in range(0, 1000, 50) for y in range(0, 800, 50)]
    now, old = datetime.datetime(2024, 3, 1), datetime.datetime(2024, 1, 1)
    rows = [(c, k, x, y, now) for c in "abcd" for k, (x, y) in enumerate(grid)] + [("e", k, x, y, old) for k, (x, y) in enumerate(grid)]
    d = spark.createDataFrame(rows, "camera_id string, event_id long, x double, y double, captured_at timestamp")
    ring = lambda x0, x1: [{"x": x0, "y": 0.0}, {"x": x1, "y": 0.0}, {"x": x1, "y": 750.0}, {"x": x0, "y": 750.0}]
    cams = [("a", "ACTIVE", 1000, 800, ring(0.0, 950.0), 1000, 800), ("b", "ACTIVE", 1000, 800, ring(0.0, 300.0), 1000, 800), ("c", "ACTIVE", 1000, 800, None, None, None), ("d", "ACTIVE", 1000, 800, ring(0.0, 950.0), 640, 480), ("e", "ACTIVE", 1000, 800, ring(0.0, 950.0), 1000, 800), ("f", "LEARNING", 1000, 800, None, None, None)]
    c = spark.createDataFrame(cams, "camera_id string, state string, frame_width int, frame_height int, ring array<struct<x:double,y:double>>, ring_width int, ring_height int")
    got = R.readopted(d, c, F.lit(now), 10, 0.7, 1000, 800, eps=80.0, min_samples=3, epsilon=5.0, margin=0.0, area_min=0.02, area_max=0.99).collect()
    assert {r.camera_id: r.decision for r in got} == {"a": "keep_stable", "b": "replace", "c": "replace", "d": "geometry_changed", "e": "keep_no_candidate"}


def test_first_errors_of_none(spark):
    got = jobs.first_errors(spark.createDataFrame([], "k long, error string"), ("k",)).first()
    assert (got.errors, got.header) == (0, "%5B%5D")


def test_mask_union():
    a, b = np.array([[1, 0], [0, 0]]), np.array([[0, 0], [0, 1]])
    assert rasters.mask_union(a, b).tolist() == [[True, False], [False, True]] and rasters.mask_union(None, b).tolist() == [[False, False], [False, True]]


def test_public_addresses(spark):
    want = {"8.8.8.8": True, "10.0.0.1": False, "100.64.0.1": False, "::1": False, "::": False, "fe80::1%eth0": False, "fd00::2": False, "ff02::1": False, "2001:db8::1": False, "2606:4700::1111": True, "::ffff:192.168.0.1": False, "::ffff:8.8.4.4": True, "256.1.1.1": None, "host": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in want], "ip string").select("ip", names.public_ip(F.col("ip")).alias("p")).collect()
    assert {r.ip: r.p for r in rows} == want
