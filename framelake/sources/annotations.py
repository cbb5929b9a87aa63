"""Ground-truth text files as tables. Whole files are parsed one at a time, so a file is a task's unit of work."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbers(line: str) -> list[float]:
    try:
        return [float(x) for x in line.split()]
    except ValueError:
        return []


def parse_faces(text: str) -> Iterator[tuple]:
    """(image, box_idx, x1, y1, x2, y2, blur, expression, illumination, occlusion, pose, ignored) of a file of blocks: image,
    number of boxes, then a line `x y w h …` each. A block of no boxes still has one line, a box of size 0; attributes that
    are missing count as 0. A box of fewer than four numbers raises ValueError."""
    lines = [x.strip() for x in text.splitlines()]
    at = 0
    while at < len(lines):
        image = lines[at]
        at += 1
        if not image:
            continue
        if at >= len(lines) or not re.fullmatch(r"\d+", lines[at]):
            raise ValueError(f"{image}: a number of boxes is missing")
        n = int(lines[at])
        at += 1
        for k in range(max(n, 1)):
            v = _numbers(lines[at]) if at < len(lines) else []
            if n == 0 and len(v) < 4:
                break  # the next image follows at once
            if len(v) < 4:
                raise ValueError(f"{image}: box {k} has fewer than four numbers")
            at += 1
            v += [0.0] * (10 - len(v))
            x, y, w, h, blur, expr, illum, invalid, occ, pose = v[:10]
            yield image, k, x, y, x + w, y + h, blur, expr, illum, occ, pose, bool(invalid)


def parse_ellipses(text: str) -> Iterator[tuple]:
    """(image, face_idx, x1, y1, x2, y2) of a fold: image, number of faces, then `major minor angle cx cy …` each."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    at = 0
    while at + 1 < len(lines):
        image, n = lines[at], int(lines[at + 1])
        at += 2
        for k in range(n):
            v = _numbers(lines[at])
            if len(v) < 5:
                raise ValueError(f"{image}: face {k} has fewer than five numbers")
            at += 1
            ra, rb, theta, cx, cy = v[:5]
            w = math.hypot(ra * math.cos(theta), rb * math.sin(theta))
            h = math.hypot(ra * math.sin(theta), rb * math.cos(theta))
            yield image, k, cx - w, cy - h, cx + w, cy + h


def parse_labels(text: str, width: float, height: float) -> Iterator[tuple]:
    """(box_idx, cls, x1, y1, x2, y2) of lines `cls cx cy w h`. The first box of five numbers tells whether all are in shares
    of the frame (none over 1.5) or in pixels."""
    shares = None
    for k, line in enumerate(x for x in text.splitlines() if len(_numbers(x)) >= 5):
        cls, cx, cy, w, h = _numbers(line)[:5]
        if shares is None:
            shares = max(map(abs, (cx, cy, w, h))) <= 1.5
        if shares:
            cx, cy, w, h = cx * width, cy * height, w * width, h * height
        yield k, int(cls), cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def _read(spark: SparkSession, path: str, parse: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                rows = [(file, *r) for r in parse(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.mapInArrow(read, schema)


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    d = [(n, pa.float64()) for n in ("x1", "y1", "x2", "y2", "blur", "expression", "illumination", "occlusion", "pose")]
    arrow = pa.schema([("file", pa.string()), ("image", pa.string()), ("box_idx", pa.int32()), *d, ("ignored", pa.bool_())])
    return _read(spark, path, parse_faces, "file string, image string, box_idx int, " + ", ".join(f"{n} double" for n, _ in d) + ", ignored boolean", arrow)


def read_ellipses(spark: SparkSession, path: str) -> DataFrame:
    d = [(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")]
    return _read(spark, path, parse_ellipses, "file string, image string, face_idx int, x1 double, y1 double, x2 double, y2 double", pa.schema([("file", pa.string()), ("image", pa.string()), ("face_idx", pa.int32()), *d]))
