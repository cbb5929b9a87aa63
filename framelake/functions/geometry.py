"""Column functions over boxes, rings and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iou(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Intersection over union of two boxes; 0 if they do not meet. Computed in double precision."""
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(_c, (ax0, ay0, ax1, ay1, bx0, by0, bx1, by1))
    zero = F.lit(0.0)
    inter = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), zero) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), zero)
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter
    return F.when(inter > 0, inter / union).otherwise(zero)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def expand_box(x0, y0, x1, y1, margin: Column, width, height) -> dict[str, Column]:
    """A box grown by a margin on all sides and clamped to the frame."""
    w, h = F.lit(float(width)), F.lit(float(height))
    return {"x0": clamp(_c(x0) - margin, 0.0, w), "y0": clamp(_c(y0) - margin, 0.0, h), "x1": clamp(_c(x1) + margin, 0.0, w), "y1": clamp(_c(y1) + margin, 0.0, h)}


def learning_margin(x0, y0, x1, y1, share: float = 0.15) -> Column:
    """A share of the longer side."""
    return F.greatest(_c(x1) - _c(x0), _c(y1) - _c(y0)) * F.lit(share)


def letterbox(width, height, size: int) -> dict[str, Column]:
    """Scale and padding that fit a frame into a square."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    return {"scale": scale, "pad_x": (F.lit(float(size)) - w * scale) / 2, "pad_y": (F.lit(float(size)) - h * scale) / 2}


def blur_sigma(width: Column) -> Column:
    """A quarter of the box's width, 5 to 50."""
    return clamp(width / 4, 5.0, 50.0)


def ellipse_bbox(ra, rb, theta, cx, cy) -> dict[str, Column]:
    """The box around a rotated ellipse."""
    ra, rb, theta, cx, cy = map(_c, (ra, rb, theta, cx, cy))
    half_w = F.sqrt((ra * F.cos(theta)) * (ra * F.cos(theta)) + (rb * F.sin(theta)) * (rb * F.sin(theta)))
    half_h = F.sqrt((ra * F.sin(theta)) * (ra * F.sin(theta)) + (rb * F.cos(theta)) * (rb * F.cos(theta)))
    return {"x1": cx - half_w, "y1": cy - half_h, "x2": cx + half_w, "y2": cy + half_h}


def _rotated(ring: Column) -> Column:
    """Each vertex's predecessor, in the ring's order."""
    n = F.size(ring)
    return F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))


def polygon_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x,y>>."""
    terms = F.zip_with(ring, _rotated(ring), lambda a, b: b["x"] * a["y"] - a["x"] * b["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda t, v: t + v)) / 2


def scale_ring(ring: Column, factor: float) -> Column:
    """A ring scaled about the mean of its vertices."""
    n = F.size(ring).cast("double")
    cx = F.aggregate(F.transform(ring, lambda p: p["x"]), F.lit(0.0), lambda t, v: t + v) / n
    cy = F.aggregate(F.transform(ring, lambda p: p["y"]), F.lit(0.0), lambda t, v: t + v) / n
    return F.transform(ring, lambda p: F.struct((cx + (p["x"] - cx) * factor).alias("x"), (cy + (p["y"] - cy) * factor).alias("y")))


def point_in_polygon(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: left and top edges are inside, right and bottom ones outside; fewer than 3 vertices hold nothing."""

    def crosses(a: Column, b: Column) -> Column:
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    hits = F.size(F.filter(F.zip_with(ring, _rotated(ring), crosses), lambda v: v))
    return (F.size(ring) >= 3) & (hits % 2 == 1)


def rectangle(x0, y0, x1, y1) -> Column:
    """A ring of four vertices."""
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def crop_clamp(x0, y0, x1, y1, width: int, height: int, least: int = 8) -> dict[str, Column]:
    """The whole-pixel crop of a box: at least 8 pixels a side, inside the frame."""
    x = clamp(F.floor(_c(x0)), 0, width - least).cast("long")
    y = clamp(F.floor(_c(y0)), 0, height - least).cast("long")
    w = clamp(F.ceil(_c(x1) - _c(x0)), least, F.lit(width) - x).cast("long")
    h = clamp(F.ceil(_c(y1) - _c(y0)), least, F.lit(height) - y).cast("long")
    return {"x": x, "y": y, "w": w, "h": h}


def downscaled(width: Column, height: Column, longest: int) -> dict[str, Column]:
    """Frame sizes with the longer side at most ``longest``: floors, at least 1."""
    long_side = F.greatest(width, height)
    fit = lambda s: F.when(long_side <= longest, s).otherwise(F.greatest(F.floor(s * longest / long_side), F.lit(1))).cast("long")
    return {"w": fit(width), "h": fit(height)}


def backoff_ms(attempts: Column, base: int = 5000, cap: int = 300_000) -> Column:
    """base * 2^attempts (at most 20 doublings), at most the cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempts, F.lit(20))), F.lit(cap)).cast("long")


def segmenter_applies(width: Column, least: Column) -> Column:
    """Whether a box is wide enough for a segmenter; all are if the limit is not positive."""
    return (least <= 0) | (width >= least)
