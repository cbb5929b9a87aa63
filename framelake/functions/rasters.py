"""Masks, blurs and detector outputs on numpy arrays, for use inside mapInPandas or mapInArrow over frames."""

from __future__ import annotations

import numpy as np


def box_means(image: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Whole-number means over a window cut at the edges, by running sums."""
    a = np.moveaxis(np.asarray(image, np.int64), axis, 0)
    sums = np.concatenate((np.zeros((1, *a.shape[1:]), np.int64), a.cumsum(0)))
    at = np.arange(len(a))
    low, high = np.maximum(at - radius, 0), np.minimum(at + radius + 1, len(a))
    n = (high - low).reshape(-1, *[1] * (a.ndim - 1))
    return np.moveaxis((sums[high] - sums[low]) // n, 0, axis)


def box_blur(image: np.ndarray, radius: int, passes: int = 2) -> np.ndarray:
    """Approximates a Gaussian: passes across, then down."""
    out = image
    for _ in range(passes):
        out = box_means(box_means(out, radius, 1), radius, 0)
    return out.astype(np.uint8)


def mosaic(image: np.ndarray, cell: int) -> np.ndarray:
    """Blocks anchored at the array's corner take their mean in whole numbers."""
    out = np.array(image, np.int64)
    for y in range(0, out.shape[0], cell):
        for x in range(0, out.shape[1], cell):
            block = out[y : y + cell, x : x + cell]
            block[:] = block.reshape(-1, *block.shape[2:]).sum(0) // (block.shape[0] * block.shape[1])
    return out.astype(np.uint8)


def ellipse_mask(height: int, width: int, box: tuple[float, float, float, float], margin: float = 0.0) -> np.ndarray:
    """Pixels whose centres lie in the ellipse of a box grown by a share of its sides."""
    x0, y0, x1, y1 = box
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    rx, ry = max((x1 - x0) / 2 * (1 + margin), 0.5), max((y1 - y0) / 2 * (1 + margin), 0.5)
    y, x = np.mgrid[:height, :width] + 0.5
    return ((x - cx) / rx) ** 2 + ((y - cy) / ry) ** 2 <= 1


def polygon_mask(height: int, width: int, ring: list[tuple[float, float]]) -> np.ndarray:
    """Pixels inside by the even-odd rule; fewer than three vertices hold nothing."""
    y, x = np.mgrid[:height, :width].astype(float)
    inside = np.zeros((height, width), bool)
    if len(ring) < 3:
        return inside
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Grows a mask by a square of the radius."""
    m = np.asarray(mask, np.int64)
    for axis in (0, 1):
        a = np.moveaxis(m, axis, 0)
        sums = np.concatenate((np.zeros((1, a.shape[1]), np.int64), a.cumsum(0)))
        at = np.arange(len(a))
        m = np.moveaxis((sums[np.minimum(at + radius + 1, len(a))] - sums[np.maximum(at - radius, 0)] > 0).astype(np.int64), 0, axis)
    return m.astype(bool)


def mask_bounds(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1) of the set pixels, ends exclusive."""
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else None


def blend(image: np.ndarray, blurred: np.ndarray, mask: np.ndarray, feather: int = 0) -> np.ndarray:
    """The blurred picture where the mask is, with an edge of ``feather`` pixels."""
    alpha = box_means(mask.astype(np.int64) * 255, feather, 0) if feather else mask.astype(np.int64) * 255
    alpha = (box_means(alpha, feather, 1) if feather else alpha)[..., None] / 255
    return np.rint(image * (1 - alpha) + blurred * alpha).astype(np.uint8)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(2)
    union = (a[:, 2:] - a[:, :2]).prod(1)[:, None] + (b[:, 2:] - b[:, :2]).prod(1)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def suppress(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of the boxes that greedy suppression keeps, by falling score."""
    kept: list[int] = []
    overlap = iou_matrix(boxes, boxes)
    for k in np.argsort(-scores, kind="stable"):
        if not kept or overlap[k, kept].max() <= threshold:
            kept.append(int(k))
    return np.array(kept, int)


def letterbox_params(width: int, height: int, size: int) -> tuple[float, float, float]:
    s = min(size / width, size / height)
    return s, (size - width * s) / 2, (size - height * s) / 2


def decode_anchors(output: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Boxes, scores and, with 20 channels or more, five keypoints from a detector output [channels, anchors] of rows
    cx, cy, w, h, then class scores (the best counts) or one score and keypoints (x, y, visibility)."""
    c = output.shape[0]
    faces = c >= 20
    scores = output[4] if faces else output[4:].max(0)
    at = scores >= threshold
    cx, cy, w, h = output[:4, at]
    boxes = np.stack([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], 1)
    points = output[5:20, at].T.reshape(-1, 5, 3)[:, :, :2] if faces else None
    return boxes, scores[at], points


def dfl_distances(logits: np.ndarray) -> np.ndarray:
    """Expected bin of 16 for each of four sides: [4 * 16, n] to [4, n]."""
    z = logits.reshape(4, 16, -1)
    e = np.exp(z - z.max(1, keepdims=True))
    return (e * np.arange(16)[None, :, None]).sum(1) / e.sum(1)


def decode_grid(output: np.ndarray, stride: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list]:
    """Boxes, scores and keypoints of one [80, H, W] level: 64 distance logits, one score logit, 15 keypoint values. Keypoints
    stay only if all five are visible (sigmoid over 0.5)."""
    c, height, width = output.shape
    flat = output.reshape(c, -1)
    scores = 1 / (1 + np.exp(-flat[64]))
    at = np.flatnonzero(scores >= threshold)
    left, top, right, bottom = dfl_distances(flat[:64, at])
    x, y = at % width + 0.5, at // width + 0.5
    boxes = np.stack([x - left, y - top, x + right, y + bottom], 1) * stride
    points = []
    for k, a in enumerate(at):
        p = flat[65:80, a].reshape(5, 3)
        visible = 1 / (1 + np.exp(-p[:, 2])) > 0.5
        points.append([((p[j, 0] * 2 + x[k] - 0.5) * stride, (p[j, 1] * 2 + y[k] - 0.5) * stride) for j in range(5)] if visible.all() else None)
    return boxes, scores[at], points


def mask_union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixels of either mask; a missing silhouette leaves the other."""
    return np.asarray(b, bool) if a is None else np.asarray(a, bool) | np.asarray(b, bool)
