"""Text boxes from a text-probability map: components, least-area rectangles, score, growth, order."""

from __future__ import annotations

import numpy as np

#: Fixed values of the detector's post-processing.
BIN, BOX, UNCLIP, MIN_SIDE, MAX_CANDIDATES = 0.3, 0.6, 1.5, 3, 1000


def components(mask: np.ndarray) -> list[np.ndarray]:
    """(n, 2) x, y points of each 8-connected component, by run-length union of rows."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs, before = [], []
    for y, row in enumerate(mask.astype(np.int8)):
        d = np.diff(np.concatenate([[0], row, [0]]))
        now = []
        for a, b in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()):
            i = len(parent)
            parent.append(i)
            for p, q, j in before:
                if p <= b and a <= q:  # touching corners count
                    parent[root(j)] = root(i)
            now.append((a, b, i))
            runs.append((y, a, b, i))
        before = now
    groups: dict[int, list] = {}
    for y, a, b, i in runs:
        xs = np.arange(a, b)
        groups.setdefault(root(i), []).append(np.stack([xs, np.full(len(xs), y)], 1))
    return [np.concatenate(g) for g in groups.values()]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, np.float64)

    def chain(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]), np.float64)


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Corners, width and height of the rectangle of least area around the points."""
    h = hull(points)
    if len(h) == 1:
        return np.repeat(h, 4, 0), 0.0, 0.0
    e = np.roll(h, -1, 0) - h
    best = None
    for a in np.unique(np.mod(np.arctan2(e[:, 1], e[:, 0]), np.pi / 2)):
        u = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        q = h @ u.T
        lo, hi = q.min(0), q.max(0)
        area = (hi - lo).prod()
        if best is None or area < best[0] - 1e-9:
            best = (area, np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]) @ u, *(hi - lo))
    return best[1], float(best[2]), float(best[3])


def mini_box(corners: np.ndarray) -> np.ndarray:
    """The corners from the upper left clockwise: by x, then by y within the left and the right pair."""
    p = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = p[:2][np.argsort(p[:2, 1], kind="stable")], p[2:][np.argsort(p[2:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]])


def box_score(prob: np.ndarray, corners: np.ndarray) -> float:
    """Mean probability of the pixels inside the outline."""
    h, w = prob.shape
    x0, y0 = np.clip(np.floor(corners.min(0)).astype(int), 0, (w - 1, h - 1))
    x1, y1 = np.clip(np.ceil(corners.max(0)).astype(int), 0, (w - 1, h - 1))
    gy, gx = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    inside = np.ones(gx.shape, bool)
    u, v = corners[1] - corners[0], corners[2] - corners[1]
    c = corners if u[0] * v[1] - u[1] * v[0] >= 0 else corners[::-1]
    for a, b in zip(c, np.roll(c, -1, 0)):
        inside &= (b[0] - a[0]) * (gy - a[1]) - (b[1] - a[1]) * (gx - a[0]) >= -1e-6
    return float(prob[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def grow(corners: np.ndarray, ratio: float = UNCLIP) -> tuple[np.ndarray, float, float]:
    """The rectangle moved out on all sides by area * ratio / perimeter."""
    side = np.sqrt(((np.roll(corners, -1, 0) - corners) ** 2).sum(1))
    w, h = side[0], side[1]
    if w * h == 0:
        return corners, w, h
    d = w * h * ratio / (2 * (w + h))
    mid, ux, uy = corners.mean(0), (corners[1] - corners[0]) / w, (corners[2] - corners[1]) / h
    a, b = (w / 2 + d) * ux, (h / 2 + d) * uy
    return np.array([mid - a - b, mid + a - b, mid + a + b, mid - a + b]), w + 2 * d, h + 2 * d


def text_boxes(prob: np.ndarray, frame: tuple[int, int]) -> np.ndarray:
    """(n, 4, 2) integer corners in frame pixels, upper left first and clockwise."""
    out = []
    h, w = prob.shape
    for points in components(prob > BIN)[:MAX_CANDIDATES]:
        corners, a, b = least_rectangle(points)
        if min(a, b) < MIN_SIDE:
            continue
        corners = mini_box(corners)
        if box_score(prob, corners) < BOX:
            continue
        grown, a, b = grow(corners)
        if min(a, b) < MIN_SIDE + 2:
            continue
        q = np.floor(mini_box(grown) / (w, h) * frame + 0.5)
        q = mini_box(np.clip(np.clip(q, 0, frame), 0, np.array(frame) - 1))
        side = lambda i, j: int(np.sqrt(((q[i] - q[j]) ** 2).sum()))
        if side(0, 1) > 3 and side(0, 3) > 3:
            out.append(q.astype(np.int64))
    return np.array(out, np.int64).reshape(-1, 4, 2)
