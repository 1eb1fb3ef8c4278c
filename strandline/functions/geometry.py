"""Plane geometry and box arithmetic as Column functions; everything stays in the JVM.

Points are (x, y) pairs of Columns. Integer steps truncate towards zero, as `cast('int')` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]

def orientation(p: Point, q: Point, r: Point) -> Column:
    """Sign of the turn p, q, r: 0 where the three are on a line."""
    (px, py), (qx, qy), (rx, ry) = ((a.cast("double"), b.cast("double")) for a, b in (p, q, r))
    return F.signum((qy - py) * (rx - qx) - (qx - px) * (ry - qy))


def within(p: Point, q: Point, r: Point) -> Column:
    """q lies in the box that p and r span."""
    return q[0].between(F.least(p[0], r[0]), F.greatest(p[0], r[0])) & q[1].between(F.least(p[1], r[1]), F.greatest(p[1], r[1]))


def segments_meet(p1: Point, q1: Point, p2: Point, q2: Point) -> Column:
    """The closed segments p1q1 and p2q2 have a point in common."""
    o1, o2, o3, o4 = orientation(p1, q1, p2), orientation(p1, q1, q2), orientation(p2, q2, p1), orientation(p2, q2, q1)
    crossing = (o1 != o2) & (o3 != o4)
    return crossing | ((o1 == 0) & within(p1, p2, q1)) | ((o2 == 0) & within(p1, q2, q1)) | ((o3 == 0) & within(p2, p1, q2)) | ((o4 == 0) & within(p2, q1, q2))


def _side(edge: tuple[int, int, int, int], x: Column, y: Column) -> Column:
    """Positive, zero or negative by the side of the edge's line on which a point lies; linear in x and y."""
    ax, ay, bx, by = edge
    return x.cast("double") * float(ay - by) + y.cast("double") * float(bx - ax) + float(ax * by - bx * ay)


def edge_meets_box(edge: tuple[int, int, int, int], x: Column, y: Column, w: Column, h: Column) -> Column:
    """The closed edge and the closed box have a point in common: their extents overlap and the edge's line parts the corners."""
    ax, ay, bx, by = edge
    near = (x <= max(ax, bx)) & (x + w >= min(ax, bx)) & (y <= max(ay, by)) & (y + h >= min(ay, by))
    sides = [_side(edge, px, py) for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def point_in_outline(x: Column, y: Column, area: list[tuple[int, int]]) -> Column:
    """Inside by the number of edges that a ray to the right meets, ends of edges included.

    A ray along a horizontal edge ahead counts as outside, and one through a vertex counts both its edges, as the
    original test has it.
    """
    met, level = F.lit(0), F.lit(False)
    for edge in zip(area, area[1:] + area[:1]):
        (ax, ay), (bx, by) = edge
        if ay == by:
            level = level | ((y == ay) & (x <= max(ax, bx)))
        else:
            up = 1.0 if by > ay else -1.0
            met = met + (y.between(min(ay, by), max(ay, by)) & (_side((ax, ay, bx, by), x, y) * up >= 0)).cast("int")
    return ~level & (met % 2 == 1)


def box_in_area(x: Column, y: Column, w: Column, h: Column, area: list[tuple[int, int]]) -> Column:
    """The area rule of one polygon, as plain comparisons with its constants (generated code, and bounds that reach the scan).

    No points: true. One or two points (a tripwire): an end lies in the box or the line meets one of its sides. Three or
    more: all corners inside and no side of the box meets the outline.
    """
    if not area:
        return F.lit(True)
    around = [(*a, *b) for a, b in zip(area, area[1:] + area[:1])]
    if len(area) < 3:
        hit = F.lit(False)
        for edge in around[:1]:
            hit = hit | edge_meets_box(edge, x, y, w, h)
        return hit
    xs, ys = [p[0] for p in area], [p[1] for p in area]
    inside = (x > min(xs)) & (y > min(ys)) & (x + w < max(xs)) & (y + h < max(ys))
    for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h)):
        inside = inside & point_in_outline(px, py, area)
    for edge in around:
        inside = inside & ~edge_meets_box(edge, x, y, w, h)
    return inside


def iou(a: tuple[Column, ...], b: tuple[Column, ...], plus: int = 0) -> Column:
    """Intersection over union of (x, y, w, h) boxes; `plus` is 1 under the convention that counts both border pixels."""
    ax, ay, aw, ah = (c.cast("double") for c in a)
    bx, by, bw, bh = (c.cast("double") for c in b)
    iw = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx) + plus)
    ih = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by) + plus)
    inter = iw * ih
    union = (aw + plus) * (ah + plus) + (bw + plus) * (bh + plus) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def clip_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """x1, y1, x2, y2 held inside the frame."""
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    return [hold(x, width), hold(y, height), hold(x + w, width), hold(y + h, height)]


def letterbox(src_w: Column, src_h: Column, net_w: int, net_h: int) -> tuple[Column, Column, Column]:
    """ratio, tx, ty with which a frame is fitted into a net input."""
    ratio = F.least(F.lit(float(net_w)) / src_w, F.lit(float(net_h)) / src_h)
    off = lambda net, src: ((F.lit(net) - (src * ratio).cast("int")) / 2).cast("int")
    return ratio, off(net_w, src_w), off(net_h, src_h)


def safe_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, least: int = 16) -> list[Column]:
    """start_x, start_y, crop_w, crop_h of a crop that fits the frame; nulls where the frame is smaller than `least`."""
    def one(lo, hi, size):
        start = F.greatest(F.least(lo, size), F.lit(0))
        length = F.greatest(F.least(hi - lo, size), F.lit(least))
        over = start + length > size
        shrink = size - start >= least
        return F.when(over & ~shrink, size - length).otherwise(start), F.when(over & shrink, size - start).otherwise(length)

    fits = (width >= least) & (height >= least)
    sx, cw = one(x1, x2, width)
    sy, ch = one(y1, y2, height)
    return [F.when(fits, c) for c in (sx, sy, cw, ch)]


def dilate_for_pose(x: Column, y: Column, w: Column, h: Column, net_w: int, net_h: int) -> list[Column]:
    """x, y, w, h of the box widened to the net's aspect and by 1.25 around its (integer) centre."""
    ratio = net_w / net_h
    cx, cy = x + F.floor(w / 2).cast("int"), y + F.floor(h / 2).cast("int")
    sy = F.when(w > h * ratio, (w / F.lit(ratio)).cast("int")).otherwise(h)
    sx = F.when(w < h * ratio, (h * F.lit(ratio)).cast("int")).otherwise(w)
    grow = lambda v: F.when(cx != -1, (v * 1.25).cast("int")).otherwise(v)
    sx, sy = grow(sx), grow(sy)
    return [cx - F.floor(sx / 2).cast("int"), cy - F.floor(sy / 2).cast("int"), sx, sy]


def square_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: int = 20) -> list[Column]:
    """left, top, right, bottom of a square around the box's integer centre with a margin, held inside the frame."""
    cx, cy = F.floor((x + x + w) / 2).cast("int"), F.floor((y + y + h) / 2).cast("int")
    half = F.greatest(cx - x, x + w - cx, cy - y, y + h - cy) + margin
    return [F.greatest(cx - half, F.lit(0)), F.greatest(cy - half, F.lit(0)), F.least(cx + half, width), F.least(cy + half, height)]


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, r: Column) -> list[Column]:
    """The eight rounded coordinates of a rotated box."""
    c, s = F.cos(r), F.sin(r)
    v1x, v1y, v2x, v2y = w / 2 * c, w / 2 * s, -h / 2 * s, h / 2 * c
    return [F.round(v) for v in (cx + v1x + v2x, cy + v1y + v2y, cx + v1x - v2x, cy + v1y - v2y, cx - v1x - v2x, cy - v1y - v2y, cx - v1x + v2x, cy - v1y + v2y)]


def regular_angle(w: Column, h: Column, r: Column) -> list[Column]:
    """w, h, r with the longer side first and the angle in [0, pi)."""
    pi = 3.141592653589793
    swap = h > w
    return [F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h), F.pmod(F.when(swap, r + pi / 2).otherwise(r), F.lit(pi))]


def shoelace(points: Column) -> Column:
    """Area of a closed outline given as array<struct<x,y>>."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, turned, lambda a, b: (a["x"] * b["y"] - a["y"] * b["x"]).cast("double")), F.lit(0.0), lambda s, v: s + v)) / 2


def perimeter(points: Column) -> Column:
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    step = lambda a, b: F.sqrt(F.pow((a["x"] - b["x"]).cast("double"), 2) + F.pow((a["y"] - b["y"]).cast("double"), 2))
    return F.aggregate(F.zip_with(points, turned, step), F.lit(0.0), lambda s, v: s + v)
