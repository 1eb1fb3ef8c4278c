"""Detector outputs to boxes: one numeric kernel for each model family, all over whole tensors.

A decoder returns boxes (x, y, w, h) in frame pixels with score and class, before suppression where it says so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Anchors (width, height) of each stride.
ANCHORS_V5 = [[(10, 13), (16, 30), (33, 23)], [(30, 61), (62, 45), (59, 119)], [(116, 90), (156, 198), (373, 326)]]
ANCHORS_V7 = [[(12, 16), (19, 36), (40, 28)], [(36, 75), (76, 55), (72, 146)], [(142, 110), (192, 243), (459, 401)]]
FACE_ANCHORS = {8: (16, 32), 16: (64, 128), 32: (256, 512)}
FACE_VARIANCE = (0.1, 0.2)
FACE_NET = 640
YOLOX_STRIDES = (8, 16, 32)
YOLOX_LEAST_AREA = 100
MAX_DET = 300
CLASS_OFFSET = 7680


@dataclass
class Boxes:
    """Parallel arrays; tlwh of shape (n, 4). extra: further values of each box, such as keypoints or mask coefficients."""

    tlwh: np.ndarray
    score: np.ndarray
    klass: np.ndarray
    extra: dict = field(default_factory=dict)

    def take(self, rows) -> "Boxes":
        return Boxes(self.tlwh[rows], self.score[rows], self.klass[rows], {k: v[rows] for k, v in self.extra.items() if isinstance(v, np.ndarray)})


def sigmoid(x):
    return 1 / (1 + np.exp(-np.asarray(x, np.float64)))


def letterbox(src_w: int, src_h: int, net_w: int, net_h: int) -> tuple[float, int, int]:
    ratio = min(net_w / src_w, net_h / src_h)
    return ratio, int((net_w - int(src_w * ratio)) / 2), int((net_h - int(src_h * ratio)) / 2)


def nms(b: Boxes, threshold: float, shift: np.ndarray | None = None, plus: int = 0, inclusive: bool = False) -> Boxes:
    """Greedy suppression in order of score (ties: earlier first); `shift` moves boxes apart by class."""
    t = b.tlwh.astype(np.float64).copy()
    if shift is not None:
        t[:, :2] += shift[:, None]
    order = np.argsort(-b.score, kind="stable")
    kept = []
    while len(order):
        i, rest = order[0], order[1:]
        kept.append(i)
        lo, hi = np.maximum(t[i, :2], t[rest, :2]), np.minimum(t[i, :2] + t[i, 2:], t[rest, :2] + t[rest, 2:])
        inter = np.clip(hi - lo + plus, 0, None).prod(1)
        union = (t[i, 2:] + plus).prod() + (t[rest, 2:] + plus).prod(1) - inter
        v = np.where(union > 0, inter / np.where(union > 0, union, 1), 0)
        order = rest[~((v >= threshold) if inclusive else (v > threshold))]
    return b.take(np.array(kept, np.int64))


def _threshold(klass: np.ndarray, thr) -> np.ndarray:
    """A threshold for each box: one number, or one for each class (classes without one never pass)."""
    if not isinstance(thr, dict):
        return np.full(len(klass), float(thr))
    return np.array([thr.get(int(k), np.inf) for k in klass], np.float64)


def least(thr) -> float:
    return float(min(thr.values()) if isinstance(thr, dict) else thr)


def _grid(rows: np.ndarray, net: tuple[int, int], anchors) -> np.ndarray:
    """Raw (anchors, gh, gw, 5 + classes) to (n, 4 + 1 + classes): centre, size in net pixels, logits behind."""
    na, gh, gw, _ = rows.shape
    gy, gx = np.meshgrid(np.arange(gh), np.arange(gw), indexing="ij")
    s = sigmoid(rows[..., :4])
    cx, cy = (2 * s[..., 0] - 0.5 + gx) / gw * net[0], (2 * s[..., 1] - 0.5 + gy) / gh * net[1]
    a = np.array(anchors, np.float64).reshape(na, 1, 1, 2)
    wh = (2 * s[..., 2:4]) ** 2 * a
    return np.concatenate([np.stack([cx, cy], -1), wh, rows[..., 4:]], -1).reshape(na * gh * gw, -1)


def decode_v5(outputs: list[np.ndarray], src: tuple[int, int], net: tuple[int, int], conf, iou: float, size_gate: tuple[float, float] | None = None, roi: tuple[int, int] = (0, 0)) -> Boxes:
    """Three grids of logits, or one matrix of decoded rows. Class-aware suppression in net space."""
    low = least(conf)
    if len(outputs) > 1:
        rows = np.concatenate([_grid(o, net, a) for o, a in zip(outputs, ANCHORS_V5)])
        obj, k = sigmoid(rows[:, 4]), rows[:, 5:].argmax(1)
        score = obj * sigmoid(rows[np.arange(len(rows)), 5 + k])
        keep = score > low
        rows, k, score = rows[keep], k[keep], score[keep]
        xy = np.maximum(rows[:, :2] - rows[:, 2:4] / 2, 0)
    else:
        rows = outputs[0][outputs[0][:, 4] > low].astype(np.float64)
        k = rows[:, 5:].argmax(1) if len(rows) else np.zeros(0, np.int64)
        score = rows[:, 4] * rows[np.arange(len(rows)), 5 + k]
        keep = score > low
        rows, k, score = rows[keep], k[keep], score[keep]
        xy = np.maximum(np.trunc(rows[:, :2] - rows[:, 2:4] / 2), 0)
    b = Boxes(np.concatenate([xy, rows[:, 2:4]], 1), score, k)
    b = nms(b, iou, b.klass * CLASS_OFFSET)
    b = b.take(b.score > _threshold(b.klass, conf))
    ratio, tx, ty = letterbox(*src, *net)
    xy = np.maximum(((b.tlwh[:, :2] - (tx, ty)) / ratio), 0)
    end = np.minimum((b.tlwh[:, :2] + b.tlwh[:, 2:] - (tx, ty)) / ratio, np.array(src))
    b.tlwh = np.trunc(np.concatenate([xy, end - xy], 1))
    b.tlwh[:, :2] += roi
    if size_gate:
        b = b.take(((b.tlwh[:, 2:] > size_gate[0]) & (b.tlwh[:, 2:] < size_gate[1])).all(1))
    return b


def decode_v7(outputs: list[np.ndarray], src: tuple[int, int], net: tuple[int, int], conf, iou: float) -> Boxes:
    """As v5 with its own anchors; boxes go to frame space first and classes suppress each other there."""
    low = least(conf)
    if len(outputs) > 1:
        rows = np.concatenate([_grid(o, net, a) for o, a in zip(outputs, ANCHORS_V7)])
        rows[:, 4:] = sigmoid(rows[:, 4:])
        rows = rows[rows[:, 4] >= low]
        at_least = True
    else:
        rows, at_least = outputs[0].astype(np.float64), False
    k = rows[:, 5:].argmax(1) if len(rows) else np.zeros(0, np.int64)
    score = rows[:, 4] * rows[np.arange(len(rows)), 5 + k]
    thr = _threshold(k, conf)
    keep = score >= thr if at_least else score > thr
    rows, k, score = rows[keep], k[keep], score[keep]
    ratio, tx, ty = letterbox(*src, *net)
    w, h = (rows[:, 2] + 0.5) / ratio, (rows[:, 3] + 0.5) / ratio
    cx, cy = (rows[:, 0] + 1 - tx) / ratio - 1, (rows[:, 1] + 1 - ty) / ratio - 1
    x, y = np.maximum(np.trunc(cx - w / 2), 0), np.maximum(np.trunc(cy - h / 2), 0)
    w, h = np.minimum(w, src[0] - 1 - x), np.minimum(h, src[1] - 1 - y)
    return nms(Boxes(np.stack([x, y, np.trunc(w), np.trunc(h)], 1), score, k), iou)


def decode_v8(output: np.ndarray, src: tuple[int, int], net: tuple[int, int], conf, iou: float, clip_in_net: bool = False, n_extra: int = 0) -> Boxes:
    """(4 + classes + extra, n) rows of centre boxes and class scores; class-aware. At most MAX_DET boxes, the best.

    clip_in_net: the row-major kernel's order, which clips before it undoes the letterbox.
    """
    rows = output.T.astype(np.float64)
    classes = rows[:, 4 : rows.shape[1] - n_extra]
    k = classes.argmax(1) if len(rows) else np.zeros(0, np.int64)
    score = classes[np.arange(len(rows)), k]
    keep = score >= _threshold(k, conf)
    rows, k, score = rows[keep], k[keep], score[keep]
    lo, hi = rows[:, :2] - rows[:, 2:4] / 2, rows[:, :2] + rows[:, 2:4] / 2
    ratio, tx, ty = letterbox(*src, *net)
    if clip_in_net:
        lo, hi = np.clip(lo, 0, net), np.clip(hi, 0, net)
    lo, hi = (lo - (tx, ty)) / ratio, (hi - (tx, ty)) / ratio
    if not clip_in_net:
        lo, hi = np.clip(lo, 0, src), np.clip(hi, 0, src)
    lo, hi = np.maximum(lo, 0), np.minimum(hi, np.array(src) - 1)
    b = Boxes(np.concatenate([lo, hi - lo], 1), score, k, {"tail": rows[:, rows.shape[1] - n_extra :]} if n_extra else {})
    b = nms(b, iou, b.klass * CLASS_OFFSET)
    b = b.take(np.arange(min(MAX_DET, len(b.score))))
    return Boxes(np.trunc(b.tlwh), b.score, b.klass, b.extra)


def decode_v8_pose(output: np.ndarray, src, net, conf: float, iou: float) -> Boxes:
    """One class and 17 keypoints (x, y, score) in frame pixels."""
    b = decode_v8(output, src, net, conf, iou, n_extra=51)
    ratio, tx, ty = letterbox(*src, *net)
    points = b.extra["tail"].reshape(-1, 17, 3).copy()
    points[..., 0], points[..., 1] = (points[..., 0] - tx) / ratio, (points[..., 1] - ty) / ratio
    b.extra["keypoints"] = points
    return b


def decode_v8_seg(output: np.ndarray, proto: np.ndarray, src, net, conf: float, iou: float, mask_threshold: float | None = None) -> Boxes:
    """Boxes with binary masks of their own size. The mask threshold defaults to `iou`, as the CPU path has it."""
    b = decode_v8(output, src, net, conf, iou, n_extra=32)
    b = b.take((b.tlwh[:, 2:] > 1).all(1))
    c, mh, mw = proto.shape
    maps = sigmoid(b.extra["tail"] @ proto.reshape(c, -1)).reshape(-1, mh, mw)
    ratio, tx, ty = letterbox(*src, *net)
    x0, y0 = int(tx * mw / net[0]), int(ty * mh / net[1])
    inner = maps[:, y0 : mh - y0, x0 : mw - x0]
    limit = iou if mask_threshold is None else mask_threshold
    masks = []
    for m, (x, y, w, h) in zip(inner, b.tlwh.astype(int)):
        masks.append(resize_plane(m, src[0], src[1], (x, y, w, h)) > limit)
    b.extra["mask"] = masks
    return b


def decode_v8_obb(output: np.ndarray, src, net, conf: float, iou: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated boxes: (n, 5) centre, size, angle; scores; classes. Every class above the threshold gives a box."""
    rows = output.T.astype(np.float64)
    i, k = np.nonzero(rows[:, 4:-1] > conf)
    score = rows[i, 4 + k]
    ratio, tx, ty = letterbox(*src, *net)
    b = np.stack([(rows[i, 0] - tx) / ratio, (rows[i, 1] - ty) / ratio, rows[i, 2] / ratio, rows[i, 3] / ratio, rows[i, -1]], 1)
    swap = b[:, 3] > b[:, 2]
    b[:, 2:4] = np.where(swap[:, None], b[:, 3:1:-1], b[:, 2:4])
    b[:, 4] = np.mod(b[:, 4] + np.where(swap, np.pi / 2, 0), np.pi)
    moved = b.copy()
    moved[:, :2] += (k * CLASS_OFFSET)[:, None]
    order, kept = np.argsort(-score, kind="stable"), []
    while len(order):
        kept.append(order[0])
        order = order[1:][prob_iou(moved[order[0]], moved[order[1:]]) < iou]
    kept = np.array(kept, np.int64)
    return b[kept], score[kept], k[kept]


def prob_iou(a: np.ndarray, b: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    def cov(x):
        p, q = x[..., 2] ** 2 / 12, x[..., 3] ** 2 / 12
        c, s = np.cos(x[..., 4]), np.sin(x[..., 4])
        return p * c * c + q * s * s, p * s * s + q * c * c, (p - q) * c * s

    a1, b1, c1 = cov(a)
    a2, b2, c2 = cov(b)
    dx, dy = a[..., 0] - b[..., 0], a[..., 1] - b[..., 1]
    det = (a1 + a2) * (b1 + b2) - (c1 + c2) ** 2
    t1 = ((a1 + a2) * dy**2 + (b1 + b2) * dx**2) / (det + eps) / 4
    t2 = (c1 + c2) * -dx * dy / (det + eps) / 2
    inner = np.clip(a1 * b1 - c1**2, 0, None) * np.clip(a2 * b2 - c2**2, 0, None)
    t3 = np.log(det / (4 * np.sqrt(inner) + eps) + eps) / 2
    bd = np.clip(t1 + t2 + t3, eps, 100)
    return 1 - np.sqrt(1 - np.exp(-bd) + eps)


def decode_yolox(output: np.ndarray, src, net, conf, iou: float, size_gate: tuple[float, float] = (0, np.inf)) -> Boxes:
    """(n, 5 + classes) rows over strides 8, 16, 32; class-agnostic suppression in frame space."""
    centre, stride = [], []
    for s in YOLOX_STRIDES:
        gy, gx = np.meshgrid(np.arange(net[1] // s), np.arange(net[0] // s), indexing="ij")
        centre.append(np.stack([gx, gy], -1).reshape(-1, 2))
        stride.append(np.full(gx.size, s))
    centre, stride = np.concatenate(centre), np.concatenate(stride)
    keep = output[:, 4] >= least(conf)
    rows, centre, stride = output[keep].astype(np.float64), centre[keep], stride[keep]
    i, k = np.nonzero(rows[:, 4:5] * rows[:, 5:] > 0)
    score = rows[i, 4] * rows[i, 5 + k]
    pick = score > _threshold(k, conf)
    i, k, score = i[pick], k[pick], score[pick]
    c = (rows[i, :2] + centre[i]) * stride[i][:, None]
    wh = np.exp(rows[i, 2:4]) * stride[i][:, None]
    ratio, tx, ty = letterbox(*src, *net)
    lo, hi = (c - wh / 2 - (tx, ty)) / ratio, (c + wh / 2 - (tx, ty)) / ratio
    lo, hi = np.clip(lo, 0, np.array(src) - 1), np.clip(hi, 0, np.array(src) - 1)
    b = Boxes(np.concatenate([lo, hi - lo], 1), score, k)
    size = b.tlwh[:, 2:]
    b = b.take((size.prod(1) > YOLOX_LEAST_AREA) & (size > size_gate[0]).all(1) & (size < size_gate[1]).all(1))
    b = nms(b, iou)
    return Boxes(np.trunc(b.tlwh), b.score, b.klass)


def decode_faces(loc: np.ndarray, conf: np.ndarray, marks: np.ndarray, src, threshold: float, iou: float, max_faces: int | None = None) -> Boxes:
    """Faces with five landmarks over prior boxes of a 640 net that keeps the frame at its origin."""
    priors = []
    for s, sizes in FACE_ANCHORS.items():
        n = FACE_NET // s
        gy, gx = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        c = (np.stack([gx, gy], -1).reshape(-1, 1, 2) + 0.5) * s / FACE_NET
        wh = np.array(sizes, np.float64).reshape(1, -1, 1) / FACE_NET
        priors.append(np.concatenate(np.broadcast_arrays(c, np.repeat(wh, 2, 2)), -1).reshape(-1, 4))
    p = np.concatenate(priors)[: len(loc)]
    keep = conf[:, 1] > threshold
    p, loc, marks, score = p[keep], loc[keep], marks[keep].reshape(-1, 5, 2), conf[keep, 1].astype(np.float64)
    c = p[:, :2] + loc[:, :2] * FACE_VARIANCE[0] * p[:, 2:]
    wh = p[:, 2:] * np.exp(loc[:, 2:] * FACE_VARIANCE[1])
    scale = FACE_NET / min(FACE_NET / src[0], FACE_NET / src[1])
    points = (p[:, None, :2] + marks * FACE_VARIANCE[0] * p[:, None, 2:]) * scale
    lo, hi = np.clip((c - wh / 2) * scale, 0, src), np.clip((c + wh / 2) * scale, 0, src)
    b = nms(Boxes(np.concatenate([lo, hi - lo], 1), score, np.zeros(len(score), np.int64), {"points": points}), iou, plus=1)
    return b if max_faces is None else b.take(np.arange(min(max_faces, len(b.score))))


def resize_plane(plane: np.ndarray, width: int, height: int, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Bilinear, pixel centres aligned; of the result only `window` (x, y, w, h) is made."""
    h, w = plane.shape[:2]
    x, y, nx, ny = window or (0, 0, width, height)
    rows, cols = np.arange(y, min(y + ny, height)), np.arange(x, min(x + nx, width))
    ys, xs = np.clip((rows + 0.5) * h / height - 0.5, 0, h - 1), np.clip((cols + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None]
    if plane.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    p = plane.astype(np.float64)
    top, bottom = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return top * (1 - fy) + bottom * fy
