"""Queries of the model outputs: tensors planted from the tables as a model would give them, decoded, and SQL for what must come out.

The planted numbers are such that no rounding falls on an edge: sizes and places are a quarter or a half off whole pixels where
a logarithm or a power stands between.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import action, ctc, decode, pose
from strandline.operators import decoders as M
from strandline.sources import domain as D
from strandline.sources.tables import table

FRAME = D.FRAME
SRC, NET = (2560, 1440), (1280, 1280)  # a letterbox of ratio 1/2, 280 pixels down
PAD = 280
CLASSES = 8
COLUMNS = ["det_idx", "x", "y", "w", "h", "score", "class_id"]


def packed(spark, d, keys: list[str] = FRAME, where: str = "true", rows: DataFrame | None = None) -> DataFrame:
    """The usable boxes of each frame (or of other keys) as parallel arrays in order of det_idx."""
    rows = D.detections(spark, d, *COLUMNS[1:]) if rows is None else rows
    rows = rows.where("score is not null and class_id >= 0 and w > 0 and h > 0").where(where)
    boxes = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in COLUMNS])))
    return rows.groupBy(*keys).agg(boxes.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in COLUMNS])


def _planted(keys: list[str], fn, n: int, again: bool = False):
    """Batches of packed boxes to batches of tensors, of BLOCK bytes each or of one row.

    again: all batches are in the same memory, so each must be done with before the next is asked for.
    """
    names = [*keys, *[f"t{i}" for i in range(n)]]
    room = [np.empty(0)] * n

    def joined(k, o):
        size = sum(map(len, o))
        if not again or not size:
            return np.concatenate([*o, np.zeros(0)])
        if len(room[k]) < size:
            room[k] = np.empty(size)
        return np.concatenate(o, out=room[k][:size])

    def batch(b, begin, end, out):
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in o])]).astype(np.int32)), pa.array(joined(k, o))) for k, o in enumerate(out)]
        return pa.RecordBatch.from_arrays([*[b.column(i).slice(begin, end - begin).cast(pa.int64()) for i in range(len(keys))], *lists], names)

    def run(batches):
        for b in batches:
            data = [M.flat(b.column(len(keys) + i)) for i in range(len(COLUMNS))]
            begin, held, out = 0, 0, [[] for _ in range(n)]
            for i in range(b.num_rows):
                for o, t in zip(out, fn({c: v[s[i] : s[i + 1]] for c, (v, s) in zip(COLUMNS, data)})):
                    o.append(np.asarray(t, np.float64).ravel())
                held += (size := sum(o[-1].nbytes for o in out))
                if held + size > M.BLOCK:  # another such row would be too much
                    yield batch(b, begin, i + 1, out)
                    begin, held, out = i + 1, 0, [[] for _ in range(n)]
            yield batch(b, begin, b.num_rows, out)

    return run


def plant(rows: DataFrame, keys: list[str], fn, n: int = 1) -> DataFrame:
    """keys, t0.. of every row: fn(dict of a frame's box arrays) -> n tensors."""
    return rows.select(*keys, *COLUMNS).mapInArrow(_planted(keys, fn, n), ", ".join([f"{k} long" for k in keys] + [f"t{i} array<double>" for i in range(n)]))


def _decode(tensors: DataFrame, keys: list[str], made, n: int = 1) -> DataFrame:
    fn, fields = made
    return M.table_function(tensors, keys, [f"t{i}" for i in range(n)], fn, fields)


def _plant_decode(rows: DataFrame, keys: list[str], fn, made, n: int = 1) -> DataFrame:
    """_decode(plant(..)) in one stage, as a model and what reads its output share a process: maps never cross to Spark and back."""
    decode_fn, fields = made
    planted, read = _planted(keys, fn, n, again=True), M.child_batches(keys, [f"t{i}" for i in range(n)], decode_fn, fields)
    kept = rows.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, *COLUMNS)
    return kept.mapInArrow(lambda batches: read(planted(batches)), M.child_schema(keys, fields))


def _rows(b: dict, shift: float = 0.0) -> np.ndarray:
    """Centre and size in the net, of boxes grown by 2 * shift."""
    return np.stack([(b["x"] + b["w"] / 2 + 2 * shift) / 2, (b["y"] + b["h"] / 2 + 2 * shift) / 2 + PAD, (b["w"] + 2 * shift) / 2, (b["h"] + 2 * shift) / 2], 1)


def _hot(b: dict, value=None) -> np.ndarray:
    m = np.zeros((len(b["x"]), CLASSES))
    m[np.arange(len(m)), b["class_id"].astype(int) % CLASSES] = b["score"] if value is None else value
    return m


def _decoded(b: dict):
    """Rows of a decoded output: centre, size, objectness, class scores."""
    return [np.concatenate([_rows(b), b["score"][:, None], _hot(b, 1.0)], 1)]


def _v8(b: dict, *more):
    return np.concatenate([_rows(b), _hot(b), *more], 1).T


ONE = {"src": SRC, "net": NET, "conf": 0.3, "iou": 0.5}
DET = [*FRAME, "class_id", "score", "x", "y", "w", "h"]


def decode_yolov5(spark, d):
    return _decode(plant(packed(spark, d), FRAME, _decoded), FRAME, M.yolov5({**ONE, "shapes": [(-1, 5 + CLASSES)]})).select(*DET)


def decode_yolov7(spark, d):
    return _decode(plant(packed(spark, d), FRAME, _decoded), FRAME, M.yolov5({**ONE, "version": 7, "shapes": [(-1, 5 + CLASSES)]})).select(*DET)


def decode_yolov8(spark, d):
    return _decode(plant(packed(spark, d), FRAME, lambda b: [_v8(b)]), FRAME, M.yolov8_detect({**ONE, "shapes": [(4 + CLASSES, -1)]})).select(*DET)


def decode_yolov8_in_net(spark, d):
    """The row-major kernel's order: clipped in the net, then taken out of the letterbox."""
    return _decode(plant(packed(spark, d), FRAME, lambda b: [_v8(b)]), FRAME, M.yolov8_detect({**ONE, "clip_in_net": True, "shapes": [(4 + CLASSES, -1)]})).select(*DET)


HEADS_KEYS = [*FRAME, "image"]


def _heads(b: dict):
    """Three heads of one cell and three anchors each; the last holds up to three boxes, each at an anchor that can make it."""
    out = [np.full((3, 1, 1, 5 + CLASSES), -50.0) for _ in range(3)]
    rows, logit = _rows(b, 0.25), lambda p: np.log(p / (1 - p))
    for i, at in enumerate(b["det_idx"].astype(int) % 3):
        r, o = rows[i], out[2][at, 0, 0]
        o[:2] = logit((r[:2] / NET + 0.5) / 2)
        o[2:4] = logit(np.sqrt(r[2:] / np.array(decode.ANCHORS_V5[2][at])) / 2)
        o[4] = logit(np.clip(b["score"][i], 1e-9, 1 - 1e-9))
        o[5 + int(b["class_id"][i]) % CLASSES] = 40.0
    return out


def decode_yolov5_heads(spark, d):
    """The output of three heads; a frame's boxes three at a time, as images of their own."""
    rows = D.detections(spark, d, *COLUMNS[1:]).withColumn("image", F.floor(F.col("det_idx") / 3))
    rows = packed(spark, d, HEADS_KEYS, "w < 400 and h < 300", rows)
    out = _decode(plant(rows, HEADS_KEYS, _heads, 3), HEADS_KEYS, M.yolov5({**ONE, "conf": 0.3000005, "shapes": [(3, 1, 1, 5 + CLASSES)] * 3}), 3)
    return out.select(*FRAME, "image", "class_id", F.round("score", 5).alias("score"), "x", "y", "w", "h")


def _keypoints(b: dict):
    i = np.arange(17) / 16
    x, y = b["x"][:, None] + b["w"][:, None] * i, b["y"][:, None] + b["h"][:, None] * i
    k = np.stack([x / 2, y / 2 + PAD, np.broadcast_to(b["score"][:, None], x.shape)], 2).reshape(len(x), -1)
    return [np.concatenate([_rows(b), b["score"][:, None], k], 1).T]


def decode_yolov8_pose(spark, d):
    out = _decode(plant(packed(spark, d), FRAME, _keypoints), FRAME, M.yolov8_pose({**ONE, "shapes": [(56, -1)]}))
    return out.select(*FRAME, "person", "point", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), F.col("ps").alias("score"))


def decode_yolov8_cls(spark, d):
    return _decode(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("t0")), ["vec_id"], M.yolov8_cls({"shapes": [(64,)]})).select("vec_id", "class_id", F.round("score", 6).alias("score"))


SEG = {"src": (320, 180), "net": (160, 160), "conf": 0.3, "iou": 0.5, "shapes": [(4 + CLASSES + 32, -1), (32, 10, 10)]}


def _masked(b: dict):
    """Boxes of an eighth of their size; mask coefficients pick a plane: the even ones are full, the odd ones hold the left half."""
    x, y, w, h = (np.floor(np.maximum(b[c], 0) / 8) for c in "xywh")
    rows = np.stack([(x + w / 2) / 2, (y + h / 2) / 2 + 35, w / 2, h / 2], 1)
    pick = np.eye(32)[b["det_idx"].astype(int) % 32]
    proto = np.full((32, 10, 10), 10.0)
    proto[1::2, :, 5:] = -10
    return [np.concatenate([rows, _hot(b), pick], 1).T, proto]


def decode_yolov8_seg(spark, d):
    return _decode(plant(packed(spark, d), FRAME, _masked, 2), FRAME, M.yolov8_seg(SEG), 2).select(*DET, "area")


def _turned(b: dict):
    return [np.concatenate([_rows(b), _hot(b), (b["det_idx"] % 7 * 0.4)[:, None]], 1).T]


def decode_yolov8_obb(spark, d):
    out = _decode(plant(packed(spark, d), FRAME, _turned), FRAME, M.yolov8_obb({**ONE, "iou": 0.3, "shapes": [(5 + CLASSES, -1)]}))
    return out.select(*FRAME, "class_id", "score", *[F.round(c, 3).alias(c) for c in ("cx", "cy", "bw", "bh", "angle")])


YOLOX = {"src": (4096, 2304), "net": (64, 64), "conf": 0.3, "iou": 0.5, "shapes": [(84, 5 + CLASSES)]}


def _grid(b: dict):
    """A whole output over three strides; box i sits in cell i."""
    out = np.zeros((84, 5 + CLASSES))
    n = min(len(b["x"]), 84)
    gy, gx = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    cell = np.stack([gx.ravel(), gy.ravel()], 1)[:n] if n <= 64 else None
    c = np.stack([b["x"] + b["w"] / 2 + 0.5, b["y"] + b["h"] / 2 + 0.5 + 14 * 64], 1) / 64
    wh = np.stack([b["w"] + 0.5, b["h"] + 0.5], 1) / 64
    out[:n, :2], out[:n, 2:4] = c[:n] / 8 - cell, np.log(wh[:n] / 8)
    out[:n, 4] = b["score"][:n]
    out[:n, 5:] = _hot(b, 1.0)[:n]
    return [out]


def decode_yolox(spark, d):
    return _decode(plant(packed(spark, d), FRAME, _grid), FRAME, M.yolox(YOLOX)).select(*DET)


def _priors(n: int) -> np.ndarray:
    """The first n prior boxes of the face detector: pairs of sizes along the first rows of the finest stride."""
    i = np.arange(n) // 2
    size = np.where(np.arange(n) % 2, 32, 16) / 640
    return np.stack([(i % 80 + 0.5) * 8 / 640, (i // 80 + 0.5) * 8 / 640, size, size], 1)


def _faces(b: dict):
    p = _priors(len(b["x"]))
    c, wh = np.stack([b["x"] + b["w"] / 2, b["y"] + b["h"] / 2], 1) / 2560, np.stack([b["w"], b["h"]], 1) / 2560
    loc = np.concatenate([(c - p[:, :2]) / (0.1 * p[:, 2:]), np.log(wh / p[:, 2:]) / 0.2], 1)
    marks = np.repeat(((c - p[:, :2]) / (0.1 * p[:, 2:]))[:, None], 5, 1)
    return [loc, np.stack([1 - b["score"], b["score"]], 1), marks]


def decode_faces(spark, d):
    made = M.faces({"src": SRC, "conf": 0.3, "iou": 0.4, "max_face_count": 5, "shapes": [(-1, 4), (-1, 2), (-1, 10)]})
    out = _decode(plant(packed(spark, d), FRAME, _faces, 3), FRAME, made, 3)
    return out.select(*FRAME, "score", *[F.round(c, 3).alias(c) for c in ("left", "top", "width", "height", "nose_x", "nose_y")])


TEXT = {"src": (128, 96), "shapes": [(48, 64)]}


def text_outlines(spark, d):
    """A text map of 64 x 48 cells with one bright block for each vector, to the block's grown outline in the frame."""
    x0, y0, w, h = (F.col("vec_id") % 20 + 12, F.col("vec_id") % 15 + 10, F.col("vec_id") % 11 + 12, F.col("vec_id") % 7 + 8)
    cell = F.sequence(F.lit(0), F.lit(64 * 48 - 1))
    lit = F.transform(cell, lambda i: F.when((i % 64).between(x0, x0 + w - 1) & F.floor(i / 64).between(y0, y0 + h - 1), 0.9).otherwise(0.05))
    rows = table(spark, d, "embeddings").select("vec_id", lit.alias("t0"))
    return _decode(rows, ["vec_id"], M.text_detect(TEXT)).select("vec_id", "x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")


def text_beam(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 1).alias("t0"))
    out = _decode(rows, ["vec_id"], M.text_beam({"shapes": [(16, 4)], "alphabet": ["-", "A", "B", "C"], "beam": 3}))
    return out.select("vec_id", "text", F.round("confidence", 5).alias("confidence"))


PLATE_STEPS = 18


def plate_text(spark, d):
    """The whole plate alphabet: 68 symbols, the last one blank, over 18 steps."""
    tensor = F.transform(F.sequence(F.lit(0), F.lit(68 * PLATE_STEPS - 1)), lambda i: F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double") * (1 + (i * 7 + F.col("vec_id")) % 13))
    return table(spark, d, "embeddings").select("vec_id", tensor.alias("t")).select("vec_id", ctc.greedy_text(ctc.best_steps(F.col("t"), 68, PLATE_STEPS, True), ctc.PLATE, 67).alias("text"))


SIDE = 16


def _spot(part: np.ndarray, frame: int) -> tuple[np.ndarray, np.ndarray]:
    return 2 + (part * 5 + frame) % 12, 2 + (part * 7 + 3) % 12


@lru_cache(1)
def _bodies() -> np.ndarray:
    """Heat maps of one person for each of 12 kinds of frames: part p at a place of its own, each limb's field along it."""
    out = np.zeros((12, 78, SIDE, SIDE))
    for f, maps in enumerate(out):
        x, y = _spot(np.arange(25), f)
        maps[np.arange(25), y, x] = 0.9
        for a, c, mx, my in pose.BODY_25["limbs"]:
            v = np.array([x[c] - x[a], y[c] - y[a]], float)
            maps[mx], maps[my] = (v / np.hypot(*v))[:, None, None]
    return out


def _body(b: dict):
    return [_bodies()[int(b["x"][0]) % 12]]


def pose_people(spark, d):
    made = M.openpose({"shapes": [(78, SIDE, SIDE)], "scale": 8.0})
    out = _plant_decode(packed(spark, d), FRAME, _body, made)
    return out.select(*FRAME, "person", "point", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"), F.round("ps", 3).alias("ps"))


def _heat(b: dict):
    """17 joints in a map of 12 x 16 cells for each crop of a frame; crops of 48 x 64 that lie far apart."""
    n = len(b["x"])
    maps = np.zeros((n, 17, 16, 12))
    j, k = np.arange(17), b["class_id"].astype(int)[:, None]
    maps[np.arange(n)[:, None], j, 1 + (j * 3 + k) % 14, 1 + (j * 5 + k) % 10] = 0.8
    return [maps, np.stack([b["det_idx"] * 1000, np.zeros(n), np.full(n, 48.0), np.full(n, 64.0)], 1)]


def pose_crops(spark, d):
    out = _plant_decode(packed(spark, d), FRAME, _heat, M.fastpose({"shapes": [(-1, 17, 16, 12), (-1, 4)]}), 2)
    crop = F.floor(F.col("px") / 1000)  # the crops' origins are a thousand pixels apart
    return out.select(*FRAME, crop.cast("int").alias("crop"), "point", F.round(F.col("px") - crop * 1000, 3).alias("px"), F.round("py", 3).alias("py"), F.round("ps", 3).alias("ps"))


WINDOW = 24
CLIP_FRAME = (640, 640)


def action_clips(spark, d):
    """Windows of up to 24 frames of a run, a pose of four joints in each, to the places of greatest heat in the first frame of each clip."""
    f = D.frames(spark, d, "width").select(*FRAME).withColumn("win", F.floor(F.col("frame_id") / WINDOW))
    joints = F.flatten(F.array(*[F.array(F.lit(float(x)), F.lit(float(y)), F.lit(0.9)) for x, y in ((100, 100), (420, 100), (100, 420), (420, 420))]))
    rows = f.groupBy("task_id", "win").agg(F.count(F.lit(1)).alias("n")).select("task_id", "win", F.flatten(F.array_repeat(joints, F.col("n").cast("int"))).alias("t0"))
    out = _decode(rows, ["task_id", "win"], M.posec3d({"src": CLIP_FRAME, "shapes": [(-1, 4, 3)]}))
    return out.where("step = 0").select("task_id", "win", "clip", "joint", "hx", "hy")


# SQL

_BASE = f"""pl as (select task_id, frame_id, det_idx, class_id % {CLASSES} as class_id, score, x, y, w, h, cast(x as double) / 2 as nx, cast(y as double) / 2 + {PAD} as ny, cast(w as double) / 2 as nw, cast(h as double) / 2 as nh
  from det where score is not null and class_id >= 0 and w > 0 and h > 0)"""


def _nms(source: str, threshold: float, keys=("task_id", "frame_id"), plus: int = 0, shift: str = "0", test: str = "") -> str:
    """Common table expressions that leave in kp what greedy suppression keeps of `source` (qx, qy, bw, bh), with its place."""
    k = ", ".join(keys)
    on = lambda a, b: " and ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    p = f" + {plus}" if plus else ""
    cut = lambda a, s: f"greatest(0.0, least(k.{a} + k.{s}, c.{a} + c.{s}) - greatest(k.{a}, c.{a}){p})"
    inter = f"{cut('mx', 'bw')} * {cut('my', 'bh')}"
    union = f"((k.bw{p}) * (k.bh{p}) + (c.bw{p}) * (c.bh{p}) - {inter})"
    test = test or f"{union} > 0 and {inter} / {union} > {threshold}"
    return f"""rk as (select *, qx + {shift} as mx, qy + {shift} as my, row_number() over (partition by {k} order by score desc, det_idx) as rn from {source}),
go as (select {k}, rn, [rn] as kept from rk where rn = 1
  union all select {', '.join('c.' + x for x in keys)}, c.rn, case when exists (select 1 from rk k where {on('k', 'c')} and list_contains(g.kept, k.rn) and {test}) then g.kept else list_append(g.kept, c.rn) end
  from go g join rk c on {on('c', 'g')} and c.rn = g.rn + 1),
top as (select {k}, max_by(kept, rn) as kept from go group by {k}),
kp as (select rk.*, cast(row_number() over (partition by {', '.join('rk.' + x for x in keys)} order by rk.rn) - 1 as int) as place from rk join top on {on('rk', 'top')} and list_contains(top.kept, rk.rn))"""


WITH = "with recursive " + D.SQL + ", " + _BASE
_W, _H = SRC
_INT = lambda e, n: f"cast(trunc({e}) as int) as {n}"
_OUT = "select task_id, frame_id, class_id, score, "


def _ends(x: str, y: str, w: str, h: str) -> str:
    return ", ".join(_INT(e, n) for e, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h")))


_V5 = f"ox as (select *, greatest(qx * 2, 0) as fx, greatest((qy - {PAD}) * 2, 0) as fy, least((qx + bw) * 2, {_W}) as gx, least((qy + bh - {PAD}) * 2, {_H}) as gy from kp)"
_V8 = f"""v8 as (select *, greatest({{lx}}, 0) as qx, greatest({{ly}}, 0) as qy, least({{hx}}, {_W - 1}) as hx, least({{hy}}, {_H - 1}) as hy from pl where score >= 0.3), v8b as (select *, hx - qx as bw, hy - qy as bh from v8)"""
_PLAIN = _V8.format(lx=f"least(greatest(cast(x as double), 0), {_W})", ly=f"least(greatest(cast(y as double), 0), {_H})", hx=f"least(greatest(cast(x + w as double), 0), {_W})", hy=f"least(greatest(cast(y + h as double), 0), {_H})")
_IN_NET = _V8.format(lx="least(greatest(nx, 0), 1280) * 2", ly=f"(least(greatest(ny, 0), 1280) - {PAD}) * 2", hx="least(greatest(nx + nw, 0), 1280) * 2", hy=f"(least(greatest(ny + nh, 0), 1280) - {PAD}) * 2")
_SHIFT = "class_id * 7680"
#: Gaussians of rotated boxes and one minus their Hellinger distance, for k and c with px, py, pw, ph, pr.
_COV = lambda t: (f"({t}.pw * {t}.pw / 12 * cos({t}.pr) * cos({t}.pr) + {t}.ph * {t}.ph / 12 * sin({t}.pr) * sin({t}.pr))", f"({t}.pw * {t}.pw / 12 * sin({t}.pr) * sin({t}.pr) + {t}.ph * {t}.ph / 12 * cos({t}.pr) * cos({t}.pr))", f"(({t}.pw * {t}.pw / 12 - {t}.ph * {t}.ph / 12) * cos({t}.pr) * sin({t}.pr))")
(_A1, _B1, _C1), (_A2, _B2, _C2) = _COV("k"), _COV("c")
_DET = f"(({_A1} + {_A2}) * ({_B1} + {_B2}) - pow({_C1} + {_C2}, 2))"
_T1 = f"((({_A1} + {_A2}) * pow(k.py - c.py, 2) + ({_B1} + {_B2}) * pow(k.px - c.px, 2)) / ({_DET} + 1e-7) / 4)"
_T2 = f"(({_C1} + {_C2}) * (c.px - k.px) * (k.py - c.py) / ({_DET} + 1e-7) / 2)"
_T3 = f"(ln({_DET} / (4 * sqrt(greatest({_A1} * {_B1} - {_C1} * {_C1}, 0) * greatest({_A2} * {_B2} - {_C2} * {_C2}, 0)) + 1e-7) + 1e-7) / 2)"
PROB_IOU = f"1 - sqrt(1 - exp(-least(greatest({_T1} + {_T2} + {_T3}, 1e-7), 100.0)) + 1e-7)"
_ROT = "px, py, pw, ph, pr, px as qx, py as qy, pw as bw, ph as bh"
_TEXT_BEST = "b as (select vec_id, j, arg_max(k, (v, -k)) as s, max(v) as p from (select vec_id, j, k, {value} as v from embeddings, range({steps}) a(j), range({symbols}) b(k)) group by vec_id, j), k as (select *, lag(s) over (partition by vec_id order by j) as before from b)"
_PLATE_LIST = "['" + "','".join(ctc.PLATE) + "']"

_PX = "cast(2 + (p * 5 + f) % 12 as double)"
_PY = "cast(2 + (p * 7 + 3) % 12 as double)"

ORACLE = {
    "decode_yolov5": WITH + ", s5 as (select *, greatest(trunc(nx), 0) as qx, greatest(trunc(ny), 0) as qy, nw as bw, nh as bh from pl where score > 0.3), " + _nms("s5", 0.5, shift=_SHIFT) + ", " + _V5 + " " + _OUT + _ends("fx", "fy", "gx - fx", "gy - fy") + " from ox",
    "decode_yolov7": WITH + f""", s7 as (select *, greatest(trunc((nx + nw / 2 + 1) / 0.5 - 1 - (nw + 0.5) / 0.5 / 2), 0) as qx, greatest(trunc((ny + nh / 2 + 1 - {PAD}) / 0.5 - 1 - (nh + 0.5) / 0.5 / 2), 0) as qy from pl where score > 0.3),
s7b as (select *, trunc(least((nw + 0.5) / 0.5, {_W - 1} - qx)) as bw, trunc(least((nh + 0.5) / 0.5, {_H - 1} - qy)) as bh from s7), """ + _nms("s7b", 0.5) + " " + _OUT + _ends("qx", "qy", "bw", "bh") + " from kp",
    "decode_yolov8": WITH + ", " + _PLAIN + ", " + _nms("v8b", 0.5, shift=_SHIFT) + " " + _OUT + _ends("qx", "qy", "bw", "bh") + " from kp where place < 300",
    "decode_yolov8_in_net": WITH + ", " + _IN_NET + ", " + _nms("v8b", 0.5, shift=_SHIFT) + " " + _OUT + _ends("qx", "qy", "bw", "bh") + " from kp where place < 300",
    "decode_yolov5_heads": WITH + f""", s6 as (select task_id, frame_id, det_idx // 3 as image, det_idx, class_id, score, greatest((x + 0.25) / 2.0, 0) as qx, (y + 0.25) / 2.0 + {PAD} as qy, (w + 0.5) / 2.0 as bw, (h + 0.5) / 2.0 as bh from pl where score > 0.3000005 and w < 400 and h < 300), """
    + _nms("s6", 0.5, ("task_id", "frame_id", "image"), shift=_SHIFT) + ", " + _V5 + " select task_id, frame_id, image, class_id, round(score, 5) as score, " + _ends("fx", "fy", "gx - fx", "gy - fy") + " from ox",
    "decode_yolov8_pose": WITH + ", " + _PLAIN + ", " + _nms("v8b", 0.5) + " select task_id, frame_id, place as person, cast(i as int) as point, round(x + w * i / 16.0, 4) as px, round(y + h * i / 16.0, 4) as py, score from kp, range(17) t(i) where place < 300",
    "decode_yolov8_cls": "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as class_id, round(cast(list_max(embedding) as double), 6) as score from embeddings",
    "decode_yolov8_seg": WITH + """, e as (select task_id, frame_id, det_idx, class_id, score, greatest(x, 0) // 8 as x, greatest(y, 0) // 8 as y, w // 8 as w, h // 8 as h from pl where score >= 0.3),
s8 as (select *, cast(least(x, 320) as double) as qx, cast(least(y, 180) as double) as qy, least(x + w, 319) - least(x, 320) + 0.0 as bw, least(y + h, 179) - least(y, 180) + 0.0 as bh from e), """ + _nms("s8", 0.5, shift=_SHIFT) + """,
m as (select task_id, frame_id, class_id, score, det_idx, cast(qx as int) as x, cast(qy as int) as y, cast(bw as int) as w, cast(bh as int) as h from kp where place < 300)
select task_id, frame_id, class_id, score, x, y, w, h, cast(case when det_idx % 2 = 0 then w else greatest(least(x + w, 160) - x, 0) end as bigint) * h as area from m where w > 1 and h > 1""",
    "decode_yolov8_obb": WITH + f""", q as (select *, (det_idx % 7) * 0.4 as r, cast(x + w / 2.0 as double) as fx, cast(y + h / 2.0 as double) as fy from pl where score > 0.3),
qs as (select task_id, frame_id, det_idx, class_id, score, fx + class_id * 7680 as px, fy + class_id * 7680 as py, cast(greatest(w, h) as double) as pw, cast(least(w, h) as double) as ph,
  (case when h > w then cast(r as double) + pi() / 2 else cast(r as double) end) - pi() * floor((case when h > w then cast(r as double) + pi() / 2 else cast(r as double) end) / pi()) as pr from q),
q2 as (select task_id, frame_id, det_idx, class_id, score, {_ROT} from qs), """ + _nms("q2", 0.3, test=f"{PROB_IOU} >= 0.3") + " select task_id, frame_id, class_id, score, round(px - class_id * 7680, 3) as cx, round(py - class_id * 7680, 3) as cy, round(pw, 3) as bw, round(ph, 3) as bh, round(pr, 3) as angle from kp",
    "decode_yolox": WITH + """, sx as (select *, greatest(x + 0.25, 0) as qx, greatest(y + 0.25, 0) as qy, least(greatest(x + w + 0.75, 0), 4095) as hx, least(greatest(y + h + 0.75, 0), 2303) as hy from pl where score > 0.3),
sb as (select *, cast(hx - qx as double) as bw, cast(hy - qy as double) as bh from sx), sg as (select * from sb where bw * bh > 100 and bw > 0 and bh > 0), """ + _nms("sg", 0.5) + " " + _OUT + _ends("qx", "qy", "bw", "bh") + " from kp",
    "decode_faces": WITH + f""", fa as (select *, cast(least(greatest(x, 0), {_W}) as double) as qx, cast(least(greatest(y, 0), {_H}) as double) as qy, cast(least(greatest(x + w, 0), {_W}) as double) as hx, cast(least(greatest(y + h, 0), {_H}) as double) as hy from pl where score > 0.3),
fb as (select *, hx - qx as bw, hy - qy as bh from fa), """ + _nms("fb", 0.4, plus=1) + ' select task_id, frame_id, score, round(qx, 3) as "left", round(qy, 3) as top, round(bw, 3) as width, round(bh, 3) as height, round(x + w / 2.0, 3) as nose_x, round(y + h / 2.0, 3) as nose_y from kp where place < 5',
    "text_outlines": """with r as (select vec_id, vec_id % 20 + 12 as x0, vec_id % 15 + 10 as y0, vec_id % 11 + 11 as a, vec_id % 7 + 7 as b from embeddings), g as (select *, a * b * 1.5 / (2.0 * (a + b)) as d from r),
q as (select vec_id, cast(floor((x0 - d) * 2 + 0.5) as int) as l, cast(floor((y0 - d) * 2 + 0.5) as int) as t, cast(floor((x0 + a + d) * 2 + 0.5) as int) as r, cast(floor((y0 + b + d) * 2 + 0.5) as int) as u from g)
select vec_id, greatest(l, 0) as x1, greatest(t, 0) as y1, least(r, 127) as x2, greatest(t, 0) as y2, least(r, 127) as x3, least(u, 95) as y3, greatest(l, 0) as x4, least(u, 95) as y4 from q""",
    "text_beam": "with " + _TEXT_BEST.format(value="cast(embedding[j * 4 + k + 1] as double) + 1", steps=16, symbols=4) + " select e.vec_id, coalesce(string_agg(case s when 1 then 'A' when 2 then 'B' when 3 then 'C' end, '' order by j), '###') as text, round(coalesce(avg(p), 0), 5) as confidence from embeddings e left join (select * from k where s <> 0 and (before is null or before <> s)) x on x.vec_id = e.vec_id group by e.vec_id",
    "plate_text": "with " + _TEXT_BEST.format(value=f"cast(embedding[(k * {PLATE_STEPS} + j) % 64 + 1] as double) * (1 + ((k * {PLATE_STEPS} + j) * 7 + vec_id) % 13)", steps=PLATE_STEPS, symbols=68) + f" select e.vec_id, coalesce(string_agg({_PLATE_LIST}[s + 1], '' order by j), '') as text from embeddings e left join (select * from k where s <> 67 and (before is null or before <> s)) x on x.vec_id = e.vec_id group by e.vec_id",
    "pose_people": WITH + f", f as (select task_id, frame_id, min_by(x, det_idx) as x from pl group by all), g as (select task_id, frame_id, ((x % 12) + 12) % 12 as f, p from f, range(25) t(p)) select task_id, frame_id, 0 as person, cast(p as int) as point, {_PX} * 8 as px, {_PY} * 8 as py, 0.9 as ps from g",
    "pose_crops": WITH.replace(f"class_id % {CLASSES} as class_id", "class_id") + ", j as (select task_id, frame_id, det_idx, cast(j as int) as point, 1 + (j * 5 + class_id) % 10 as cx, 1 + (j * 3 + class_id) % 14 as cy from pl, range(17) t(j)) select task_id, frame_id, det_idx as crop, point, (cx - 6.0) * 4 + 24 as px, (cy - 8.0) * 4 + 32 as py, 0.8 as ps from j",
    "action_clips": "with " + D.SQL + f", w as (select task_id, frame_id // {WINDOW} as win from fr group by all), j(joint, x, y) as (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) select task_id, win, cast(c as int) as clip, joint, cast(6 + 52 * x as int) as hx, cast(6 + 52 * y as int) as hy from w, j, range({action.CLIPS}) t(c)",
}
QUERIES = {k: globals()[k] for k in ORACLE}
