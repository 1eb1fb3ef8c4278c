"""Model outputs as table functions: rows with tensors to child rows with boxes, keypoints, masks, texts, poses, clips.

A tensor is an array column, flattened in the order its model gives it; the shape is configuration. Each decoder is a kernel over
one row's tensors; `table_function` runs it over Arrow batches without a Python object for each value. A row without one of its
tensors, or whose tensor hasn't the configured size, gives no child rows. `idx` is a child's place in its row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import action, ctc, decode, ocr, pose

KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
BOX = [("class_id", "int"), ("score", "double"), ("x", "int"), ("y", "int"), ("w", "int"), ("h", "int")]
POINT = [("person", "int"), ("point", "int"), ("px", "double"), ("py", "double"), ("ps", "double")]
CHILDREN = 1 << 16  #: child rows of a batch that goes back to Spark, or as many more as one row gives
BLOCK = 1 << 24  #: bytes of tensors that a kernel over many rows takes at once


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin and end."""
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), offsets


def child_batches(keys: list[str], tensors: list[str], fn: Callable, fields: list[tuple[str, str]]) -> Callable:
    """Batches of keys and tensors, none null, to batches of child rows; see `table_function`.

    A kernel may have a `block`: the values and ends of many rows' tensors -> how many children each row has, and an array for
    each field over all of them. It is given rows of BLOCK bytes at a time, or one row.
    """
    names = [*keys, "idx", *[n for n, _ in fields]]
    kinds = [pa.int64()] * len(keys) + [pa.int32()] + [KINDS[k] for _, k in fields]

    def batch(ids, rows, count, out):
        n = np.array(count, np.int64)
        cols = [np.repeat(k[rows], n) if len(rows) else k[:0] for k in ids] + [np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        cols += [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) if k == pa.string() else pa.array(c.astype(k.to_pandas_dtype(), copy=False)) for c, k in zip(cols, kinds)], names)

    def by_row(ids, data, rows):
        held, taken, count, out = 0, [], [], [[] for _ in fields]
        for i in range(rows):
            got = fn(*[v[o[i] : o[i + 1]] for v, o in data])
            if got is None or not len(got[0]):
                continue
            taken.append(i)
            count.append(len(got[0]))
            held += count[-1]
            for o, g in zip(out, got):
                o.append(g)
            if held >= CHILDREN:
                yield batch(ids, taken, count, out)
                held, taken, count, out = 0, [], [], [[] for _ in fields]
        yield batch(ids, taken, count, out)

    def by_block(ids, data, rows):
        for begin, end in pieces(sum(np.diff(o) for _, o in data), BLOCK // 8):
            count, got = fn.block(*[(v, o[begin : end + 1]) for v, o in data])
            yield batch(ids, np.arange(begin, end), count, [[g] for g in got])

    def run(batches):
        for b in batches:
            ids = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            data = [flat(b.column(len(keys) + i)) for i in range(len(tensors))]
            yield from (by_block if b.num_rows and hasattr(fn, "block") else by_row)(ids, data, b.num_rows)

    return run


def pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows, each of at most `most` in sum or of one row."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > most:
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(sizes))] if len(sizes) else out


def child_schema(keys: list[str], fields: list[tuple[str, str]]) -> str:
    return ", ".join([f"{k} long" for k in keys] + ["idx int"] + [f"{n} {k}" for n, k in fields])


def table_function(df: DataFrame, keys: list[str], tensors: list[str], fn: Callable, fields: list[tuple[str, str]]) -> DataFrame:
    """keys (as long), idx and `fields` of every child row; fn: a row's tensors -> one array for each field."""
    kept = df.where(" and ".join(f"{t} is not null" for t in [*keys, *tensors]))
    kept = kept.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.col(t).cast("array<double>") for t in tensors])
    return kept.mapInArrow(child_batches(keys, tensors, fn, fields), child_schema(keys, fields))


def _boxes(b: decode.Boxes) -> list[np.ndarray]:
    return [b.klass, b.score, *np.trunc(b.tlwh).T]


def _shaped(shapes, fn: Callable) -> Callable:
    """fn over tensors of these shapes; -1 stands for what is left. Other sizes give nothing."""

    def run(*flats):
        out = []
        for x, s in zip(flats, shapes):
            known = int(np.prod([d for d in s if d > 0]))
            if -1 in s and (not len(x) or len(x) % known) or -1 not in s and len(x) != known:
                return None
            out.append(x.reshape(s))
        return fn(*out)

    return run


def _whole(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray, shape: tuple) -> np.ndarray:
    """The first so many values of each row, one row behind the other, as `shape`."""
    if (sizes == np.diff(ends)).all():
        return values[ends[0] : ends[-1]].reshape(shape)
    return np.concatenate([values[:0], *[values[b : b + n] for b, n in zip(ends, sizes)]]).reshape(shape)


def _many_points(people: np.ndarray, points: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
    """_points of many rows, which have so many people each."""
    parts = scores.shape[1]
    person = np.arange(len(scores)) - np.repeat(np.cumsum(people) - people, people)
    return [np.repeat(person, parts), np.tile(np.arange(parts), len(scores)), points[..., 0].ravel(), points[..., 1].ravel(), scores.ravel()]


def _points(points: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
    """(people, parts, 2) and (people, parts) as child rows."""
    n, parts = scores.shape
    return [np.repeat(np.arange(n), parts), np.tile(np.arange(parts), n), points[..., 0].ravel(), points[..., 1].ravel(), scores.ravel()]


def yolov5(c: dict):
    run = decode.decode_v5 if c.get("version", 5) == 5 else decode.decode_v7
    more = {"size_gate": c.get("size_gate")} if c.get("version", 5) == 5 else {}
    return _shaped(c["shapes"], lambda *t: _boxes(run(list(t), c["src"], c["net"], c["conf"], c["iou"], **more))), BOX


def yolov8_detect(c: dict):
    return _shaped(c["shapes"], lambda t: _boxes(decode.decode_v8(t, c["src"], c["net"], c["conf"], c["iou"], c.get("clip_in_net", False)))), BOX


def yolov8_pose(c: dict):
    def run(t):
        k = decode.decode_v8_pose(t, c["src"], c["net"], c["conf"], c["iou"]).extra["keypoints"]
        return _points(k[..., :2], k[..., 2])

    return _shaped(c["shapes"], run), POINT


def yolov8_cls(c: dict):
    return _shaped(c["shapes"], lambda t: [np.array([t.argmax()]), np.array([t.max()])]), [("class_id", "int"), ("score", "double")]


def yolov8_seg(c: dict):
    def run(t, proto):
        b = decode.decode_v8_seg(t, proto, c["src"], c["net"], c["conf"], c["iou"], c.get("mask_threshold"))
        return [*_boxes(b), np.array([m.sum() for m in b.extra["mask"]], np.int64)]

    return _shaped(c["shapes"], run), [*BOX, ("area", "long")]


def yolov8_obb(c: dict):
    def run(t):
        b, s, k = decode.decode_v8_obb(t, c["src"], c["net"], c["conf"], c["iou"])
        return [k, s, *b.T]

    return _shaped(c["shapes"], run), [("class_id", "int"), ("score", "double"), ("cx", "double"), ("cy", "double"), ("bw", "double"), ("bh", "double"), ("angle", "double")]


def yolox(c: dict):
    return _shaped(c["shapes"], lambda t: _boxes(decode.decode_yolox(t, c["src"], c["net"], c["conf"], c["iou"], c.get("size_gate", (0, np.inf))))), BOX


def faces(c: dict):
    def run(loc, conf, marks):
        b = decode.decode_faces(loc, conf, marks, c["src"], c["conf"], c["iou"], c.get("max_face_count"))
        return [b.score, *b.tlwh.T, b.extra["points"][:, 2, 0], b.extra["points"][:, 2, 1]]

    return _shaped(c["shapes"], run), [("score", "double"), ("left", "double"), ("top", "double"), ("width", "double"), ("height", "double"), ("nose_x", "double"), ("nose_y", "double")]


def text_detect(c: dict):
    return _shaped(c["shapes"], lambda t: list(ocr.text_boxes(t, c["src"]).reshape(-1, 8).T)), [(f"{a}{i}", "int") for i in range(1, 5) for a in "xy"]


def text_beam(c: dict):
    def run(t):
        symbols, mean = ctc.beam_search(t, c.get("beam", 3))
        return [np.array(["".join(c["alphabet"][s] for s in symbols) or "###"], object), np.array([mean])]

    return _shaped(c["shapes"], run), [("text", "string"), ("confidence", "double")]


def openpose(c: dict):
    model = pose.COCO_18 if c.get("model") == "COCO_18" else pose.BODY_25

    def run(t):
        k = pose.assemble(t, model, scale=c.get("scale", 1.0))
        return _points(k[..., :2], k[..., 2])

    def block(tensor):
        values, ends = tensor
        good = np.diff(ends) == np.prod(shape)
        people, k = np.zeros(len(good), int), np.zeros((0, model["parts"], 3))
        if good.any():
            people[good], k = pose.assemble_many(_whole(values, ends, good * np.prod(shape), (-1, *shape)), model, scale=c.get("scale", 1.0))
        return people * model["parts"], _many_points(people, k[..., :2], k[..., 2])

    made, (shape,) = _shaped(c["shapes"], run), c["shapes"]
    if min(shape) > 0:
        made.block = block
    return made, POINT


def fastpose(c: dict):
    """Heat maps of all people of a frame, and their crops (x, y, w, h); poses after suppression."""

    def run(maps, crops):
        got = [pose.heatmap_points(m, tuple(k)) for m, k in zip(maps, crops)]
        kept = pose.pose_nms(np.array([p for p, _ in got]), np.array([s for _, s in got]), crops, c.get("min_area", 0.0), compat=c.get("compat", False))
        return _points(np.array([p for p, _ in kept]), np.array([s for _, s in kept])) if kept else None

    def block(tensor, crop):
        (values, ends), (boxes, box_ends) = tensor, crop
        size, box_size, known = np.diff(ends), np.diff(box_ends), int(np.prod(shape[1:]))
        n = np.where((size % known == 0) & (box_size % 4 == 0), np.minimum(size // known, box_size // 4), 0)
        maps, crops = _whole(values, ends, n * known, (-1, *shape[1:])), _whole(boxes, box_ends, n * 4, (-1, 4))
        points, scores = pose.heatmap_points_many(maps, crops)
        at, points, scores = pose.pose_nms_many(points, scores, crops, np.repeat(np.arange(len(n)), n), c.get("min_area", 0.0))
        people = np.bincount(at, minlength=len(n))
        return people * shape[1], _many_points(people, points, scores)

    made, shape = _shaped(c["shapes"], run), c["shapes"][0]
    if shape[0] == -1 and min(shape[1:]) > 0 and shape[1] < 133 and tuple(c["shapes"][1]) == (-1, 4):
        made.block = block
    return made, POINT


def posec3d(c: dict):
    """A window's poses (frames, joints, x y score) to its clips' volumes: each joint's place of the greatest heat in each clip's frames."""

    def run(t):
        at, heat, side = action.clip_heat(t[:, None, :, :2], t[:, None, :, 2], c["src"])
        clip, joint, step = np.meshgrid(*map(np.arange, at.shape), indexing="ij")
        at = at.ravel()
        return [clip.ravel(), joint.ravel(), step.ravel(), at % side, at // side, heat.ravel()]

    return _shaped(c["shapes"], run), [("clip", "int"), ("joint", "int"), ("step", "int"), ("hx", "int"), ("hy", "int"), ("heat", "double")]


YOLOV8_TASKS = {"Detect": yolov8_detect, "Pose": yolov8_pose, "Cls": yolov8_cls, "Seg": yolov8_seg, "Obb": yolov8_obb}
#: By element name, the decoder and the relation its rows make; those of yolov8 go by task_type.
ELEMENTS: dict[str, tuple[Callable, str]] = {
    "yolov5": (yolov5, "detections"), "yolov7": (lambda c: yolov5({**c, "version": 7}), "detections"), "yolox": (yolox, "detections"), "retinaface": (faces, "faces"),
    "ppocr_det": (text_detect, "outlines"), "ppocr_rec": (text_beam, "recognitions"), "openpose": (openpose, "poses"), "fastpose": (fastpose, "poses"), "posec3d": (posec3d, "clips"),
}
TASK_RELATIONS = {"Detect": "detections", "Pose": "poses", "Cls": "recognitions", "Seg": "segments", "Obb": "obbs"}


def of_element(name: str, config: dict) -> tuple[Callable, list[tuple[str, str]], str]:
    """Kernel, fields and relation of a model element; KeyError for an element or task without a decoder."""
    if name == "yolov8":
        task = config.get("task_type", "Detect")
        return *YOLOV8_TASKS[task](config), TASK_RELATIONS[task]
    make, relation = ELEMENTS[name]
    return *make(config), relation
