"""A compiled graph over a stream: one stateful operator that takes each stream's frames, whole and in order, through the elements.

The elements' memories (tracker, run counters, trajectories, throttles) live in the state of their stream for as long as the
query does, so a graph over any number of micro-batches gives what its batch plan gives. A frame comes with its boxes:

    task_id long, frame_id long, channel_id int, ts timestamp, width int, height int, eos boolean,
    boxes array<struct<det_idx int, class_id int, score double, x int, y int, w int, h int, track_id long>>

Frames of a stream must arrive in order; between streams there is none. A micro-batch's rows of a stream are held at once, so
its size (maxFilesPerTrigger and the like) bounds the memory.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.functions import decode
from strandline.operators.rules import DAY_MS, Rule
from strandline.operators.tracking import Tracker, TrackerConfig, track_frame
from strandline.plans import graph as G

BOX = "det_idx int, class_id int, score double, x int, y int, w int, h int, track_id long"
_STRUCT = f"array<struct<{','.join(c.replace(' ', ':') for c in BOX.split(', '))}>>"
OUT = f"task_id long, frame_id long, tag int, branches int, boxes {_STRUCT}"
FIELDS = [c.split()[0] for c in BOX.split(", ")]


def with_boxes(frames: DataFrame, det: DataFrame) -> DataFrame:
    """Frames with their detections as an array, in order of det_idx."""
    det = det if "track_id" in det.columns else det.withColumn("track_id", F.lit(-1).cast("long"))
    kinds = dict(f.split() for f in BOX.split(", "))
    boxes = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in FIELDS]))).alias("boxes")
    rows = frames.join(det.groupBy("task_id", "frame_id").agg(boxes), ["task_id", "frame_id"], "left")
    return rows.select("task_id", "frame_id", "channel_id", F.col("ts").cast("timestamp").alias("ts"), "width", "height", F.coalesce("eos", F.lit(False)).alias("eos"), "boxes")


def _turn(p, q, r) -> int:
    v = (q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1])
    return (v > 0) - (v < 0)


def _on(p, q, r) -> bool:
    return min(p[0], r[0]) <= q[0] <= max(p[0], r[0]) and min(p[1], r[1]) <= q[1] <= max(p[1], r[1])


def _meet(a, b, c, d) -> bool:
    o = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return o[0] != o[1] and o[2] != o[3] or o[0] == 0 and _on(a, c, b) or o[1] == 0 and _on(a, d, b) or o[2] == 0 and _on(c, a, d) or o[3] == 0 and _on(c, b, d)


def in_area(x: int, y: int, w: int, h: int, area) -> bool:
    """As `geometry.box_in_area`, of one box."""
    if not area:
        return True
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    sides, around = list(zip(corners, corners[1:] + corners[:1])), list(zip(area, area[1:] + area[:1]))
    touch = any(_meet(a, b, p, q) for a, b in sides for p, q in around)
    if len(area) < 3:
        return touch or any(x <= px <= x + w and y <= py <= y + h for px, py in area)
    far = 2147483647
    return not touch and all(sum(_meet(p, q, c, (far, c[1])) for p, q in around) % 2 for c in corners)


class Gate:
    """One rule of a filter: its predicates in order, its run counters and its trajectories."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.runs: dict[int, int] = {}
        self.seen: dict[int, tuple[int, float, float]] = {}  # track -> its rows so far, its last evaluated centre

    def _moves(self, left) -> bool:
        hit = False
        for b in left:
            n, cx, cy = self.seen.get(b["track_id"], (0, None, None))
            if n % self.rule.trajectory_interval == 0:
                x, y = b["x"] + b["w"] // 2, b["y"] + b["h"] // 2
                hit |= cx is not None and (x - cx) * self.rule.direction[0] + (y - cy) * self.rule.direction[1] >= 0
                cx, cy = x, y
            self.seen[b["track_id"]] = (n + 1, cx, cy)
        return hit

    def passes(self, frame: dict) -> bool:
        r = self.rule
        if frame["ts"] is None or not any(a <= frame["ts"] // 1000 % DAY_MS <= b for a, b in r.times):
            return False
        left = [b for b in frame["boxes"] if b["class_id"] in r.classes and any(in_area(b["x"], b["y"], b["w"], b["h"], a) for a in r.areas)]
        if r.kind == 1 and r.direction != (0.0, 0.0) and not self._moves(left):
            return False
        if r.kind != 1 or not left:
            return bool(left)
        self.runs = {i: self.runs.get(i, 0) + 1 for i in {b["track_id"] for b in left if b["track_id"] >= 0}}
        return any(n > r.alert_first and (n - r.alert_first - 1) % max(r.alert_skip, 1) == 0 for n in self.runs.values())


class Decode:
    def __init__(self, c: dict):
        self.step, self.keep = int(c.get("sample_interval", 1)), c.get("sample_strategy", "DROP") != "DROP"

    def __call__(self, frame):
        return frame if self.keep or frame["frame_id"] % self.step == 0 or frame["eos"] else None


class Detector:
    def __init__(self, name: str, c: dict):
        self.thr, self.iou, self.aware, self.plus = c.get("threshold_conf", 0.0), c.get("threshold_nms"), name.startswith(("yolov5", "yolov8")), int(name.startswith("retinaface"))
        if isinstance(self.thr, dict):
            self.thr = {int(k): float(v) for k, v in self.thr.items()}

    def __call__(self, frame):
        limit = lambda b: self.thr.get(b["class_id"], float("inf")) if isinstance(self.thr, dict) else float(self.thr)
        boxes = [b for b in frame["boxes"] if b["score"] is not None and b["score"] > limit(b)]
        if self.iou is not None and boxes:
            k = np.array([b["class_id"] or 0 for b in boxes])
            all_ = decode.Boxes(np.array([[b[c] for c in "xywh"] for b in boxes], float), np.array([b["score"] for b in boxes]), np.arange(len(boxes)))
            kept = set(decode.nms(all_, float(self.iou), k * decode.CLASS_OFFSET if self.aware else None, self.plus).klass.tolist())
            boxes = [b for i, b in enumerate(boxes) if i in kept]
        return {**frame, "boxes": boxes}


class Track:
    def __init__(self, c: dict):
        self.tracker = Tracker(TrackerConfig(**{k: v for k, v in c.items() if k in TrackerConfig.__dataclass_fields__}))

    def __call__(self, frame):
        rows = [(b["det_idx"], b["class_id"], b["score"], b["x"], b["y"], b["w"], b["h"], frame["width"], frame["height"]) for b in frame["boxes"]] or [(None,) * 7 + (frame["width"], frame["height"])]
        shown = sorted(track_frame(self.tracker, frame["task_id"], frame["frame_id"], rows), key=lambda r: r[2])
        return {**frame, "boxes": [dict(zip(FIELDS, (i, k, s, x, y, w, h, tid))) for i, (_, _, tid, _, x, y, w, h, k, s) in enumerate(shown)]}


class Filter:
    def __init__(self, c: dict):
        self.gates = {int(e["channel_id"]): [Gate(G.rule_of(x)) for x in e["filters"]] for e in c.get("rules", [])}

    def __call__(self, frame):
        gates = self.gates.get(frame["channel_id"])
        tag = 0
        for i, g in enumerate(gates or ()):
            tag |= g.passes(frame) << i
        return {**frame, "tag": tag} if tag or gates is None or frame["eos"] else None


class Distribute:
    """Which branches a frame has; they come back at once, so a converger behind has nothing to wait for."""

    def __init__(self, c: dict):
        self.rules, self.last = G.route_rules(c), {}

    def __call__(self, frame, names: dict[int, str]):
        rows = set()
        for i, r in enumerate(self.rules):
            if r.time_interval is not None:
                at = frame["ts"]
                fires = at is not None and (i not in self.last or at - self.last[i] > int(r.time_interval * 1_000_000))
                if fires:
                    self.last[i] = at
            else:
                fires = frame["frame_id"] % r.interval() == 0 or frame["eos"]
            if fires:
                ports = {c: x.port for x in r.routes for c in x.classes}
                rows |= {(-1, x.port) for x in r.routes if not x.classes}
                rows |= {(n, ports[names.get(b["class_id"])]) for n, b in enumerate(frame["boxes"]) if names.get(b["class_id"]) in ports}
        return {**frame, "branches": len(rows)}


#: Elements that leave frames and boxes as they are.
PASS = {"blank", "converger", "osd", "encode", "http_push", "qt_display"}


def chain(g: G.Graph) -> list[tuple[int, str, dict]]:
    """The elements on the way from source to sink along default ports; branches of a distributor come back to it."""
    out = []
    for i in G.validate(g):
        e = g.elements[i]
        fed = [x for x in g.edges if x.dst == i]
        behind = e.sources or any(x.src in [o[0] for o in out] and x.src_port == int(g.elements[x.src].configure.get("default_port", 0)) for x in fed)
        if behind:
            name = e.name.removesuffix("_group")
            if name not in PASS | {"decode", "yolov5", "yolov7", "yolov8", "yolox", "retinaface", "bytetrack", "filter", "distributor"}:
                raise G.ConfigError(f"{e.name} (element {i}) has no form over streams with state")
            out.append((i, name, e.configure))
    return out


def _make(name: str, c: dict):
    if name in ("yolov5", "yolov7", "yolov8", "yolox", "retinaface"):
        return Detector(name, c)
    return {"decode": Decode, "bytetrack": Track, "filter": Filter, "distributor": Distribute}[name](c)


def compile_stream(g: G.Graph, boxed: DataFrame, names: dict[int, str] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """task_id, frame_id, tag, branches, boxes of the frames that reach the sink. `names`: the dictionary a distributor needs.

    With `ttl_ms` the state of a stream that stays silent so long is dropped.
    """
    steps = [(i, n, c) for i, n, c in chain(g) if n not in PASS]
    names = names or {}

    def step(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        elements = pickle.loads(state.get[0]) if state.exists else [_make(n, c) for _, n, c in steps]
        rows = pd.concat(list(parts)).sort_values("frame_id", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            known = lambda v: None if v is None or v != v else int(v)
            boxes = [] if r.boxes is None else [dict(b) if isinstance(b, dict) else b.asDict() for b in r.boxes]
            frame = {"task_id": key[0], "frame_id": int(r.frame_id), "channel_id": known(r.channel_id), "ts": known(r.t), "width": known(r.width), "height": known(r.height), "eos": bool(r.eos), "boxes": boxes, "tag": 0, "branches": 0}
            for e in elements:
                frame = e(frame, names) if isinstance(e, Distribute) else e(frame)
                if frame is None:
                    break
            if frame is not None:
                out.append((key[0], frame["frame_id"], frame["tag"], frame["branches"], frame["boxes"]))
        state.update((pickle.dumps(elements),))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["task_id", "frame_id", "tag", "branches", "boxes"])

    rows = boxed.select("task_id", "frame_id", "channel_id", F.unix_micros("ts").alias("t"), "width", "height", "eos", "boxes")
    return rows.groupBy("task_id").applyInPandasWithState(step, OUT, "s binary", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
