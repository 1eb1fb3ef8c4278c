"""Multi-object tracking of a stream: two rounds of assignment by IoU over predicted boxes.

A stream's frames are read in order by one task with the tracker as its only state, so its length doesn't matter; streams
are spread over the cluster. Ids count from 1 in each stream, whatever else runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.assignment import assign
from strandline.functions.motion import Motion, box, iou_matrix, measure

TRACKED, LOST = 1, 2
#: Least score of a detection, limits of the second and the unconfirmed round, distance of duplicates, class offset.
LEAST_SCORE, SECOND, UNCONFIRMED, DUPLICATE, CLASS_OFFSET = 0.1, 0.5, 0.7, 0.15, 7000


@dataclass
class TrackerConfig:
    track_thresh: float = 0.5
    high_thresh: float = 0.6
    match_thresh: float = 0.7
    min_box_area: float = 10
    frame_rate: float = 30
    track_buffer: int = 30
    correct_box: bool = True
    agnostic: bool = True

    def keep_lost(self) -> int:
        return int(self.frame_rate / 30.0 * self.track_buffer)


class Tracker:
    """Tracks as parallel arrays: motion, shown box, id, state, confirmed, first and last frame, class, score, detection."""

    COLUMNS = ("tid", "state", "sure", "first", "last", "klass", "score", "det")

    def __init__(self, config: TrackerConfig | None = None):
        self.c = config or TrackerConfig()
        self.frame, self.count = 0, 0
        self.motion, self.shown = Motion(np.zeros((0, 4))), np.zeros((0, 4))
        for name in self.COLUMNS:
            setattr(self, name, np.zeros(0, np.float64 if name == "score" else np.int64))

    def _keep(self, rows: np.ndarray) -> None:
        self.motion, self.shown = self.motion.take(rows), self.shown[rows]
        for name in self.COLUMNS:
            setattr(self, name, getattr(self, name)[rows])

    def _match(self, rows: np.ndarray, dets: np.ndarray, tlwh: np.ndarray, limit: float):
        pairs, left_rows, left_dets = assign(1 - iou_matrix(self.shown[rows], tlwh[dets]), limit)
        r = rows[[i for i, _ in pairs]] if pairs else rows[:0]
        d = dets[[j for _, j in pairs]] if pairs else dets[:0]
        return r, d, rows[left_rows], dets[left_dets]

    def _see(self, rows: np.ndarray, dets: np.ndarray, tlwh: np.ndarray, score: np.ndarray) -> None:
        if not len(rows):
            return
        if self.c.correct_box:
            self.motion.correct(rows, measure(tlwh[dets]))
            self.shown[rows] = box(self.motion.take(rows).pos)
        else:
            self.shown[rows] = tlwh[dets]
        self.state[rows], self.sure[rows], self.last[rows] = TRACKED, 1, self.frame
        self.score[rows], self.det[rows] = score[dets], dets

    def update(self, tlwh: np.ndarray, score: np.ndarray, klass: np.ndarray) -> list[tuple[int, int, np.ndarray, int, float]]:
        """One frame's boxes. Returns (id, index of the box seen, shown box, class, score) of the tracks it shows."""
        self.frame += 1
        self.det[:] = -1
        tlwh = np.asarray(tlwh, np.float64).reshape(-1, 4).copy()
        score, klass = np.asarray(score, np.float64), np.asarray(klass, np.int64)
        if not self.c.agnostic:
            tlwh[:, :2] += (klass * CLASS_OFFSET)[:, None]
        usable = (score > LEAST_SCORE) & (tlwh[:, 3] > 0)
        strong = np.flatnonzero(usable & (score >= self.c.track_thresh))
        weak = np.flatnonzero(usable & (score < self.c.track_thresh))
        was_tracked = self.state == TRACKED
        unsure = np.flatnonzero(was_tracked & (self.sure == 0))
        pool = np.concatenate([np.flatnonzero(was_tracked & (self.sure == 1)), np.flatnonzero(self.state == LOST)])
        if len(pool):
            self.motion.predict(pool, self.state[pool] == TRACKED)
        r, d, alone, strong = self._match(pool, strong, tlwh, self.c.match_thresh)
        self._see(r, d, tlwh, score)
        r, d, alone, _ = self._match(alone[self.state[alone] == TRACKED], weak, tlwh, SECOND)
        self._see(r, d, tlwh, score)
        just_lost = alone
        self.state[just_lost] = LOST
        r, d, gone, strong = self._match(unsure, strong, tlwh, UNCONFIRMED)
        self._see(r, d, tlwh, score)
        born = strong[score[strong] >= self.c.high_thresh]
        expired = np.flatnonzero((self.state == LOST) & (self.frame - self.last > self.c.keep_lost()))
        expired = np.setdiff1d(expired, just_lost)
        self._keep(np.setdiff1d(np.arange(len(self.tid)), np.concatenate([gone, expired])))
        if len(born):
            self.motion = Motion.join([self.motion, Motion(measure(tlwh[born]))])
            self.shown = np.concatenate([self.shown, tlwh[born]])
            n = len(born)
            new = {"tid": self.count + 1 + np.arange(n), "state": np.full(n, TRACKED), "sure": np.full(n, int(self.frame == 1)), "first": np.full(n, self.frame), "last": np.full(n, self.frame), "klass": klass[born], "score": score[born], "det": born}
            for name, values in new.items():
                setattr(self, name, np.concatenate([getattr(self, name), values]))
            self.count += n
        self._drop_duplicates()
        shown = np.flatnonzero((self.state == TRACKED) & (self.sure == 1) & (self.shown[:, 2] * self.shown[:, 3] > self.c.min_box_area))
        return [(int(self.tid[i]), int(self.det[i]), self._frame_box(i), int(self.klass[i]), float(self.score[i])) for i in shown]

    def _frame_box(self, i: int) -> np.ndarray:
        b = self.shown[i].copy()
        b[:2] = np.maximum(b[:2], 0)
        if not self.c.agnostic:
            b[:2] -= self.klass[i] * CLASS_OFFSET
        return b

    def _drop_duplicates(self) -> None:
        """Of a tracked and a lost track at nearly one place, the longer-lived stays; of equals the lost one."""
        a, b = np.flatnonzero(self.state == TRACKED), np.flatnonzero(self.state == LOST)
        if not len(a) or not len(b):
            return
        i, j = np.nonzero(1 - iou_matrix(self.shown[a], self.shown[b]) < DUPLICATE)
        if len(i):
            life = self.last - self.first
            longer = life[a[i]] > life[b[j]]
            self._keep(np.setdiff1d(np.arange(len(self.tid)), np.concatenate([b[j][longer], a[i][~longer]])))


TRACK_SCHEMA = "task_id long, frame_id long, track_id long, det_idx int, x int, y int, w int, h int, class_id int, score double"


def _emit(rows):
    names = [c.split()[0] for c in TRACK_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 6 + [pa.float64()]
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def track_frame(tracker: Tracker, task, frame, rows) -> list[tuple]:
    """Rows: (det_idx, class_id, score, x, y, w, h, width, height) of one frame in order."""
    boxes = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None]
    shown = tracker.update([r[3:7] for r in boxes], [r[2] for r in boxes], [r[1] for r in boxes])
    width, height = (rows[0][7] or 0, rows[0][8] or 0) if rows else (0, 0)
    out = []
    for tid, det, b, k, s in shown:
        x, y = int(b[0]), int(b[1])
        w = int(b[2]) if not width or x + b[2] < width else width - x
        h = int(b[3]) if not height or y + b[3] < height else height - y
        out.append((task, frame, tid, boxes[det][0] if det >= 0 else None, x, y, w, h, k, s))
    return out


def track(frames: DataFrame, det: DataFrame, config: TrackerConfig | None = None) -> DataFrame:
    """Tracked boxes of every frame; det_idx is the detection a track was matched to. Frames without boxes age the tracks.

    Detections without score or class take no part; repeated rows must be dropped before.
    """
    settings = config or TrackerConfig()
    rows = frames.select("task_id", "frame_id", "width", "height").join(det.select("task_id", "frame_id", "det_idx", "class_id", "score", "x", "y", "w", "h"), ["task_id", "frame_id"], "left")
    ordered = rows.select("task_id", "frame_id", "det_idx", "class_id", "score", "x", "y", "w", "h", "width", "height").repartition("task_id").sortWithinPartitions("task_id", "frame_id", "det_idx")

    def run(batches):
        task = at = tracker = None
        held, out = [], []
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                if (row[0], row[1]) != (task, at):
                    if held:
                        out += track_frame(tracker, task, at, held)
                    if row[0] != task:
                        tracker = Tracker(settings)
                    task, at, held = row[0], row[1], []
                held.append(row[2:])
            if out:
                yield _emit(out)
                out = []
        if held:
            yield _emit(track_frame(tracker, task, at, held))

    return ordered.mapInArrow(run, TRACK_SCHEMA)
