"""Model slots: pre-processing, inference given by the caller, post-processing, over Arrow batches of raw frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.functions.decode import Boxes

DETECTIONS = "task_id long, frame_id long, det_idx int, class_id int, score double, x int, y int, w int, h int"


@dataclass
class ModelSpec:
    """pre: image -> input; infer: batch of inputs -> list of outputs, one an image; post: output, (width, height) -> Boxes."""

    pre: Callable[[np.ndarray], np.ndarray]
    infer: Callable[[np.ndarray], list]
    post: Callable[[object, tuple[int, int]], Boxes]
    max_batch: int = 16


def detect(frames: DataFrame, spec: ModelSpec, image: str = "image") -> DataFrame:
    """Detections of frames with raw images (height x width x 3 bytes); frames without a whole image give none."""
    names = [c.split()[0] for c in DETECTIONS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()] + [pa.int32()] * 4

    def run(batches):
        for b in batches:
            rows = [r for r in zip(*[b.column(i).to_pylist() for i in range(5)]) if r[4] is not None and r[2] and r[3] and len(r[4]) == r[2] * r[3] * 3]
            out = []
            for at in range(0, len(rows), spec.max_batch):
                some = rows[at : at + spec.max_batch]
                inputs = np.stack([spec.pre(np.frombuffer(r[4], np.uint8).reshape(r[3], r[2], 3)) for r in some])
                for r, o in zip(some, spec.infer(inputs)):
                    found = spec.post(o, (r[2], r[3]))
                    out += [(r[0], r[1], i, int(k), float(s), *map(int, t)) for i, (t, s, k) in enumerate(zip(found.tlwh, found.score, found.klass))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    return frames.select("task_id", "frame_id", "width", "height", image).mapInArrow(run, DETECTIONS)
