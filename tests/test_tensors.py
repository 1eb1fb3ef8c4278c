"""Model outputs at size: what a kernel or a batch holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strandline.functions import action, pose
from strandline.operators import decoders as M
from strandline.plans import tensors as T


def held(run) -> float:
    """The most MB that `run` allocates at once."""
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_clips_hold_each_frame_once():
    rng = np.random.default_rng(3)
    for n in (1, 9, 24, 60, 130):
        p, s = rng.random((n, 2, 3, 2)) * 400, rng.random((n, 2, 3))
        v = action.action_input(p, s, (640, 480))[0]
        v = v.reshape(*v.shape[:3], -1)
        at, heat, side = action.clip_heat(p, s, (640, 480))
        assert (v.argmax(3) == at).all() and (v.max(3) == heat).all() and side == 64
    fn, _ = M.posec3d({"src": (640, 640), "shapes": [(-1, 4, 3)]})
    window = np.tile([100, 100, 0.9, 420, 100, 0.9, 100, 420, 0.9, 420, 420, 0.9], 24)
    assert len(fn(window)[0]) == action.CLIPS * 4 * action.CLIP
    assert held(lambda: fn(window)) < 40


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def packed(frames: int, boxes: int) -> pa.RecordBatch:
    """A batch as T.packed gives it to Python."""
    cols = {"det_idx": np.arange(boxes), "x": 7 * np.arange(boxes), "y": 9 * np.arange(boxes), "w": np.full(boxes, 5), "h": np.full(boxes, 6), "score": np.full(boxes, 0.7), "class_id": np.arange(boxes) % 5}
    return pa.RecordBatch.from_arrays([pa.array(np.full(frames, 3)), pa.array(np.arange(frames)), *[lists([cols[c].astype(float)] * frames) for c in T.COLUMNS]], [*T.FRAME, *T.COLUMNS])


def by_rows(made):
    """The same kernel without its block."""
    fn, fields = made
    return (lambda *t: fn(*t)), fields


def children(made, batch: pa.RecordBatch, tensors: int) -> list[tuple]:
    run = M.child_batches(["id"], [f"t{i}" for i in range(tensors)], *made)
    return [tuple(round(x, 9) for x in r.values()) for b in run([batch]) for r in b.to_pylist()]


def same(made, batch: pa.RecordBatch, tensors: int) -> int:
    assert hasattr(made[0], "block")
    got = children(made, batch, tensors)
    assert got == children(by_rows(made), batch, tensors)
    return len(got)


def test_tensors_in_bounded_batches():
    """Ten thousand frames are one batch of Spark's; their maps are not."""
    got = [b.nbytes for b in T._planted(T.FRAME, T._heat, 2)([packed(2400, 5)])]
    assert len(got) > 5 and max(got) < 2 * M.BLOCK
    made = M.fastpose({"shapes": [(-1, 17, 16, 12), (-1, 4)]})
    read = M.child_batches(T.FRAME, ["t0", "t1"], *made)
    count = []
    assert held(lambda: count.extend(b.num_rows for b in read(T._planted(T.FRAME, T._heat, 2)([packed(2400, 5)])))) < 160 and sum(count) == 2400 * 5 * 17


def test_crops_in_blocks_as_by_rows():
    rng = np.random.default_rng(5)
    for spread in (1, 20, 400):
        n = [4, 1, 0, 6, 3, 5, 2, 8]
        maps = [rng.random((k, 17, 16, 12)).ravel() * (0.2 if i == 3 else 1.0) for i, k in enumerate(n)]
        crops = [np.stack([rng.random(k) * spread, rng.random(k) * spread, np.full(k, 48.0), np.full(k, 64.0)], 1).ravel() for k in n]
        maps[1][:] = 0  # nothing found
        maps[4], crops[5], crops[6] = maps[4][:-1], crops[5][:-4], np.append(crops[6], crops[6][:4])  # not of the size; a crop short; a crop more
        assert same(M.fastpose({"shapes": [(-1, 17, 16, 12), (-1, 4)]}), pa.RecordBatch.from_arrays([pa.array(range(8)), lists(maps), lists(crops)], ["id", "t0", "t1"]), 2) > 17


def test_people_in_blocks_as_by_rows():
    rng = np.random.default_rng(6)
    for model, channels in (("BODY_25", 78), ("COCO_18", 57)):
        made, shape = M.openpose({"model": model, "shapes": [(channels, 16, 16)], "scale": 8.0}), (channels, 16, 16)
        parts = getattr(pose, model)["parts"]
        for fields in (lambda: rng.random(shape) + 0.2, lambda: rng.choice([0.5, 1.0, -0.2], (channels, 1, 1)), lambda: rng.random((1, 16, 16)) * 2 - 0.3):
            maps = [np.zeros(shape) + fields() for _ in range(5)]
            for m in maps[:4]:
                m[:parts] = np.where(rng.random((parts, 16, 16)) < 0.01, rng.choice([0.3, 0.9, 0.9], (parts, 16, 16)), 0)  # ties, none and several a part
            maps[2] = maps[2].ravel()[:-1]  # not of the size
            assert same(made, pa.RecordBatch.from_arrays([pa.array(range(5)), lists([m.ravel() for m in maps])], ["id", "t0"]), 1) > parts
    made = M.openpose({"shapes": [(78, 16, 16)], "scale": 8.0})
    read, count = M.child_batches(T.FRAME, ["t0"], *made), []
    assert held(lambda: count.extend(b.num_rows for b in read(T._planted(T.FRAME, T._body, 1)([packed(2400, 2)])))) < 160 and sum(count) == 2400 * 25
