"""The stateful operators over streams: gating, throttling, tracking, convergence, count windows.

Each keeps one state a key and gives the rows its batch form gives when frames of a key arrive in order. With `ttl_ms`, the
state of a key that stays silent so long is dropped; without, it is kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.tracking import TRACK_SCHEMA, Tracker, TrackerConfig, track_frame



def _timeout(ttl_ms: int | None) -> str:
    """Processing-time time-outs keep a query running, so one over finite input (availableNow) must do without."""
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _touch(state: GroupState, ttl_ms: int | None) -> None:
    if ttl_ms is not None:
        state.setTimeoutDuration(ttl_ms)


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order, kind="stable")


def gate_alerts(stream: DataFrame, first: int, skip: int, ttl_ms: int | None = None) -> DataFrame:
    """task_id, frame_id, det_idx, track_id, run of the detections that a gating rule lets through."""
    def step(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        runs: dict[int, int] = pickle.loads(state.get[0]) if state.exists else {}
        out = []
        for frame, rows in _rows(parts, ["frame_id", "det_idx"]).groupby("frame_id", sort=True):
            ids = rows.track_id[rows.track_id >= 0]
            runs = {int(i): runs.get(int(i), 0) + 1 for i in set(ids)}
            for r in rows.itertuples():
                n = runs.get(r.track_id, 0)
                if n > first and (n - first - 1) % max(skip, 1) == 0:
                    out.append((key[0], frame, r.det_idx, r.track_id, n))
        state.update((pickle.dumps(runs),))
        _touch(state, ttl_ms)
        yield pd.DataFrame(out, columns=["task_id", "frame_id", "det_idx", "track_id", "run"])

    rows = stream.select("task_id", "frame_id", "det_idx", "track_id")
    return rows.groupBy("task_id").applyInPandasWithState(step, "task_id long, frame_id long, det_idx int, track_id long, run long", "s binary", "append", _timeout(ttl_ms))


def throttle(stream: DataFrame, seconds: float, ttl_ms: int | None = None) -> DataFrame:
    """task_id, frame_id of the frames at which a time rule fires; event time, as in batch."""
    gap = int(seconds * 1_000_000)

    def step(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for r in _rows(parts, ["t", "frame_id"]).itertuples():
            if last is None or r.t - last > gap:
                last = int(r.t)
                out.append((key[0], r.frame_id))
        if last is not None:
            state.update((last,))
            _touch(state, ttl_ms)
        yield pd.DataFrame(out, columns=["task_id", "frame_id"])

    rows = stream.where("ts is not null").select("task_id", "frame_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.groupBy("task_id").applyInPandasWithState(step, "task_id long, frame_id long", "last long", "append", _timeout(ttl_ms))


def track(stream: DataFrame, config: TrackerConfig | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Tracks of a stream of frames joined with their boxes (one row without det_idx where a frame has none).

    A frame must come whole in one micro-batch; the tracker is the state of its stream.
    """
    settings = config or TrackerConfig()
    names = [c.split()[0] for c in TRACK_SCHEMA.split(", ")]
    fields = ["det_idx", "class_id", "score", "x", "y", "w", "h", "width", "height"]

    def step(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(settings)
        out = []
        for frame, rows in _rows(parts, ["frame_id", "det_idx"]).groupby("frame_id", sort=True):
            values = rows[fields].astype(object).where(rows[fields].notna(), None)
            out += track_frame(tracker, key[0], frame, [tuple(v) for v in values.itertuples(index=False)])
        state.update((pickle.dumps(tracker),))
        _touch(state, ttl_ms)
        yield pd.DataFrame(out, columns=names)

    rows = stream.select("task_id", "frame_id", *fields)
    return rows.groupBy("task_id").applyInPandasWithState(step, TRACK_SCHEMA, "s binary", "append", _timeout(ttl_ms))


def converge(main: DataFrame, branches: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """task_id, frame_id, error_code: frames in order once all their branches came.

    A frame that still lacks branches `wait_ms` after its stream last moved is let go with error code 2, and those behind
    it follow; the reference point is processing time, so a lost branch can't stall a stream for ever.
    """
    def step(key, parts, state: GroupState):
        waiting, got = pickle.loads(state.get[0]) if state.exists else ({}, {})
        out = []
        if not state.hasTimedOut:
            for r in pd.concat(list(parts)).itertuples():
                if r.branches >= 0:
                    waiting[r.frame_id] = int(r.branches)
                else:
                    got[r.frame_id] = got.get(r.frame_id, 0) + 1
        late = state.hasTimedOut
        for f in sorted(waiting):
            if got.get(f, 0) < waiting[f] and not late:
                break
            out.append((key[0], f, 0 if got.get(f, 0) >= waiting[f] else 2))
        for _, f, _ in out:
            waiting.pop(f)
            got.pop(f, None)
        if waiting or got and not late:
            state.update((pickle.dumps((waiting, got)),))
            _touch(state, wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["task_id", "frame_id", "error_code"])

    rows = main.select("task_id", "frame_id", F.col("branches").cast("int")).unionByName(branches.select("task_id", "frame_id", F.lit(-1).alias("branches")))
    return rows.groupBy("task_id").applyInPandasWithState(step, "task_id long, frame_id long, error_code int", "s binary", "append", _timeout(wait_ms))


def count_windows(stream: DataFrame, size: int, ttl_ms: int | None = None) -> DataFrame:
    """task_id, frame_id, window_id: a stream's frames in order, `size` at a time."""
    def step(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = _rows(parts, ["frame_id"])
        ids = (n + pd.RangeIndex(len(rows))) // size
        state.update((n + len(rows),))
        _touch(state, ttl_ms)
        yield pd.DataFrame({"task_id": key[0], "frame_id": rows.frame_id.to_numpy(), "window_id": ids.to_numpy()})

    return stream.select("task_id", "frame_id").groupBy("task_id").applyInPandasWithState(step, "task_id long, frame_id long, window_id long", "n long", "append", _timeout(ttl_ms))


def windowed_rates(stream: DataFrame, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Frames of each channel and window of event time; rows later than `late` are dropped."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("channel_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n_frames")).select("channel_id", F.col("window.start").alias("window_start"), "n_frames")
