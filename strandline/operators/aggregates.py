"""Counts, rates and reports, and the small array aggregates of model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_totals(frames: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Frames, elapsed seconds and frames a second of each group; frames without a time count but don't stretch it."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    g = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), ((F.max(at) - F.min(at)) / 1e6).alias("seconds"))
    return g.withColumn("fps", F.when(F.col("seconds") > 0, F.round(F.col("n_frames") / F.col("seconds"), 6))).withColumn("seconds", F.round("seconds", 6))


def windowed_rates(frames: DataFrame, stream: list[str], every: int = 100) -> DataFrame:
    """Elapsed rate of each block of `every` frames of a stream (block = frame_id div every): count over elapsed seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    g = frames.where("ts is not null").groupBy(*stream, F.floor(F.col("frame_id") / every).alias("block")).agg(F.count(F.lit(1)).alias("n"), ((F.max(at) - F.min(at)) / 1e6).alias("s"))
    return g.where("s > 0").select(*stream, "block", "n", F.round(F.col("n") / F.col("s"), 6).alias("rate"))


def moving_rate(rates: DataFrame, stream: list[str], keep: float = 0.9) -> DataFrame:
    """The profiler's moving average of a stream's block rates in order: avg = keep * avg + (1 - keep) * rate, from the first.

    A stream has one row a block, so the fold's array is short; it stays in the JVM.
    """
    ordered = rates.groupBy(*stream).agg(F.sort_array(F.collect_list(F.struct("block", "rate"))).alias("r"))
    tail = F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0)))
    ema = F.aggregate(tail, F.col("r")[0]["rate"], lambda a, x: a * keep + x["rate"] * (1 - keep))
    return ordered.select(*stream, F.size("r").alias("blocks"), F.round(ema, 3).alias("ema"))


def argmax(values: Column, floor: float | None = 0.0) -> Column:
    """Index of the first greatest value; with `floor`, 0 where nothing exceeds it. Null for an empty array."""
    best = F.array_max(values)
    at = (F.array_position(values, best) - 1).cast("int")
    return F.when(F.size(values) > 0, at if floor is None else F.when(best > floor, at).otherwise(0))


def softmax(values: Column, scale: float = 1.0) -> Column:
    """Without a shift by the maximum, as the classifier computes it."""
    e = F.transform(values, lambda v: F.exp(v.cast("double") * scale))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))


def multi_label(values: Column, thresholds: list[float]) -> Column:
    """1 for each class whose softmax exceeds its threshold, else 0."""
    return F.zip_with(softmax(values), F.array(*map(F.lit, thresholds)), lambda p, t: (p > t).cast("int"))


def keypoint_box(points: Column, least_score: float = 0.0) -> Column:
    """struct<left, top, right, bottom> of the points (x, y, score) that aren't (0, 0) and score enough; null if none."""
    used = F.filter(points, lambda p: ((p["x"] != 0) | (p["y"] != 0)) & (p["score"] >= least_score))
    xs, ys = F.transform(used, lambda p: p["x"]), F.transform(used, lambda p: p["y"])
    return F.when(F.size(used) > 0, F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom")))


def scale_to_byte(values: Column) -> Column:
    """Least to 0, greatest to 255; a flat array gives zeros."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(hi > lo, ((v - lo) / (hi - lo) * 255).cast("int")).otherwise(0))


def mean_confidence(probs: Column, text: Column) -> tuple[Column, Column]:
    """Mean of kept symbol scores (0 where there is none or it is NaN) and the text, '###' where it is empty."""
    n = F.size(probs)
    mean = F.when(n > 0, F.aggregate(probs, F.lit(0.0), lambda s, v: s + v.cast("double")) / n)
    return F.coalesce(F.nanvl(mean, F.lit(0.0)), F.lit(0.0)), F.when(F.length(text) > 0, text).otherwise("###")


def log_metrics(lines: DataFrame, patterns: dict[str, str], by: list[str]) -> DataFrame:
    """Mean and maximum of the numbers that each pattern's first group finds in a log's lines."""
    out = []
    for name, p in patterns.items():
        v = F.regexp_extract("value", p, 1)
        out += [F.round(F.avg(F.when(v != "", v.cast("double"))), 6).alias(f"{name}_mean"), F.max(F.when(v != "", v.cast("double"))).alias(f"{name}_max")]
    return lines.groupBy(*by).agg(*out)


def class_rollup(det: DataFrame, by: list[str], cube: bool = False) -> DataFrame:
    """Boxes and mean score over all prefixes (or, with cube, all subsets) of the grouping columns."""
    g = det.cube(*by) if cube else det.rollup(*by)
    return g.agg(F.count(F.lit(1)).alias("n_boxes"), (F.sum(F.round(F.col("score") * 1e6).cast("long")) / F.count("score") / 1e6).alias("mean_score"), F.grouping_id().cast("int").alias("level"))


def time_windows(frames: DataFrame, by: list[str], width: str, slide: str | None = None) -> DataFrame:
    """Frames of each tumbling or sliding window of event time."""
    w = F.window(F.col("ts"), width, slide) if slide else F.window(F.col("ts"), width)
    return frames.where("ts is not null").groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("n_frames")).select(*by, F.col("w.start").alias("window_start"), "n_frames")


def sessions(frames: DataFrame, by: list[str], gap: str) -> DataFrame:
    """Sessions of frames that follow each other within `gap`."""
    return frames.where("ts is not null").groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_frames")).select(*by, F.col("w.start").alias("session_start"), "n_frames")
