"""Ordered operators within a stream: count windows, carry-forward, track sets, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_windows(rows: DataFrame, stream: list[str], order: str, size: int) -> DataFrame:
    """Adds window_id: rows of a stream in order, `size` at a time; the last window may be short."""
    return rows.withColumn("window_id", F.floor((F.row_number().over(Window.partitionBy(*stream).orderBy(order)) - 1) / size))


def label_windows(windowed: DataFrame, stream: list[str], label: str) -> DataFrame:
    """The most frequent label of each window (the least of equals), given back to every row of it."""
    votes = windowed.where(F.col(label).isNotNull()).groupBy(*stream, "window_id", label).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*stream, "window_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b")).select(*stream, "window_id", F.col("b.l").alias("window_label"))
    return windowed.join(best, [*stream, "window_id"], "left")


def carry_forward(frames: DataFrame, stream: list[str], value: str, flag: str = "filtered") -> DataFrame:
    """A flagged frame shows the value of the last frame that isn't flagged; null before the first."""
    w = Window.partitionBy(*stream).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col(flag), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)
    return frames.withColumn("shown", last["v"])


def tracks_gone(tracks: DataFrame, stream: list[str]) -> DataFrame:
    """Tracks of a frame that the stream's next frame hasn't: the difference of successive track lists by id."""
    t = tracks.where("track_id >= 0").select(*stream, "frame_id", "track_id").distinct()
    frames = t.select(*stream, "frame_id").distinct().withColumn("next_frame", F.lead("frame_id").over(Window.partitionBy(*stream).orderBy("frame_id")))
    after = t.withColumnRenamed("frame_id", "next_frame")
    return t.join(frames, [*stream, "frame_id"]).where("next_frame is not null").join(after, [*stream, "next_frame", "track_id"], "left_anti").select(*stream, "frame_id", "track_id")


def first_n(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the ranked filter is pushed below the exchange."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def sink_capacity(rows: DataFrame, group: list[str], order: str, cap: int) -> DataFrame:
    """What a full queue lets through when nothing is taken from it: the first `cap` rows of each group."""
    return first_n(rows, group, [order], cap)
