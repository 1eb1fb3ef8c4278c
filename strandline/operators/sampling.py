"""Scans of frame tables: sampling, replay, regions, channel numbering, end of stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DROP, KEEP = "DROP", "KEEP"


def sample_frames(frames: DataFrame, interval: int | Column, strategy: str = DROP) -> DataFrame:
    """Every `interval`-th frame id. DROP removes the others but keeps end markers; KEEP passes them flagged `filtered`."""
    skip = F.col("frame_id") % interval != 0
    if strategy == DROP:
        return frames.where(~skip | F.coalesce(F.col("eos"), F.lit(False)))
    return frames.withColumn("filtered", skip)


def replay(frames: DataFrame, loops: int, length: DataFrame | None = None) -> DataFrame:
    """The frames of a file played `loops` times; ids go on growing by the stream's length, which is its largest id + 1."""
    length = frames.groupBy("task_id").agg((F.max("frame_id") + 1).alias("__len")) if length is None else length
    turn = frames.join(length, "task_id").withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    return turn.withColumn("frame_id", F.col("frame_id") + F.col("loop") * F.col("__len")).drop("__len")


def crop_region(frames: DataFrame, left: Column, top: Column, width: Column, height: Column) -> DataFrame:
    """A fixed region replaces each frame's size; regions that leave the frame are cut, frames without one stay whole."""
    left0, top0 = F.least(F.greatest(left, F.lit(0)), F.col("width")), F.least(F.greatest(top, F.lit(0)), F.col("height"))
    has = left.isNotNull() & top.isNotNull() & width.isNotNull() & height.isNotNull()
    return frames.select("*", F.when(has, left0).otherwise(0).alias("roi_x"), F.when(has, top0).otherwise(0).alias("roi_y"), F.when(has, F.least(width, F.col("width") - left0)).otherwise(F.col("width")).alias("roi_w"), F.when(has, F.least(height, F.col("height") - top0)).otherwise(F.col("height")).alias("roi_h"))


def densify_channels(channels: DataFrame, graph: str = "graph_id", channel: str = "channel_id", seen: str = "first_seen") -> DataFrame:
    """channel_idx of each channel of a graph in order of first appearance, from 0."""
    return channels.withColumn("channel_idx", F.row_number().over(Window.partitionBy(graph).orderBy(seen, channel)) - 1)


def number_frames(frames: DataFrame, stream: list[str], order: list[str | Column]) -> DataFrame:
    """Frame ids from 0 in arrival order, for sources that store none. Store the result: filters cannot pass a window."""
    return frames.withColumn("frame_no", (F.row_number().over(Window.partitionBy(*stream).orderBy(*order)) - 1).cast("long"))


def carry_time(frames: DataFrame, stream: list[str], ts: str, order: str) -> DataFrame:
    """Frames without a timestamp get that of the last frame before them that has one; those before the first stay null."""
    before = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn(ts, F.last(ts, ignorenulls=True).over(before))


def bypass(df: DataFrame, step, flag: str = "filtered") -> DataFrame:
    """Applies `step` to the rows that aren't flagged and forwards the flagged as they are."""
    done = step(df.where(~F.col(flag)))
    return done.unionByName(df.where(F.col(flag)), allowMissingColumns=True)


def magic_kind(content: Column) -> Column:
    """'jpeg', 'png', 'bmp' or null by the first bytes of an image."""
    begins = lambda x: F.substring(content, 1, len(x) // 2) == F.unhex(F.lit(x))
    return F.when(begins("FFD8FF"), "jpeg").when(begins("89504E470D0A1A0A"), "png").when(begins("424D"), "bmp")


def url_source_type(url: Column) -> Column:
    """Source type of an address: a path is VIDEO, gb28181 by its first seven letters, others by their first four."""
    return F.when(url.startswith("/"), "VIDEO").when(F.substring(url, 1, 7) == "gb28181", "GB28181").otherwise(F.upper(F.substring(url, 1, 4)))
