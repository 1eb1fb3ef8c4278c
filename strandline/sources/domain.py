"""The engine's relations over stored tables: detections, frames and tracks, each redelivered row once.

A stream is one run of one channel (`task_id`); a frame is (task_id, frame_id), a detection (task_id, frame_id, det_idx).
Frame ids are stored, so sampling and routing predicates reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.tables import table

STREAM = ["task_id"]
FRAME = ["task_id", "frame_id"]
DET = ["task_id", "frame_id", "det_idx"]


def once(rows: DataFrame) -> DataFrame:
    """Each row once: a redelivered row is the same, and predicates on any column pass the distinct on to the scan.

    Rows go to their frame's partition first, which serves the distinct and whatever joins or groups by frame behind it.
    """
    return rows.repartition(*FRAME).distinct()


def detections(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Boxes (all columns, or the key and `cols`, so that a scan reads no more); `score` is the first of mscores, null where it is missing or outside 0..1."""
    s = F.try_element_at("mscores", F.lit(1)).cast("double")
    rows = table(spark, d, "detected_objects").select("task_id", "channel_id", F.col("mframeid").alias("frame_id"), "det_idx", F.col("mclassify").alias("class_id"), F.when(s.between(0, 1), F.round(s, 6)).alias("score"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mwidth").alias("w"), F.col("mheight").alias("h"))
    rows = rows.select(*DET, *cols) if cols else rows
    return once(rows)


def frames(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Frames (all columns, or the key and `cols`)."""
    rows = table(spark, d, "frames").select("task_id", "graph_id", "channel_id", F.col("mframeid").alias("frame_id"), F.col("mtimestamp").cast("timestamp_ntz").alias("ts"), F.col("mwidth").alias("width"), F.col("mheight").alias("height"), F.col("mfps").cast("double").alias("fps"), F.col("mendofstream").alias("eos"), "error_code")
    return once(rows.select(*FRAME, *cols) if cols else rows)


def tracks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tracked_objects").select("task_id", F.col("mframeid").alias("frame_id"), "det_idx", F.col("mtrackid").alias("track_id"))
    return once(rows)


def class_names(spark: SparkSession, d: str) -> DataFrame:
    """The label dictionary: class_id, class_name."""
    return table(spark, d, "class_names").select("class_id", "class_name").dropDuplicates(["class_id"])


#: The same relations as SQL common table expressions.
SQL = """
det as (select distinct task_id, channel_id, mframeid as frame_id, det_idx, mclassify as class_id,
  case when not isnan(mscores[1]) and mscores[1] between 0 and 1 then round(cast(mscores[1] as double), 6) end as score,
  mx as x, my as y, mwidth as w, mheight as h from detected_objects),
fr as (select distinct task_id, graph_id, channel_id, mframeid as frame_id, mtimestamp as ts, mwidth as width, mheight as height,
  cast(mfps as double) as fps, mendofstream as eos, error_code from frames),
tr as (select distinct task_id, mframeid as frame_id, det_idx, mtrackid as track_id from tracked_objects),
cn as (select class_id, class_name from class_names)
"""
