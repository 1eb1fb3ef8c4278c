"""Sinks: frame and alarm JSON, addresses, pushing over HTTP, image folders, handlers of micro-batches."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Rows a channel's push queue holds, tries of an error report.
QUEUE, TRIES = 20, 5
#: Colours of drawn objects, by class or track modulo their number.
PALETTE_SIZE = 21


def frame_json(frames: DataFrame, det: DataFrame, tracks: DataFrame, frame: list[str], image: Column | None = None) -> DataFrame:
    """frame columns, payload: a frame with its objects as the sink writes it. Empty arrays are left out."""
    some = lambda c: F.when(F.size(c) > 0, c)
    box = F.struct(F.col("x").alias("mX"), F.col("y").alias("mY"), F.col("w").alias("mWidth"), F.col("h").alias("mHeight"))
    d = det.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct("det_idx", F.struct(box.alias("mBox"), F.when(F.col("score").isNotNull(), F.array("score")).alias("mScores"), F.col("class_id").alias("mClassify")).alias("o")))).alias("d"))
    t = tracks.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct("det_idx", F.struct(F.col("track_id").alias("mTrackId")).alias("o")))).alias("t"))
    rows = frames.join(d, frame, "left").join(t, frame, "left")
    head = F.struct(F.col("channel_id").alias("mChannelId"), F.col("frame_id").alias("mFrameId"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mTimestamp"), F.col("width").alias("mWidth"), F.col("height").alias("mHeight"), F.col("eos").alias("mEndOfStream"), *([F.base64(image).alias("mSpData")] if image is not None else []))
    objects = lambda c: some(F.transform(F.coalesce(c, F.slice(c, 1, 0)), lambda x: x["o"]))
    body = F.struct(F.col("fps").alias("mFps"), head.alias("mFrame"), F.col("graph_id").alias("mGraphId"), F.lit(-1).alias("mSubId"), objects(F.col("d")).alias("mDetectedObjectMetadatas"), objects(F.col("t")).alias("mTrackedObjectMetadatas"))
    return rows.select(*frame, F.to_json(body).alias("payload"))


PAYLOAD = "mFrame struct<mFrameId:long,mChannelId:int,mSpData:string>, mDetectedObjectMetadatas array<struct<mBox:struct<mX:int,mY:int,mWidth:int,mHeight:int>,mScores:array<double>,mClassify:int>>, mTrackedObjectMetadatas array<struct<mTrackId:long>>"


def alarm_json(payloads: DataFrame, task: Column, source: Column, kind: Column, payload: str = "payload") -> DataFrame:
    """Adds alarm: the frame JSON in the shape alarm receivers expect. Events stand only for frames with tracks."""
    p = F.from_json(payload, PAYLOAD)
    event = lambda o: F.struct(F.struct(o["mBox"]["mX"].alias("LeftTopX"), o["mBox"]["mY"].alias("LeftTopY"), (o["mBox"]["mX"] + o["mBox"]["mWidth"]).alias("RightBtmX"), (o["mBox"]["mY"] + o["mBox"]["mHeight"]).alias("RightBtmY")).alias("Box"), kind.alias("Type"))
    events = F.when(p["mTrackedObjectMetadatas"].isNotNull(), F.transform(p["mDetectedObjectMetadatas"], event))
    body = F.struct(p["mFrame"]["mFrameId"].alias("FrameIndex"), p["mFrame"]["mSpData"].alias("SceneImageBase64"), task.cast("string").alias("TaskID"), source.alias("SrcID"), F.coalesce(events, F.array().cast("array<struct<Box:struct<LeftTopX:int,LeftTopY:int,RightBtmX:int,RightBtmY:int>,Type:int>>")).alias("AnalyzeEvents"))
    return payloads.withColumn("alarm", F.to_json(body))


def encode_url(kind: str, graph: Column, channel: Column, ip: str = "localhost", port: int = 8554, prefix: str = "", h265: bool = False) -> Column:
    """Where an encoder writes: a live address or a file below ./results."""
    name = F.concat(F.lit(prefix), graph.cast("string"), F.lit("_"), channel.cast("string"))
    if kind in ("RTSP", "RTMP"):
        return F.concat(F.lit(f"{kind.lower()}://{ip}:{port}/live/"), name)
    if kind == "VIDEO":
        return F.concat(F.lit("./results/"), name, F.lit(".mp4" if h265 else ".avi"))
    if kind == "WS":
        return F.concat(F.lit(f"ws://{ip}:"), (F.lit(port) + channel).cast("string"))
    return F.concat(F.lit("./results/"), name)


def draw_commands(det: DataFrame, frame: list[str], names: DataFrame, areas: list[list[tuple[int, int]]] = ()) -> DataFrame:
    """frame columns, commands: what an overlay draws, as data: boxes with text anchored inside the frame, then the areas."""
    text = F.format_string("%s:%.2f", F.coalesce("class_name", F.lit("")), F.coalesce("score", F.lit(0.0)))
    one = F.struct(F.lit("BOX").alias("kind"), "x", "y", "w", "h", text.alias("text"), F.when(F.col("y") < 20, F.col("y") + 20).otherwise(F.col("y")).alias("text_y"), (F.coalesce("track_id", "class_id") % PALETTE_SIZE).cast("int").alias("colour"))
    rows = det.join(names, "class_id", "left")
    rows = rows if "track_id" in rows.columns else rows.withColumn("track_id", F.lit(None).cast("long"))
    boxes = rows.groupBy(*frame).agg(F.transform(F.sort_array(F.collect_list(F.struct("det_idx", one.alias("c")))), lambda v: v["c"]).alias("commands"))
    outline = F.array(*[F.struct(F.lit("AREA").alias("kind"), F.lit(p[0][0]).alias("x"), F.lit(p[0][1]).alias("y"), F.lit(p[-1][0] - p[0][0]).alias("w"), F.lit(p[-1][1] - p[0][1]).alias("h"), F.lit("").alias("text"), F.lit(p[0][1]).alias("text_y"), F.lit(0).alias("colour")) for p in areas]) if areas else None
    return boxes.withColumn("commands", F.concat("commands", outline)) if areas else boxes


def post(url: str, body: str, timeout: float = 5.0) -> bool:
    try:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return 200 <= r.status < 300
    except OSError:
        return False


def push(df: DataFrame, url: str, payload: str = "payload", send: Callable[[str, str], bool] = post) -> DataFrame:
    """Posts each row's payload from the executors; returns sent and failed rows of every partition. End markers must be filtered before."""
    def run(batches):
        import pyarrow as pa

        sent = failed = 0
        for b in batches:
            for body in b.column(0).to_pylist():
                ok = body is not None and send(url, body)
                sent, failed = sent + ok, failed + (not ok)
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64()), pa.array([failed], pa.int64())], ["sent", "failed"])

    return df.select(payload).mapInArrow(run, "sent long, failed long")


def report_error(url: str, code: int, message: str, send: Callable[[str, str], bool] = post) -> bool:
    """Tells a receiver of an error, at most TRIES times."""
    body = json.dumps({"Code": code, "Msg": message})
    return any(send(url, body) for _ in range(TRIES))


class ErrorReports(StreamingQueryListener):
    """Reports the failure of any streaming query: spark.streams.addListener(ErrorReports(url))."""

    def __init__(self, url: str, send: Callable[[str, str], bool] = post):
        self.url, self.send = url, send

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            report_error(self.url, 1, str(event.exception)[:2000], self.send)


def write_images(df: DataFrame, root: str, content: str = "content", prefix: str = "") -> DataFrame:
    """Writes each row's image as {root}/{prefix}{graph}_{channel}/{frame}.jpg on shared storage; returns the paths. A repeated write replaces the file."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            paths = []
            for g, c, f, data in zip(*[b.column(i).to_pylist() for i in range(4)]):
                folder = os.path.join(root, f"{prefix}{g}_{c}")
                os.makedirs(folder, exist_ok=True)
                path = os.path.join(folder, f"{f}.jpg")
                with open(path + ".part", "wb") as out:
                    out.write(data or b"")
                os.replace(path + ".part", path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return df.select("graph_id", "channel_id", "frame_id", content).mapInArrow(run, "path string")


def sink_handler(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts a streaming query that hands every micro-batch to `handler`; frames flagged `filtered` are left out."""
    rows = stream.where(~F.coalesce(F.col("filtered"), F.lit(False))) if "filtered" in stream.columns else stream
    writer = rows.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
