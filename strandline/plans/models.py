"""Queries of model post-processing, tracking, sinks, compiled graphs and streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import ctc
from strandline.functions.suppression import suppress_rotated
from strandline.operators import sampling, tracking
from strandline.plans import graph as G
from strandline.plans.flows import SECONDS
from strandline.plans.tensors import PROB_IOU, _nms
from strandline.plans.scans import WIRE, WITH, _sql_area
from strandline.sources import domain as D
from strandline.sources import sinks
from strandline.sources.tables import shared_path, table
from strandline.streaming import stateful

FRAME, DK = D.FRAME, D.DET
SYMBOLS, STEPS = 4, 16
LETTERS = ["A", "B", "C", "-"]
TRIPWIRE_GRAPH = {
    "graph_id": 0,
    "elements": [
        {"element_id": 5000, "name": "decode", "configure": {"sample_interval": 2, "sample_strategy": "DROP"}, "ports": {"input": [{"port_id": 0, "is_src": True}]}},
        {"element_id": 5001, "name": "yolox_group", "configure": {"threshold_conf": 0.3}, "inner_elements_id": [10001, 10002, 10003]},
        {"element_id": 5005, "name": "filter", "configure": {"rules": [{"channel_id": 20, "filters": [{"type": 2, "classes": [0, 1, 2], "areas": [[{"left": x, "top": y} for x, y in WIRE]], "times": [{"time_start": "00 00 00", "time_end": "23 59 59"}]}]}]}},
        {"element_id": 5006, "name": "http_push", "ports": {"output": [{"port_id": 0, "is_sink": True}]}},
    ],
    "connections": [{"src_element_id": 5000, "dst_element_id": 10001}, {"src_element_id": 10003, "dst_element_id": 5005}, {"src_element_id": 5005, "dst_element_id": 5006}],
}


def _steps(symbol_major: bool):
    return ctc.best_steps(F.col("embedding"), SYMBOLS, STEPS, symbol_major)


def ctc_collapse_plate(spark, d):
    """Symbol-major tensors, the last symbol blank."""
    return table(spark, d, "embeddings").select("vec_id", ctc.greedy_text(_steps(True), LETTERS, 3).alias("text"))


def ctc_collapse_ocr(spark, d):
    """Step-major tensors, the first symbol blank; mean of the kept values and '###' for no text."""
    from strandline.operators.aggregates import mean_confidence

    kept = ctc.collapse(_steps(False), 0)
    mean, text = mean_confidence(F.transform(kept, lambda x: x["p"]), ctc.greedy_text(_steps(False), ["-", "A", "B", "C"], 0))
    return table(spark, d, "embeddings").select("vec_id", text.alias("text"), F.round(mean, 5).alias("confidence"))


def track_bytetrack(spark, d):
    return tracking.track(D.frames(spark, d), D.detections(spark, d).where("w > 0 and h > 0"))


def nms_rotated(spark, d):
    rows = D.detections(spark, d).where("w > 0 and h > 0").withColumn("r", (F.col("det_idx") % 7) * 0.4).withColumn("x", F.col("x") + F.col("w") / 2).withColumn("y", F.col("y") + F.col("h") / 2)
    return suppress_rotated(rows, FRAME, 0.3)


def frame_json(spark, d):
    """The sink's JSON of every frame, read back: ids, size, numbers of objects, first class."""
    p = sinks.frame_json(D.frames(spark, d), D.detections(spark, d), D.tracks(spark, d), FRAME)
    j = lambda path: F.get_json_object("payload", path)
    n = lambda key: F.coalesce(F.json_array_length(j(f"$.{key}")), F.lit(0)).cast("int")
    return p.select(*FRAME, j("$.mFrame.mChannelId").cast("int").alias("channel_id"), j("$.mFrame.mWidth").cast("int").alias("width"), n("mDetectedObjectMetadatas").alias("boxes"), n("mTrackedObjectMetadatas").alias("tracks"), j("$.mDetectedObjectMetadatas[0].mBox.mX").cast("int").alias("first_x"))


def alarm_json(spark, d):
    """Alarms of the frames with tracks, read back."""
    p = sinks.frame_json(D.frames(spark, d), D.detections(spark, d), D.tracks(spark, d), FRAME)
    a = sinks.alarm_json(p, F.col("task_id"), F.lit("cam"), F.lit(1))
    j = lambda path: F.get_json_object("alarm", path)
    return a.select(*FRAME, j("$.FrameIndex").cast("long").alias("frame_index"), F.json_array_length(j("$.AnalyzeEvents")).cast("int").alias("events"), j("$.AnalyzeEvents[0].Box.RightBtmX").cast("int").alias("right"))


def draw_overlay(spark, d):
    """Number of drawn boxes of each frame and the first one's text."""
    c = sinks.draw_commands(D.detections(spark, d), FRAME, D.class_names(spark, d))
    return c.select(*FRAME, F.size("commands").alias("n"), F.col("commands")[0]["text_y"].alias("text_y"), F.col("commands")[0]["colour"].alias("colour"))


def encode_urls(spark, d):
    r = table(spark, d, "request_add_channel").where("graph_id is not null and channel_id is not null").select("graph_id", "channel_id").distinct()
    g, c = F.col("graph_id"), F.col("channel_id")
    return r.select(g, c, sinks.encode_url("RTSP", g, c).alias("live"), sinks.encode_url("VIDEO", g, c, h265=True).alias("file"), sinks.encode_url("WS", g, c, port=9000).alias("ws"))


def pipeline_graph(spark, d):
    """A graph configuration compiled and run: sampling, model thresholds, the rule filter of channel 20, all other channels passing."""
    out = G.compile_graph(G.parse_graph(TRIPWIRE_GRAPH), {"frames": D.frames(spark, d), "detections": D.detections(spark, d)})
    return out[(5006, 0)]["frames"].select(*FRAME, "tag")


def frame_stream(spark: SparkSession, d: str, name: str = "frames") -> DataFrame:
    """A table's files as a stream."""
    path = f"{d}/{name}.parquet"
    schema = table(spark, d, name).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def run_stream(df: DataFrame, label: str) -> DataFrame:
    """Runs a streaming query over what its source holds now; its rows from the shared folder."""
    root = shared_path(df.sparkSession, label)
    q = df.writeStream.format("parquet").option("path", root).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(root)


def stream_equals_batch_throttle(spark, d):
    """The time rule over the frame table as a stream."""
    rows = frame_stream(spark, d).select("task_id", F.col("mframeid").alias("frame_id"), F.col("mtimestamp").alias("ts"))
    return run_stream(stateful.throttle(rows, SECONDS), "throttle")


def stream_equals_batch_sampling(spark, d):
    rows = frame_stream(spark, d).select("task_id", F.col("mframeid").alias("frame_id"), F.col("mendofstream").alias("eos"))
    return run_stream(sampling.sample_frames(rows, 5), "sampling").select(*FRAME).distinct()


_BEST = "select vec_id, j, arg_max(k, (v, -k)) as s, max(v) as p from (select vec_id, j, k, cast(embedding[{at}] as double) as v from embeddings, range(16) a(j), range(4) b(k)) group by vec_id, j"
_KEPT = "k as (select *, lag(s) over (partition by vec_id order by j) as before from b)"

ORACLE = {
    "ctc_collapse_plate": f"with b as ({_BEST.format(at='k * 16 + j + 1')}), {_KEPT} select e.vec_id, coalesce(string_agg(case s when 0 then 'A' when 1 then 'B' when 2 then 'C' end, '' order by j), '') as text from embeddings e left join (select * from k where s <> 3 and (before is null or before <> s)) x on x.vec_id = e.vec_id group by e.vec_id",
    "ctc_collapse_ocr": f"with b as ({_BEST.format(at='j * 4 + k + 1')}), {_KEPT} select e.vec_id, coalesce(string_agg(case s when 1 then 'A' when 2 then 'B' when 3 then 'C' end, '' order by j), '###') as text, round(coalesce(avg(p), 0), 5) as confidence from embeddings e left join (select * from k where s <> 0 and (before is null or before <> s)) x on x.vec_id = e.vec_id group by e.vec_id",
    "frame_json": WITH + """select fr.task_id, fr.frame_id, channel_id, width, cast(coalesce(n, 0) as int) as boxes, cast(coalesce(m, 0) as int) as tracks, first_x from fr
left join (select task_id, frame_id, count(*) as n, min_by(x, det_idx) as first_x from det group by all) b on b.task_id = fr.task_id and b.frame_id = fr.frame_id
left join (select task_id, frame_id, count(*) as m from tr group by all) t on t.task_id = fr.task_id and t.frame_id = fr.frame_id""",
    "alarm_json": WITH + """select fr.task_id, fr.frame_id, fr.frame_id as frame_index, cast(case when m is null then 0 else coalesce(n, 0) end as int) as events, case when m is not null then r end as "right" from fr
left join (select task_id, frame_id, count(*) as n, min_by(x + w, det_idx) as r from det group by all) b on b.task_id = fr.task_id and b.frame_id = fr.frame_id
left join (select task_id, frame_id, count(*) as m from tr group by all) t on t.task_id = fr.task_id and t.frame_id = fr.frame_id""",
    "draw_overlay": WITH + "select task_id, frame_id, cast(count(*) as int) as n, min_by(case when y < 20 then y + 20 else y end, det_idx) as text_y, arg_min_null(class_id % 21, det_idx) as colour from det group by all",
    "encode_urls": "select distinct graph_id, channel_id, 'rtsp://localhost:8554/live/' || graph_id || '_' || channel_id as live, './results/' || graph_id || '_' || channel_id || '.mp4' as file, 'ws://localhost:' || (9000 + channel_id) as ws from request_add_channel where graph_id is not null and channel_id is not null",
    "pipeline_graph": WITH + f""", f2 as (select * from fr where frame_id % 2 = 0 or coalesce(eos, false)), hit as (select distinct task_id, frame_id from det join (select task_id, frame_id from f2 where channel_id = 20 and cast(floor(epoch_us(ts) / 1000) as bigint) % 86400000 between 0 and 86399000) using (task_id, frame_id) where score > 0.3 and class_id in (0, 1, 2) and {_sql_area(WIRE)})
, c as (select distinct task_id from f2 where channel_id = 20) select f2.task_id, f2.frame_id, case when h.task_id is not null then 1 else 0 end as tag from f2 left join hit h on h.task_id = f2.task_id and h.frame_id = f2.frame_id left join c on c.task_id = f2.task_id where h.task_id is not null or c.task_id is null or coalesce(eos, false)""",
}
ORACLE["nms_rotated"] = "with recursive " + D.SQL + ", q as (select task_id, frame_id, det_idx, class_id, score, x + w / 2.0 as px, y + h / 2.0 as py, cast(w as double) as pw, cast(h as double) as ph, (det_idx % 7) * cast(0.4 as double) as pr, 0.0 as qx, 0.0 as qy from det where score is not null and w > 0 and h > 0), " + _nms("q", 0.3, test=f"{PROB_IOU} >= 0.3") + " select task_id, frame_id, det_idx, class_id, score from kp"
NO_SQL = ["track_bytetrack", "stream_equals_batch_throttle", "stream_equals_batch_sampling"]
from strandline.plans.flows import ORACLE as _FLOWS  # noqa: E402
from strandline.plans.scans import ORACLE as _SCANS  # noqa: E402

ORACLE["stream_equals_batch_throttle"] = _FLOWS["route_time_interval"]
ORACLE["stream_equals_batch_sampling"] = _SCANS["sample_drop"]
QUERIES = {k: globals()[k] for k in dict.fromkeys([*ORACLE, *NO_SQL])}
