import base64
import json

import pytest
from pyspark.sql import functions as F
from strandline.operators import routing, rules, sampling
from strandline.plans import engine as E
from strandline.plans import graph as G
from strandline.plans import models
from strandline.sources import domain as D
from strandline.sources import readers, sinks
from strandline.streaming import stateful

SMALL = "/root/testdata/sf0.001"


def gated(spark, bits, first, skip):
    rows = [(1, i, 0, 7 if b == "1" else 8) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "task_id long, frame_id long, det_idx int, track_id long")
    return [r.frame_id for r in rules.gate_alerts(df, ["task_id"], "track_id", df, first, skip).where("track_id = 7").orderBy("frame_id").collect()]


@pytest.mark.parametrize("first,skip", [(0, 1), (1, 2), (3, 10000)])
@pytest.mark.parametrize("bits", ["1111111", "1101111", "0000", "10101"])
def test_gating(spark, bits, first, skip):
    want, n = [], 0
    for i, b in enumerate(bits):
        n = n + 1 if b == "1" else 0
        if n > first and (n - first - 1) % skip == 0:
            want.append(i)
    assert gated(spark, bits, first, skip) == want


def test_throttle_gaps(spark):
    rows = [(1, i, t) for i, t in enumerate([0.0, 1.0, 1.5, 2.5, 2.5000005, 9.0])]
    df = spark.createDataFrame(rows, "task_id long, frame_id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    got = [r.frame_id for r in routing.throttle(df, ["task_id"], 1.0).orderBy("frame_id").collect()]
    assert got == [0, 2, 5]  # exactly the interval does not fire


def test_times():
    assert rules.day_ms("23 59 59") == rules.day_ms("23:59:59") == 86399000
    assert rules.day_ms("23 59 59", compat=True) == (23 * 3600 + 9 * 60 + 9) * 1000


def test_converge_orders(spark):
    main = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 1), (2, 0, 1)], "task_id long, frame_id long, branches int")
    got = spark.createDataFrame([(1, 2), (1, 1), (2, 0)], "task_id long, frame_id long")
    loose = {(r.task_id, r.frame_id) for r in routing.converge(main, got, ["task_id", "frame_id"], ["task_id"], strict=False).collect()}
    tight = {(r.task_id, r.frame_id) for r in routing.converge(main, got, ["task_id", "frame_id"], ["task_id"]).collect()}
    assert loose == {(1, 0), (1, 2), (2, 0)} and tight == {(1, 0), (2, 0)}


def test_channels_and_protocol(spark):
    e = E.PipelineEngine(spark)
    e.add_graph(models.TRIPWIRE_GRAPH)
    start = lambda c: e.add_channel({"channel_id": c, "url": "rtsp://h/x", "source_type": "RTSP"})["Result"][0]["TaskID"]
    assert [start(c) for c in (0, 1, 2)] == [0, 1, 2]
    assert e.stop_channel({"channel_id": 1})["Code"] == 0 and start(7) == 1
    assert e.add_channel({"channel_id": 3, "source_type": "RTSP"})["Code"] == 5008
    assert e.graph_ids() == [0] and e.graph_exists(0)
    with pytest.raises(G.ConfigError):
        e.add_graph(models.TRIPWIRE_GRAPH)
    e.remove_graph(0)
    assert not e.graph_exists(0)


@pytest.mark.parametrize("change,word", [
    (lambda g: g["connections"].append({"src_element_id": 5006, "dst_element_id": 5000}), "cycle"),
    (lambda g: g["connections"].append({"src_element_id": 5000, "dst_element_id": 5006}), "one consumer"),
    (lambda g: g["connections"].append({"src_element_id": 1, "dst_element_id": 5006}), "isn't there"),
    (lambda g: g["elements"].append({"element_id": 5000, "name": "blank"}), "twice"),
    (lambda g: g["elements"][1].update(name="nothing"), "no operator"),
    (lambda g: g["elements"][3].pop("ports"), "sink"),
])
def test_bad_graphs(change, word):
    g = json.loads(json.dumps(models.TRIPWIRE_GRAPH))
    change(g)
    with pytest.raises(G.ConfigError, match=word):
        G.validate(G.parse_graph(g))


def test_all_elements_are_registered():
    assert len(G.operators()) == 43  # 31 elements and 12 groups


def test_empty_slots_and_tensors(spark, monkeypatch):
    end = {"output": [{"port_id": 0, "is_sink": True}], "input": [{"port_id": 0, "is_src": True}]}
    one = lambda name, **c: G.parse_graph({"elements": [{"element_id": 1, "name": name, "configure": c, "ports": end}]})
    frames = D.frames(spark, SMALL)
    with pytest.raises(G.ConfigError, match="empty model slot"):
        G.compile_graph(one("openpose"), {"frames": frames})
    t = spark.createDataFrame([(1, 0, [5.0, 5.0, 4.0, 4.0, 0.9, 0.1, 0.3])], "task_id long, frame_id long, t0 array<double>")
    more = {"src": (10, 10), "net": (10, 10), "conf": 0.2, "iou": 0.5}
    got = lambda task, shape: G.compile_graph(one("yolov8_group", task_type=task, shapes=[shape], **more), {"frames": frames, "tensors": t})[(1, 0)]
    (box,) = got("Detect", (7, 1))["detections"].collect()
    assert (box.class_id, box.x, box.y, box.w, box.h) == (0, 3, 3, 4, 4)
    (turned,) = [r for r in got("Obb", (7, 1))["obbs"].collect()]
    assert turned.class_id == 0 and abs(turned.angle - 0.3) < 1e-9
    assert got("Cls", (7,))["recognitions"].first().class_id == 0
    with pytest.raises(G.ConfigError, match="no decoder"):
        got("Depth", (7, 1))


def test_thresholds_by_name(spark):
    end = {"output": [{"port_id": 0, "is_sink": True}], "input": [{"port_id": 0, "is_src": True}]}
    g = G.parse_graph({"elements": [{"element_id": 1, "name": "yolov5", "configure": {"threshold_conf": {"cat": 0.5, "dog": 0.1}}, "ports": end}]})
    det = spark.createDataFrame([(1, 0, 0, 0, 0.4), (1, 0, 1, 1, 0.4), (1, 0, 2, 2, 0.9), (1, 0, 3, 0, 0.6)], "task_id long, frame_id long, det_idx int, class_id int, score double")
    names = spark.createDataFrame([(0, "cat"), (1, "dog"), (2, "cow")], "class_id int, class_name string")
    got = G.compile_graph(g, {"frames": D.frames(spark, SMALL), "detections": det, "names": names})[(1, 0)]["detections"]
    assert sorted(r.det_idx for r in got.collect()) == [1, 3]


def test_rules_of_no_channel(spark):
    f = spark.createDataFrame([(1, 0, None)], "task_id long, frame_id long, ts timestamp")
    det = spark.createDataFrame([], "task_id long, frame_id long, det_idx int, class_id int, track_id long, x int, y int, w int, h int")
    assert rules.rule_mask(f, det, [], ["task_id"]).count() == 0


def test_push_from_a_graph(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    bodies = []

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            bodies.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    end = {"output": [{"port_id": 0, "is_sink": True}], "input": [{"port_id": 0, "is_src": True}]}
    g = G.parse_graph({"elements": [{"element_id": 1, "name": "http_push", "configure": {"ip": "127.0.0.1", "port": server.server_port, "path": "/x"}, "ports": end}]})
    frames = D.frames(spark, SMALL).where("task_id % 40 = 0 and frame_id < 20")
    out = G.compile_graph(g, {"frames": frames, "detections": D.detections(spark, SMALL)})[(1, 0)]
    sent = out["pushed"].groupBy().sum().first()
    server.shutdown()
    n = frames.where("not coalesce(eos, false)").count()
    assert tuple(sent) == (n, 0) and len(bodies) == n > 0 and all("mFrame" in b for b in bodies)


def test_routing_graph_runs(spark, monkeypatch):
    monkeypatch.setitem(G.MODEL_SLOTS, "resnet", lambda e, fs: fs)
    g = {
        "graph_id": 3,
        "elements": [
            {"element_id": 1, "name": "decode", "ports": {"input": [{"port_id": 0, "is_src": True}]}},
            {"element_id": 2, "name": "distributor", "configure": {"default_port": 0, "rules": [{"frame_interval": 2, "routes": [{"classes": ["pedestrian"], "port": 1}, {"classes": [], "port": 2}]}]}},
            {"element_id": 3, "name": "resnet"}, {"element_id": 4, "name": "blank"},
            {"element_id": 5, "name": "converger", "configure": {"default_port": 0}, "ports": {"output": [{"port_id": 0, "is_sink": True}]}},
        ],
        "connections": [{"src_element_id": 1, "dst_element_id": 2}, {"src_element_id": 2, "src_port": 0, "dst_element_id": 5, "dst_port": 0}, {"src_element_id": 2, "src_port": 1, "dst_element_id": 3}, {"src_element_id": 2, "src_port": 2, "dst_element_id": 4}, {"src_element_id": 3, "dst_element_id": 5, "dst_port": 1}, {"src_element_id": 4, "dst_element_id": 5, "dst_port": 1}],
    }
    frames = D.frames(spark, SMALL)
    seen = []
    e = E.PipelineEngine(spark)
    e.add_graph(g)
    e.set_sink_handler(3, 5, 0, lambda fs: seen.append(fs["frames"].count()))
    e.run(3, {"frames": frames, "detections": D.detections(spark, SMALL), "names": D.class_names(spark, SMALL)})
    assert seen == [frames.count()]  # distributing and converging is the identity on frames


def test_missing_files(tmp_path):
    (tmp_path / "a").write_text("")
    assert E.check_files([{"configure": {"model_path": "a", "class_names": "b"}, "shared_object": "c"}], str(tmp_path)) == ["b", "c"]


def test_tasks(spark):
    s = E.TaskService()
    body = {"TaskID": 5, "InputSrc": {"SrcID": "cam"}, "Algorithm": [{"Type": 1}], "Reporting": {"ReportUrlList": []}}
    assert s.create(body)["Code"] == 0 and s.create(body)["Code"] == -1
    assert s.query(5)["Result"]["Status"] == 1 and len(s.list()["Result"]) == 1
    p = spark.createDataFrame([('{"mFrame":{"mChannelId":0,"mFrameId":4,"mSpData":"eA=="},"mDetectedObjectMetadatas":[{"mBox":{"mX":1,"mY":2,"mWidth":3,"mHeight":4}}],"mTrackedObjectMetadatas":[{"mTrackId":1}]}',)], "payload string")
    a = json.loads(s.alarms(p).first().alarm)
    assert a["TaskID"] == "5" and a["AnalyzeEvents"][0]["Box"]["RightBtmY"] == 6 and a["SrcID"] == "cam"
    assert s.delete(5)["Code"] == 0 and s.delete(5)["Code"] == -1


def test_sources(spark, tmp_path):
    (tmp_path / "im" / "b").mkdir(parents=True)
    for name, data in (("b/2.jpg", b"\xff\xd8\xff1"), ("1.png", b"\x89PNG\r\n\x1a\n"), ("3.txt", b"x"), ("4.bmp", b"BM")):
        (tmp_path / "im" / name).write_bytes(data)
    got = [(r.frame_id, r.kind) for r in readers.read_image_dir(spark, str(tmp_path / "im"), 2).orderBy("frame_id").collect()]
    assert got == [(0, "png"), (1, "bmp"), (2, "jpeg"), (3, "png"), (4, "bmp"), (5, "jpeg")]
    (tmp_path / "posted").mkdir()
    (tmp_path / "posted" / "a.json").write_text("\n".join(json.dumps({"channel_id": 1, "data": d}) for d in (base64.b64encode(b"\xff\xd8\xffx").decode(), "%%", None)))
    assert readers.read_posted_images(spark, str(tmp_path / "posted")).count() == 1
    (tmp_path / "n.txt").write_text("cat\ndog\n")
    assert [tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "n.txt")).collect()] == [(0, "cat"), (1, "dog")]
    (tmp_path / "v.txt").write_text("1 2\n3 4\n")
    assert readers.read_gallery(spark, str(tmp_path / "v.txt"), str(tmp_path / "n.txt")).count() == 2
    (tmp_path / "lut.txt").write_text("\n".join(map(str, range(256))))
    assert readers.read_lut(spark, str(tmp_path / "lut.txt"))[255] == 255
    spark.dataSource.register(readers.FrameSource)
    assert spark.read.format("frames").option("channels", 2).option("frames", 5).load().where("eos").count() == 2
    assert readers.valid_live_url("rtsp://x", "RTSP") and not readers.valid_live_url("http://x", "RTSP")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2, bytearray(b"x"), "{}"), (0, 1, 3, bytearray(b"y"), None)], "graph_id int, channel_id int, frame_id long, content binary, payload string")
    r = sinks.push(df.coalesce(1), "http://x", send=lambda u, b: b == "{}").groupBy().sum().first()
    assert tuple(r) == (1, 1)
    assert sinks.write_images(df, str(tmp_path)).count() == 2 and (tmp_path / "0_1" / "2.jpg").read_bytes() == b"x"
    tries = []
    assert not sinks.report_error("u", 1, "m", lambda u, b: tries.append(b)) and len(tries) == sinks.TRIES
    assert sinks.post("http://127.0.0.1:9/x", "{}", 0.2) is False


def chunked(spark, df, tmp_path, order, n=4):
    """The rows as a stream of several files, in order."""
    rows = sorted(df.collect(), key=lambda r: tuple(r[c] for c in order))
    top = max(r.frame_id for r in rows) + 1
    for i in range(n):
        part = [r for r in rows if i * top // n <= r.frame_id < (i + 1) * top // n]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / f"s/p{i}"))
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_stream_gating_equals_batch(spark, tmp_path):
    rows = D.tracks(spark, SMALL).where("track_id >= 0 and task_id % 3 = 0").select("task_id", "frame_id", "det_idx", "track_id")
    batch = rules.gate_alerts(rows, ["task_id"], "track_id", rows, 1, 3).select("task_id", "frame_id", "det_idx", "track_id", F.col("run").cast("long").alias("run"))
    same(batch, models.run_stream(stateful.gate_alerts(chunked(spark, rows, tmp_path, ["frame_id"]), 1, 3), "t"))


def test_stream_tracking_equals_batch(spark, tmp_path):
    from strandline.operators import tracking

    frames = D.frames(spark, SMALL).where("task_id % 5 = 0")
    det = D.detections(spark, SMALL).where("w > 0 and h > 0")
    joined = frames.select("task_id", "frame_id", "width", "height").join(det.drop("channel_id"), ["task_id", "frame_id"], "left")
    same(tracking.track(frames, det), models.run_stream(stateful.track(chunked(spark, joined, tmp_path, ["frame_id"])), "t"))


def test_stream_converge_and_windows(spark, tmp_path):
    main = spark.createDataFrame([(1, i, i % 3) for i in range(12)], "task_id long, frame_id long, branches int")
    back = spark.createDataFrame([(1, i) for i in range(12) for _ in range(i % 3) if i != 8], "task_id long, frame_id long")
    got = models.run_stream(stateful.converge(chunked(spark, main, tmp_path / "m", ["frame_id"]), chunked(spark, back, tmp_path / "b", ["frame_id"])), "t")
    assert sorted(r.frame_id for r in got.collect()) == list(range(8))  # 8 lacks its branches and holds back the rest
    w = models.run_stream(stateful.count_windows(chunked(spark, main, tmp_path / "w", ["frame_id"]), 5), "t")
    assert sorted((r.frame_id, r.window_id) for r in w.collect()) == [(i, i // 5) for i in range(12)]


def test_partitions_do_not_matter(spark):
    from strandline.functions.suppression import suppress

    det = D.detections(spark, SMALL)
    got = [sorted(map(tuple, suppress(det.repartition(n), ["task_id", "frame_id"], 0.3).collect())) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]


def test_sampling_bypass(spark):
    f = sampling.sample_frames(D.frames(spark, SMALL), 3, sampling.KEEP)
    out = sampling.bypass(f, lambda d: d.withColumn("seen", F.lit(1)))
    assert out.count() == f.count() and out.where("seen = 1").count() == f.where("not filtered").count()


def test_model_slot(spark):
    import numpy as np
    from strandline.functions import decode, image
    from strandline.operators.models import ModelSpec, detect

    def infer(x):
        return [np.array([[32, 32, 20.0 * (1 + i.max() / 255), 10, 0.9, 1.0]]) for i in x]

    spec = ModelSpec(lambda im: image.normalise(image.letterbox(im, 64, 64), (0, 0, 0), (1, 1, 1)), infer, lambda o, size: decode.decode_v5([o], size, (64, 64), 0.5, 0.5))
    rows = [(1, i, 64, 64, bytearray([255]) * (64 * 64 * 3)) for i in range(3)] + [(1, 9, 64, 64, None), (1, 10, 64, 64, bytearray(5))]
    frames = spark.createDataFrame(rows, "task_id long, frame_id long, width int, height int, image binary")
    got = detect(frames, spec).collect()
    assert sorted(r.frame_id for r in got) == [0, 1, 2] and {(r.x, r.y, r.w, r.h) for r in got} == {(12, 27, 40, 10)}
    G.MODEL_SLOTS["yolov5"] = spec
    try:
        out = G.operator("yolov5_group").plan(G.Element(1, "yolov5_group", {"threshold_conf": {0: 0.5}}), {0: {"frames": frames}})
        assert out[0]["detections"].count() == 3
    finally:
        del G.MODEL_SLOTS["yolov5"]


def test_error_reports():
    from types import SimpleNamespace

    seen = []
    r = sinks.ErrorReports("u", lambda u, b: seen.append(json.loads(b)) or True)
    r.onQueryTerminated(SimpleNamespace(exception=None))
    r.onQueryTerminated(SimpleNamespace(exception="broken"))
    assert [b["Msg"] for b in seen] == ["broken"]


def test_log_metrics(spark):
    from strandline.operators.aggregates import log_metrics

    df = spark.createDataFrame([("a", "fps: 20.5 cpu 30%"), ("a", "fps: 21.5"), ("b", "none")], "host string, value string")
    got = {r.host: (r.fps_mean, r.fps_max, r.cpu_max) for r in log_metrics(df, {"fps": r"fps: ([0-9.]+)", "cpu": r"cpu (\d+)%"}, ["host"]).collect()}
    assert got == {"a": (21.0, 21.5, 30.0), "b": (None, None, None)}


STATEFUL_GRAPH = {
    "graph_id": 4,
    "elements": [
        {"element_id": 1, "name": "decode", "configure": {"sample_interval": 1}, "ports": {"input": [{"port_id": 0, "is_src": True}]}},
        {"element_id": 2, "name": "yolov5", "configure": {"threshold_conf": 0.2, "threshold_nms": 0.6}},
        {"element_id": 3, "name": "blank"},
        {"element_id": 4, "name": "filter", "configure": {"rules": [{"channel_id": c, "filters": [
            {"type": 1, "classes": list(range(20)), "areas": [[]], "times": [{"time_start": "00 00 00", "time_end": "23 59 59"}], "alert_first_frame": 2, "alert_frame_skip_nums": 3},
            {"type": 1, "classes": list(range(50)), "areas": [[{"left": 100, "top": 50}, {"left": 2000, "top": 80}, {"left": 1800, "top": 1300}, {"left": 60, "top": 1200}]], "times": [{"time_start": "00 00 00", "time_end": "23 59 59"}], "direction": [1.0, 0.5], "trajectory_interval": 2},
            {"type": 2, "classes": [0, 1, 2], "areas": [[{"left": 100, "top": 540}, {"left": 1800, "top": 560}]], "times": [{"time_start": "00 00 00", "time_end": "23 59 59"}]}]} for c in range(0, 60)]}},
        {"element_id": 5, "name": "http_push", "ports": {"output": [{"port_id": 0, "is_sink": True}]}},
    ],
    "connections": [{"src_element_id": i, "dst_element_id": i + 1} for i in range(1, 5)],
}


def test_stream_graph_equals_batch(spark, tmp_path):
    from strandline.streaming import compiled

    g = G.parse_graph(STATEFUL_GRAPH)
    frames = D.frames(spark, SMALL)
    det = D.detections(spark, SMALL).where("w > 0 and h > 0").join(D.tracks(spark, SMALL), D.DET, "left").withColumn("track_id", F.coalesce("track_id", F.lit(-1)))
    batch = G.compile_graph(g, {"frames": frames, "detections": det})[(5, 0)]["frames"].select("task_id", "frame_id", "tag")
    boxed = compiled.with_boxes(frames, det)
    got = models.run_stream(compiled.compile_stream(g, chunked(spark, boxed, tmp_path, ["frame_id"], 6)), "t")
    tags = {r.tag for r in batch.collect()}
    assert any(t & 1 for t in tags) and any(t & 2 for t in tags) and any(t & 4 for t in tags)
    same(batch, got)


def test_stream_routing_equals_batch(spark, tmp_path):
    from strandline.streaming import compiled

    spec = {
        "graph_id": 5,
        "elements": [
            {"element_id": 1, "name": "decode", "ports": {"input": [{"port_id": 0, "is_src": True}]}},
            {"element_id": 2, "name": "distributor", "configure": {"default_port": 0, "rules": [{"time_interval": 0.7, "routes": [{"classes": ["pedestrian", "sedan"], "port": 1}]}, {"frame_interval": 3, "routes": [{"classes": [], "port": 2}, {"classes": ["sedan"], "port": 1}]}]}},
            {"element_id": 3, "name": "blank"}, {"element_id": 4, "name": "blank"},
            {"element_id": 5, "name": "converger", "configure": {"default_port": 0}, "ports": {"output": [{"port_id": 0, "is_sink": True}]}},
        ],
        "connections": [{"src_element_id": 1, "dst_element_id": 2}, {"src_element_id": 2, "src_port": 0, "dst_element_id": 5, "dst_port": 0}, {"src_element_id": 2, "src_port": 1, "dst_element_id": 3}, {"src_element_id": 2, "src_port": 2, "dst_element_id": 4}, {"src_element_id": 3, "dst_element_id": 5, "dst_port": 1}, {"src_element_id": 4, "dst_element_id": 5, "dst_port": 1}],
    }
    g = G.parse_graph(spec)
    frames = D.frames(spark, SMALL).where("task_id % 3 = 0")
    det = D.detections(spark, SMALL).join(frames.select("task_id", "frame_id"), ["task_id", "frame_id"], "left_semi")
    names = D.class_names(spark, SMALL)
    routed = routing.route(frames, det, names, G.route_rules(spec["elements"][1]["configure"]), D.FRAME, D.STREAM)
    batch = routing.branch_counts(frames, routed, D.FRAME).select("task_id", "frame_id", "branches")
    # the time rule reads frames in order of time, so frames must come in that order too
    steady = frames.groupBy("task_id").agg((F.count("ts") == F.count(F.lit(1))).alias("all")).where("all").select("task_id")
    boxed = compiled.with_boxes(frames.join(steady, "task_id"), det)
    got = models.run_stream(compiled.compile_stream(g, chunked(spark, boxed, tmp_path, ["frame_id"], 5), {r.class_id: r.class_name for r in names.collect()}), "t")
    assert got.count() > 50
    same(batch.join(steady, "task_id").select("task_id", "frame_id", "branches"), got)


def test_control_over_http(spark):
    import copy
    import urllib.error
    import urllib.request

    from strandline.plans import control

    spec = copy.deepcopy(models.TRIPWIRE_GRAPH)
    e = E.PipelineEngine(spark)
    e.add_graph(spec)
    server = control.serve(e, 0)

    def ask(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode(), method=method)
        try:
            with urllib.request.urlopen(request, timeout=10) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as x:
            return x.code, json.loads(x.read())

    assert ask("POST", "/stream/addChannel", {"channel_id": 20, "url": "rtsp://h/x", "source_type": "RTSP", "sample_interval": 3})[1]["Result"] == [{"Status": 1, "TaskID": 0}]
    assert ask("POST", "/stream/addChannel", {"channel_id": 20})[1]["Code"] == 5008
    assert ask("POST", "/yolox/SetConfThreshold/5001", {"value": 0.9})[1]["Code"] == 0 and e.graphs[0].elements[5001].configure["threshold_conf"] == 0.9
    assert ask("POST", "/yolox/SetConfThreshold/5001", {"value": 9})[1]["Code"] == 5008
    assert ask("POST", "/yolox/SetConfThreshold/7", {"value": 0.9})[1]["Code"] == 1
    assert ask("PUT", "/display-type-blend", {"display_type": 1})[1]["Code"] == 1 and ask("GET", "/config")[1] == {"Code": 0, "Msg": "success", "Result": []}
    assert ask("GET", "/nothing")[0] == 404 and ask("POST", "/stream/addChannel", [1])[0] == 400
    seen = []
    e.set_sink_handler(0, 5006, 0, lambda fs: seen.append({r.channel_id for r in fs["payloads"].select(F.get_json_object("payload", "$.mFrame.mChannelId").cast("int").alias("channel_id")).collect()}))
    e.run(0, {"frames": D.frames(spark, SMALL), "detections": D.detections(spark, SMALL)})
    assert seen and seen[0] <= {20}  # only the started channel's frames come out
    assert ask("POST", "/stream/stopChannel", {"channel_id": 20})[1]["Code"] == 0
    server.shutdown()
