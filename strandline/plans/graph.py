"""Graph configurations to plans: parsing, validation, operator registry, compilation."""

from __future__ import annotations

import importlib
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import routing, rules, sampling, tracking
from strandline.operators.models import ModelSpec, detect


@dataclass
class Element:
    element_id: int
    name: str
    configure: dict = field(default_factory=dict)
    inner: list[int] = field(default_factory=list)
    sources: list[int] = field(default_factory=list)
    sinks: list[int] = field(default_factory=list)
    thread_number: int = 1
    shared_object: str | None = None


@dataclass
class Edge:
    src: int
    src_port: int
    dst: int
    dst_port: int


@dataclass
class Graph:
    graph_id: int
    elements: dict[int, Element]
    edges: list[Edge]


class ConfigError(ValueError):
    pass


#: Flow of an element's input: relation name -> DataFrame (frames, detections, tracks, routed, ...).
FrameSet = dict[str, DataFrame]
_REGISTRY: dict[str, "Operator"] = {}
#: By element name: a ModelSpec for detectors, or a function (element, relations) -> relations for models that run elsewhere.
MODEL_SLOTS: dict[str, "ModelSpec | Callable[[Element, FrameSet], FrameSet]"] = {}


@dataclass
class Operator:
    """What an element does: `plan(element, inputs by port)` -> outputs by port. `needs`: relations it must be given."""

    name: str
    plan: Callable[[Element, dict[int, FrameSet]], dict[int, FrameSet]]
    needs: tuple[str, ...] = ("frames",)
    group: bool = False


def register(name: str, needs: tuple[str, ...] = ("frames",), group: bool = False):
    """Registers the decorated plan under an element name; a name may be given once."""
    def add(plan):
        if name in _REGISTRY:
            raise ConfigError(f"operator {name!r} is registered already")
        _REGISTRY[name] = Operator(name, plan, needs, group)
        return plan

    return add


def operator(name: str) -> Operator:
    base = name.removesuffix("_group")
    found = _REGISTRY.get(name) or _REGISTRY.get(base)
    if found is None or (name.endswith("_group") and name not in _REGISTRY and not found.group):
        raise ConfigError(f"no operator {name!r}")
    return found


def load_plugin(module: str) -> None:
    """Imports a module that registers operators of its own."""
    importlib.import_module(module)


def operators() -> list[str]:
    return sorted(n for o in _REGISTRY.values() for n in ([o.name, f"{o.name}_group"] if o.group else [o.name]))


def parse_graph(spec: dict, base: str = ".", load: Callable[[str], dict] | None = None) -> Graph:
    """A graph from its JSON. `element_config` may be a path (relative to `base`), read once, or the object itself."""
    def read(path: str) -> dict:
        with open(os.path.join(base, path), encoding="utf-8") as f:
            return json.load(f)

    elements: dict[int, Element] = {}
    for e in spec.get("elements", []):
        body = e.get("element_config", e)
        body = (load or read)(body) if isinstance(body, str) else body
        i = int(e["element_id"])
        if i in elements:
            raise ConfigError(f"element id {i} stands twice")
        ports = e.get("ports", {})
        elements[i] = Element(i, body["name"], body.get("configure", {}), [int(x) for x in e.get("inner_elements_id", [])], [p["port_id"] for p in ports.get("input", []) if p.get("is_src")], [p["port_id"] for p in ports.get("output", []) if p.get("is_sink")], int(body.get("thread_number", 1)), body.get("shared_object"))
    edges = [Edge(int(c.get("src_element_id", c.get("src_id", -1))), int(c.get("src_port", 0)), int(c.get("dst_element_id", c.get("dst_id", -1))), int(c.get("dst_port", 0))) for c in spec.get("connections", [])]
    return Graph(int(spec.get("graph_id", 0)), elements, edges)


def validate(g: Graph) -> list[int]:
    """Element ids in order of flow; raises where the graph can't run."""
    inner = {x: e.element_id for e in g.elements.values() for x in e.inner}
    for e in g.edges:
        e.src, e.dst = inner.get(e.src, e.src), inner.get(e.dst, e.dst)
        for end in (e.src, e.dst):
            if end not in g.elements:
                raise ConfigError(f"connection names element {end}, which isn't there")
    outs = [(e.src, e.src_port) for e in g.edges]
    if len(set(outs)) < len(outs):
        raise ConfigError("an output port may have one consumer")
    if not any(e.sources for e in g.elements.values()) or not any(e.sinks for e in g.elements.values()):
        raise ConfigError("a graph needs a source port and a sink port")
    for e in g.elements.values():
        operator(e.name)
    left = {i: sum(x.dst == i for x in g.edges) for i in g.elements}
    ready, order = sorted(i for i, n in left.items() if not n), []
    while ready:
        i = ready.pop(0)
        order.append(i)
        for x in g.edges:
            if x.src == i:
                left[x.dst] -= 1
                if not left[x.dst]:
                    ready.append(x.dst)
    if len(order) < len(g.elements):
        raise ConfigError("the graph has a cycle")
    return order


def compile_graph(g: Graph, source: FrameSet) -> dict[tuple[int, int], FrameSet]:
    """(element, port) -> relations at every sink of the graph; nothing runs until a sink's relation is used.

    An input port with several producers takes all their rows.
    """
    flows: dict[tuple[int, int], FrameSet] = {}
    out: dict[tuple[int, int], FrameSet] = {}
    for i in validate(g):
        e = g.elements[i]
        inputs: dict[int, FrameSet] = {p: dict(source) for p in e.sources}
        for x in (x for x in g.edges if x.dst == i):
            got = flows.get((x.src, x.src_port))
            if got is None:
                raise ConfigError(f"element {x.src} has no output port {x.src_port}")
            have = inputs.get(x.dst_port)
            inputs[x.dst_port] = got if have is None else {k: have[k].unionByName(got[k], allowMissingColumns=True) if k in have and k in got else have.get(k, got.get(k)) for k in {*have, *got}}
        op = operator(e.name)
        for p, fs in inputs.items():
            missing = [n for n in op.needs if n not in fs]
            if missing:
                raise ConfigError(f"{e.name} (element {i}, port {p}) lacks {', '.join(missing)}")
        for p, fs in op.plan(e, inputs).items():
            flows[(i, p)] = fs
            if p in e.sinks:
                out[(i, p)] = fs
    return out


FRAME, STREAM = ["task_id", "frame_id"], ["task_id"]


@register("blank")
def _blank(e, inputs):
    return inputs


@register("decode")
def _decode(e, inputs):
    fs = dict(inputs[min(inputs)])
    c = e.configure
    f = fs["frames"]
    if int(c.get("loop_num", 1)) > 1:
        f = sampling.replay(f, int(c["loop_num"])).drop("loop")
    kept = sampling.sample_frames(f, int(c.get("sample_interval", 1)), c.get("sample_strategy", sampling.DROP))
    fs["frames"] = kept
    if "detections" in fs and c.get("sample_strategy", sampling.DROP) == sampling.DROP:
        fs["detections"] = fs["detections"].join(kept.select(*FRAME), FRAME, "left_semi")
    return {0: fs}


def _decode_tensors(e, fs: FrameSet) -> FrameSet:
    """The relation that a model element's decoder makes of its outputs (`tensors`: frame columns, t0, t1, ...), by task_type where it has one."""
    from strandline.operators import decoders

    try:
        fn, fields, relation = decoders.of_element(e.name.removesuffix("_group"), e.configure)
    except KeyError as missing:
        raise ConfigError(f"{e.name} (element {e.element_id}) has no decoder for {missing}") from None
    tensors = sorted((c for c in fs["tensors"].columns if re.fullmatch(r"t\d+", c)), key=lambda c: int(c[1:]))
    rows = decoders.table_function(fs["tensors"], FRAME, tensors, fn, fields)
    return {**fs, relation: rows.withColumnRenamed("idx", "det_idx")}


def _over_threshold(e, fs: FrameSet) -> DataFrame:
    """Detections above threshold_conf: one number, or one for each class, by number or by name."""
    thr = e.configure.get("threshold_conf", 0.0)
    if not isinstance(thr, dict):
        return rules.class_threshold(fs["detections"], float(thr))
    if all(re.fullmatch(r"-?\d+", str(k)) for k in thr):
        return rules.class_threshold(fs["detections"], {int(k): float(v) for k, v in thr.items()})
    if "names" not in fs:
        raise ConfigError(f"{e.name} (element {e.element_id}) has thresholds by name and lacks names")
    limits = fs["names"].sparkSession.createDataFrame([(str(k), float(v)) for k, v in thr.items()], "class_name string, __limit double")
    by_class = fs["names"].join(F.broadcast(limits), "class_name").groupBy("class_id").agg(F.min("__limit").alias("__limit"))
    return fs["detections"].join(F.broadcast(by_class), "class_id").where(F.col("score") > F.col("__limit")).select(fs["detections"].columns)


def _model(e, inputs):
    """Thresholds and suppression over the detections given as a relation, or made by the ModelSpec of the element's name or
    from the relation `tensors`."""
    from strandline.functions.suppression import suppress

    fs = dict(inputs[min(inputs)])
    if isinstance(spec := MODEL_SLOTS.get(e.name.removesuffix("_group")), ModelSpec):
        fs["detections"] = detect(fs["frames"], spec)
    elif "tensors" in fs:
        return {0: _decode_tensors(e, fs)}
    det = _over_threshold(e, fs)
    if "threshold_nms" in e.configure:
        keep = suppress(det, FRAME, float(e.configure["threshold_nms"]), class_aware=e.name.startswith(("yolov5", "yolov8")), plus=int(e.name.startswith("retinaface")))
        det = det.join(keep.select(*FRAME, "det_idx"), [*FRAME, "det_idx"], "left_semi")
    fs["detections"] = det
    return {0: fs}


for _name in ("yolov5", "yolov7", "yolov8", "yolox", "retinaface"):
    register(_name, ("frames",), group=True)(_model)


def _slot(e, inputs):
    """A model slot: MODEL_SLOTS of the element's name, or its decoder over the relation `tensors`; an empty slot is an error."""
    fs = dict(inputs[min(inputs)])
    fn = MODEL_SLOTS.get(e.name.removesuffix("_group"))
    if isinstance(fn, ModelSpec):
        raise ConfigError(f"the slot of {e.name} takes a function, not a ModelSpec")
    if fn:
        return {0: fn(e, fs)}
    if "tensors" in fs:
        return {0: _decode_tensors(e, fs)}
    if e.name.removesuffix("_group") == "template":
        return {0: fs}
    raise ConfigError(f"{e.name} (element {e.element_id}) has an empty model slot")


@register("resize")
def _resize(e, inputs):
    """Frames stretched to dst_w x dst_h; an `image` of raw pixels must come through a slot."""
    fs = dict(inputs[min(inputs)])
    if fn := MODEL_SLOTS.get("resize"):
        return {0: fn(e, fs)}
    w, h = e.configure.get("dst_w"), e.configure.get("dst_h")
    if w and h:
        fs["frames"] = fs["frames"].withColumn("width", F.lit(int(w))).withColumn("height", F.lit(int(h)))
    return {0: fs}


for _name in ("resnet", "lprnet", "ppocr_det", "ppocr_rec", "openpose", "fastpose", "posec3d", "lightstereo", "template", "dwa", "dpu", "ive"):
    register(_name, group=_name not in ("resnet", "lightstereo", "dwa", "dpu", "ive"))(_slot)


@register("bytetrack", ("frames", "detections"))
def _bytetrack(e, inputs):
    fs = dict(inputs[min(inputs)])
    names = tracking.TrackerConfig.__dataclass_fields__
    fs["tracked"] = tracking.track(fs["frames"], fs["detections"], tracking.TrackerConfig(**{k: v for k, v in e.configure.items() if k in names}))
    fs["detections"] = fs["tracked"].withColumn("det_idx", F.row_number().over(Window.partitionBy(*FRAME).orderBy("track_id")) - 1)
    return {0: fs}


def rule_of(spec: dict) -> rules.Rule:
    """One filter entry of a configuration; both spellings of the first-frame key are read."""
    return rules.Rule(int(spec.get("type", 0)), list(spec.get("classes", [])), [[(p["left"], p["top"]) for p in a] for a in spec.get("areas", [])], [(rules.day_ms(t["time_start"]), rules.day_ms(t["time_end"])) for t in spec.get("times", [])], tuple(spec.get("direction", (0.0, 0.0))), int(spec.get("trajectory_interval", 1)), int(spec.get("alert_first_frame", spec.get("alert_first_frames", 0))), int(spec.get("alert_frame_skip_nums", 1)))


@register("filter", ("frames", "detections"))
def _filter(e, inputs):
    fs = dict(inputs[min(inputs)])
    frames, det = fs["frames"], fs["detections"]
    det = det if "track_id" in det.columns else det.withColumn("track_id", F.lit(-1).cast("long"))
    mask, alike = None, {}
    for entry in e.configure.get("rules", []):  # channels with the same rules are one plan
        alike.setdefault(json.dumps(entry["filters"], sort_keys=True), (entry["filters"], []))[1].append(int(entry["channel_id"]))
    channels = [c for _, some in alike.values() for c in some]
    for filters, some in alike.values():
        mine = frames.where(F.col("channel_id").isin(some))
        one = rules.rule_mask(mine, det.join(mine.select(*FRAME), FRAME, "left_semi"), [rule_of(x) for x in filters], STREAM)
        mask = one if mask is None else mask.unionByName(one)
    if mask is not None:
        fs["frames"] = rules.pass_frames(frames, mask, frames.where(F.col("channel_id").isin(channels)), STREAM)
        fs["detections"] = fs["detections"].join(fs["frames"].select(*FRAME), FRAME, "left_semi")
    return {0: fs}


def route_rules(spec: dict) -> list[routing.RouteRule]:
    return [routing.RouteRule([routing.Route(list(x.get("classes", [])), int(x["port"])) for x in r.get("routes", [])], r.get("frame_interval"), r.get("time_interval")) for r in spec.get("rules", [])]


@register("distributor", ("frames", "detections", "names"))
def _distributor(e, inputs):
    fs = dict(inputs[min(inputs)])
    rs = route_rules(e.configure)
    routed = routing.route(fs["frames"], fs["detections"], fs["names"], rs, FRAME, STREAM)
    main = {**fs, "frames": routing.branch_counts(fs["frames"], routed, FRAME)}
    ports = {int(e.configure.get("default_port", 0)): main}
    for p in {x.port for r in rs for x in r.routes}:
        branch = routed.where(F.col("port") == p)
        ports[p] = {**fs, "frames": fs["frames"].join(branch.select(*FRAME).distinct(), FRAME, "left_semi"), "branch": branch}
    return ports


@register("converger")
def _converger(e, inputs):
    main = dict(inputs[int(e.configure.get("default_port", 0))])
    back = None
    for p, fs in inputs.items():
        if "branch" in fs and p != int(e.configure.get("default_port", 0)):
            back = fs["branch"] if back is None else back.unionByName(fs["branch"])
    if back is not None:
        main["frames"] = routing.converge(main["frames"], back, FRAME, STREAM).drop("branches", "received")
    return {0: main}


@register("faiss", ("frames", "features", "gallery"))
def _faiss(e, inputs):
    from strandline.operators.knn import nearest_label

    fs = dict(inputs[min(inputs)])
    fs["recognitions"] = nearest_label(fs["features"], fs["gallery"], fs["gallery"].select("vec_id", "label"))
    return {0: fs}


def _zip(e, inputs):
    """Pairs the frames of the two lowest ports; a stitch also gives the joint size."""
    a, b = (inputs[p] for p in sorted(inputs)[:2])
    f = routing.zip_on_frame(a["frames"], b["frames"].select(*FRAME, "width", "height"), FRAME)
    if e.name == "stitch":
        tall = str(e.configure.get("stitch_mode", "HORIZONTAL")).upper() == "VERTICAL"
        f = f.withColumn("width", F.greatest("width", "right_width") if tall else F.col("width") + F.col("right_width")).withColumn("height", F.col("height") + F.col("right_height") if tall else F.greatest("height", "right_height"))
    return {0: {**a, "frames": f.drop("right_width", "right_height")}}


for _name in ("stitch", "blend"):
    register(_name)(_zip)
register("qt_display")(_blank)


def _unless_skipped(e, frames: DataFrame) -> DataFrame:
    """Frames whose bypass list doesn't name the element."""
    return frames.where(rules.keeps_element(F.col("skip_elements"), e.element_id)) if "skip_elements" in frames.columns else frames


@register("osd")
def _osd(e, inputs):
    """Adds `overlay`: what is drawn on each frame, as commands."""
    from strandline.sources.sinks import draw_commands

    fs = dict(inputs[min(inputs)])
    if "detections" in fs and "names" in fs:
        fs["overlay"] = draw_commands(fs["detections"].join(_unless_skipped(e, fs["frames"]).select(*FRAME), FRAME, "left_semi"), FRAME, fs["names"])
    return {0: fs}


@register("encode")
def _encode(e, inputs):
    """Adds `encoded`: where each frame goes; the transport is a slot."""
    from strandline.sources.sinks import encode_url

    fs = dict(inputs[min(inputs)])
    c = e.configure
    if {"graph_id", "channel_id"} <= set(fs["frames"].columns):
        at = encode_url(str(c.get("encode_type", "IMG_DIR")), F.col("graph_id"), F.col("channel_id"), c.get("ip", "localhost"), int(c.get("wss_port" if c.get("encode_type") == "WS" else "port", 8554)), c.get("prefix", ""), str(c.get("codec", "")).startswith("h265"))
        fs["encoded"] = _unless_skipped(e, fs["frames"]).select(*FRAME, at.alias("address"))
    return {0: fs}


@register("http_push")
def _http_push(e, inputs):
    """Adds `payloads`, the frames' JSON without end markers, and, where an address is configured, `pushed`: posting them when it is read."""
    from strandline.sources import sinks

    fs = dict(inputs[min(inputs)])
    if "detections" in fs and {"graph_id", "channel_id", "fps", "ts"} <= set(fs["frames"].columns):
        tracks = fs.get("tracks", fs["detections"].select(*FRAME, "det_idx", "track_id") if "track_id" in fs["detections"].columns else None)
        if tracks is None:
            tracks = fs["detections"].select(*FRAME, "det_idx", F.lit(-1).cast("long").alias("track_id")).limit(0)
        frames = fs["frames"].where(~F.coalesce("eos", F.lit(False)))
        fs["payloads"] = sinks.frame_json(frames, fs["detections"], tracks, FRAME)
        c = e.configure
        if "ip" in c and "port" in c:
            fs["pushed"] = sinks.push(fs["payloads"], f"http://{c['ip']}:{c['port']}{c.get('path', '/')}")
    return {0: fs}
