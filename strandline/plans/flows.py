"""Queries of routing, joins, windows, rules, suppression and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.suppression import suppress
from strandline.functions.geometry import iou
from strandline.operators import aggregates as A
from strandline.operators import knn as K
from strandline.operators import routing as T
from strandline.operators import rules as R
from strandline.operators import sampling as S
from strandline.operators import windows as W
from strandline.plans.scans import AREA, CLASSES, WIRE, WITH, _sql_area
from strandline.sources import domain as D
from strandline.sources.tables import table

FRAME, STREAM = D.FRAME, D.STREAM
DK = D.DET
ROUTES = [T.RouteRule([T.Route(["pedestrian", "turnstile"], 1), T.Route(["sedan", "lorry"], 2), T.Route(["sedan"], 3)], frame_interval=2), T.RouteRule([T.Route([], 4), T.Route(["pedestrian"], 1)], frame_interval=3)]
SECONDS = 1.5
#: Frame intervals 2, 3 and 4 to ports 1, 2 and 3; the branch of port 3 is routed again, by class.
LEVELS = [T.RouteRule([T.Route([], port)], frame_interval=every) for port, every in ((1, 2), (2, 3), (3, 4))]
AGAIN, AGAIN_PORT = [T.RouteRule([T.Route(["pedestrian", "turnstile"], 1), T.Route(["sedan", "lorry"], 2)])], 3


#: Which branch results come back.
CAME = "not (port = 2 and frame_id % 7 = 0)"


def _routed(spark, d):
    return T.route(D.frames(spark, d, "eos"), D.detections(spark, d, "class_id"), D.class_names(spark, d), ROUTES, FRAME, STREAM)


def route_class(spark, d):
    """Sub-rows of the class and interval rules, whole-frame rows among them."""
    return _routed(spark, d).select(*FRAME, "sub_id", "port")


def route_full_frame(spark, d):
    return T.fires_by_frame(D.frames(spark, d, "eos"), 3).select(*FRAME, F.lit(-1).alias("sub_id"), F.lit(4).alias("port"))


def route_frame_interval(spark, d):
    """Whole frames to ports 1, 2 and 3 at intervals of 2, 3 and 4."""
    return T.route(D.frames(spark, d, "eos"), D.detections(spark, d, "class_id"), D.class_names(spark, d), LEVELS, FRAME, STREAM).select(*FRAME, "port")


def route_time_interval(spark, d):
    return T.throttle(D.frames(spark, d, "ts"), STREAM, SECONDS)


def branch_totals(spark, d):
    return T.branch_counts(D.frames(spark, d, "eos"), _routed(spark, d), FRAME).select(*FRAME, "branches")


def converge(spark, d):
    """Branch results come back but for those of port 2 on frames divisible by 7; incomplete frames are left out."""
    counted = T.branch_counts(D.frames(spark, d, "eos"), _routed(spark, d), FRAME, F.expr(CAME))
    return T.release(counted, STREAM, strict=False).select(*FRAME, "branches")


def converge_strict(spark, d):
    """As `converge`, but nothing overtakes an incomplete frame of its stream."""
    counted = T.branch_counts(D.frames(spark, d, "eos"), _routed(spark, d), FRAME, F.expr(CAME))
    return T.release(counted, STREAM).select(*FRAME, "branches")


def converge_nested(spark, d):
    """Three parts of each routed row join their parent, which joins its frame; all of them arrive (`converge_levels`: not all)."""
    routed = _routed(spark, d).withColumn("path", F.array("frame_id", "sub_id", "port"))
    inner = routed.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("path", F.concat("path", F.array(F.col("part").cast("long"))))
    parents = inner.groupBy("task_id", T.nested_parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n = 3")
    return parents.groupBy("task_id", F.col("path")[0].alias("frame_id")).agg(F.count(F.lit(1)).alias("branches"))


def _two_levels(spark, d, strict):
    """Frames complete on both levels; second-level results of port 2 on frames divisible by 7 are missing."""
    frames, names = D.frames(spark, d, "eos"), D.class_names(spark, d)
    det = D.detections(spark, d, "class_id")
    outer = T.route(frames, det, names, LEVELS, FRAME, STREAM)
    again = frames.join(outer.where(F.col("port") == AGAIN_PORT), FRAME, "left_semi")
    inner = T.route(again, det, names, AGAIN, FRAME, STREAM)
    joined = T.release(T.branch_counts(again, inner, FRAME, F.expr(CAME)), STREAM, strict=strict).select(*FRAME, F.col("branches").alias("parts"))
    # of the outer branches all come back but the inner ones that aren't complete
    counted = T.branch_counts(frames, outer, FRAME, F.col("port") != AGAIN_PORT).join(joined, FRAME, "left")
    counted = counted.withColumn("received", F.col("received") + F.col("parts").isNotNull().cast("int"))
    return T.release(counted, STREAM, strict=strict).select(*FRAME, "branches", F.coalesce("parts", F.lit(0)).alias("parts"))


def converge_levels(spark, d):
    """Two levels of routing: the results of the second join their branch, complete branches join their frame."""
    return _two_levels(spark, d, strict=False)


def pipeline_levels(spark, d):
    """Two levels of routing, of convergence in order, and the area rule over complete frames."""
    kept = R.in_areas(D.detections(spark, d, "x", "y", "w", "h"), [AREA])
    return _two_levels(spark, d, strict=True).join(kept.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_boxes")), FRAME)


def zip_stitch(spark, d):
    f = D.frames(spark, d, "width", "height")
    left, right = f.where("frame_id % 2 = 0"), f.where("frame_id % 4 = 0")
    return T.zip_ports(left.select(*FRAME, "width", "height"), right.select(*FRAME, "width", "height"), STREAM, "frame_id", "frame_id").select(*FRAME, (F.col("width") + F.col("right_width")).alias("width"), F.greatest("height", "right_height").alias("height"))


def zip_blend(spark, d):
    f = D.frames(spark, d, "width", "height").select(*FRAME, "width", "height")
    z = T.zip_ports(f.where("frame_id % 2 = 0"), f.where("frame_id % 2 = 1"), STREAM, "frame_id")
    return z.select(*FRAME, "right_frame_id", (F.ceil((F.col("width") + F.col("right_width") - 101) / 32) * 32).cast("long").alias("out_w"))


def zip_stereo(spark, d):
    f = D.frames(spark, d, "width", "error_code").select(*FRAME, "width", "error_code")
    return T.zip_on_frame(f, f.where("error_code = 0"), FRAME).select(*FRAME, "right_width")


def _split(spark, d):
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 50 = 0"), v


def knn_top5(spark, d):
    q, g = _split(spark, d)
    return K.knn(q, g, 5).select("query_id", "vec_id", "similarity", F.col("rank").cast("int").alias("rank"))


def knn_top1(spark, d):
    q, g = _split(spark, d)
    return K.nearest_label(q, g, table(spark, d, "embeddings").select("vec_id", "label"))


def iou_join(spark, d):
    """Pairs of a frame's boxes that overlap by more than half, under the +1 pixel convention."""
    a = D.detections(spark, d, "x", "y", "w", "h").select(*FRAME, *[F.col(c).alias(f"a_{c}") for c in ("det_idx", "x", "y", "w", "h")])
    b = D.detections(spark, d, "x", "y", "w", "h").select(*FRAME, *[F.col(c).alias(f"b_{c}") for c in ("det_idx", "x", "y", "w", "h")])
    v = iou(tuple(F.col(f"a_{c}") for c in "xywh"), tuple(F.col(f"b_{c}") for c in "xywh"), 1)
    return a.join(b, FRAME).where("a_det_idx < b_det_idx").withColumn("iou", v).where("iou > 0.5").select(*FRAME, "a_det_idx", "b_det_idx", F.round("iou", 6).alias("iou"))


def nms_agnostic(spark, d):
    return suppress(D.detections(spark, d, "class_id", "score", "x", "y", "w", "h"), FRAME, 0.3).select(*DK, "class_id", "score")


def nms_class_aware(spark, d):
    return suppress(D.detections(spark, d, "class_id", "score", "x", "y", "w", "h"), FRAME, 0.3, class_aware=True).select(*DK, "class_id", "score")


def nms_face(spark, d):
    return suppress(D.detections(spark, d, "class_id", "score", "x", "y", "w", "h"), FRAME, 0.3, plus=1).select(*DK, "class_id", "score")


def rule_direction(spark, d):
    rows = D.detections(spark, d, "x", "y", "w", "h").join(D.tracks(spark, d).where("track_id >= 0"), DK)
    return R.moves_along(rows, STREAM, (1.0, 0.5), 2)


def rule_alert_gating(spark, d):
    rows = D.detections(spark, d, "class_id").join(D.tracks(spark, d).where("track_id >= 0"), DK)
    return R.gate_alerts(rows, STREAM, "track_id", rows, 2, 5).select(*DK, "track_id", F.col("run").cast("long").alias("run"))


def rule_bitmask(spark, d):
    times = [(0, 12 * 3600000)]
    rows = D.detections(spark, d, "class_id", "x", "y", "w", "h").join(D.tracks(spark, d), DK, "left").withColumn("track_id", F.coalesce("track_id", F.lit(-1)))
    rules = [R.Rule(kind=2, classes=CLASSES, areas=[AREA], times=times), R.Rule(kind=2, classes=[0, 1, 2, 3], areas=[WIRE], times=times), R.Rule(kind=1, classes=list(range(20)), areas=[[]], times=times, alert_first=1, alert_skip=3)]
    return R.rule_mask(D.frames(spark, d, "ts"), rows, rules, STREAM).select(*FRAME, "tag")


def fps_totals(spark, d):
    return A.frame_totals(D.frames(spark, d, "ts"), ["task_id"]).select("task_id", "n_frames", "seconds", "fps")


def fps_window(spark, d):
    return A.windowed_rates(D.frames(spark, d, "ts"), STREAM, 50)


def fps_ema(spark, d):
    return A.moving_rate(A.windowed_rates(D.frames(spark, d, "ts"), STREAM, 50), STREAM)


def argmax_label(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.argmax(F.col("embedding")).alias("label_idx"))


def softmax_top1(spark, d):
    p = A.softmax(F.slice("embedding", 1, 10), 4.0)
    return table(spark, d, "embeddings").select("vec_id", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("label_idx"), F.round(F.array_max(p), 6).alias("score"))


def multilabel(spark, d):
    """The first 4 classes; `multilabel_all` takes the whole vector."""
    m = A.multi_label(F.slice("embedding", 1, 4), [0.2, 0.25, 0.28, 0.3])
    return table(spark, d, "embeddings").select("vec_id", *[m[i].alias(f"m{i}") for i in range(4)])


def keypoint_bbox(spark, d):
    pts = F.collect_list(F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.coalesce("score", F.lit(0.0)).alias("score")))
    g = D.detections(spark, d, "x", "y", "score").groupBy(*FRAME).agg(A.keypoint_box(pts, 0.1).alias("b"))
    return g.where("b is not null").select(*FRAME, "b.left", "b.top", "b.right", "b.bottom")


def shoelace_area(spark, d):
    from strandline.functions.geometry import perimeter, shoelace

    x, y, w, h = (F.col(c) for c in "xywh")
    pts = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y + 3), (x + w, y + h), (x + 5, y + h))])
    return D.detections(spark, d, "x", "y", "w", "h").select(*DK, shoelace(pts).alias("area"), F.round(perimeter(pts), 6).alias("round"))


def count_window_label(spark, d):
    rows = D.frames(spark, d, "ts").join(D.detections(spark, d, "class_id").groupBy(*FRAME).agg(F.max("class_id").alias("label")), FRAME, "left").select(*FRAME, "label")
    return W.label_windows(W.count_windows(rows, STREAM, "frame_id", 48), STREAM, "label").select(*FRAME, "window_id", "window_label")


def overlay_carry_forward(spark, d):
    n = D.detections(spark, d, "class_id").groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    rows = S.sample_frames(D.frames(spark, d, "eos"), 3, S.KEEP).join(n, FRAME, "left").select(*FRAME, "filtered", "n")
    return W.carry_forward(rows, STREAM, "n").select(*FRAME, "shown")


def track_set_diff(spark, d):
    return W.tracks_gone(D.tracks(spark, d), STREAM)


def union_ports(spark, d):
    f = D.frames(spark, d, "eos").select(*FRAME)
    return T.port_union(f.where("frame_id % 2 = 0").withColumn("src", F.lit("a")), f.where("frame_id % 3 = 0").withColumn("src", F.lit("b")))


def sub_result_join(spark, d):
    cn = D.class_names(spark, d)
    results = T.sub_ids(D.detections(spark, d, "class_id", "score"), FRAME).select(*FRAME, "sub_id", (F.col("score") * 10).cast("int").alias("label_id"))
    det = T.sub_ids(D.detections(spark, d, "class_id", "score"), FRAME).drop("det_idx").withColumnRenamed("sub_id", "det_idx").select(*FRAME, "det_idx", "class_id")
    return T.sub_result_join(results, det, FRAME, 2, cn.where("class_id < 6"), cn).select(*FRAME, "sub_id", "label")


def box_track_pairs(spark, d):
    """Detections beside their tracks, by position."""
    return D.detections(spark, d, "class_id").join(D.tracks(spark, d), DK).select(*DK, "class_id", "track_id")


def frames_without_boxes(spark, d):
    return D.frames(spark, d, "eos").join(D.detections(spark, d, "class_id"), FRAME, "left_anti").select(*FRAME)


def configured_passthrough(spark, d):
    f = D.frames(spark, d, "channel_id", "eos")
    mask = D.detections(spark, d, "class_id").where("class_id = 1").select(*FRAME).distinct().withColumn("tag", F.lit(1))
    return R.pass_frames(f, mask, f.where("channel_id % 2 = 0"), STREAM).select(*FRAME, "tag")


def report_rollup(spark, d):
    return A.class_rollup(D.detections(spark, d, "channel_id", "class_id", "score"), ["channel_id", "class_id"]).select("channel_id", "class_id", "level", "n_boxes", "mean_score")


def report_cube(spark, d):
    f = D.frames(spark, d, "graph_id", "error_code")
    g = f.cube("graph_id", "error_code").agg(F.count(F.lit(1)).alias("n_frames"), F.grouping_id().cast("int").alias("level"))
    return g.select("graph_id", "error_code", "level", "n_frames")


def report_windowed(spark, d):
    return A.time_windows(D.frames(spark, d, "channel_id", "ts"), ["channel_id"], "10 minutes")


def report_sliding(spark, d):
    return A.time_windows(D.frames(spark, d, "graph_id", "ts"), ["graph_id"], "10 minutes", "5 minutes")


def report_sessions(spark, d):
    return A.sessions(D.frames(spark, d, "ts"), ["task_id"], "5 seconds")


def events_funnel(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


def pipeline_tripwire(spark, d):
    """Sampling, tripwire and class rule, re-join to the frames, alarms with their boxes."""
    frames = S.sample_frames(D.frames(spark, d, "ts", "eos"), 2)
    hits = R.in_areas(R.in_classes(D.detections(spark, d, "class_id", "score", "x", "y", "w", "h"), CLASSES), [WIRE])
    return hits.join(frames.select(*FRAME, "ts"), FRAME).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_boxes"), F.max("score").alias("best"))


def pipeline_structured(spark, d):
    """One level of routing whose branches all come back, and the area rule over the frames; `pipeline_levels` has two levels."""
    frames, det = D.frames(spark, d), D.detections(spark, d)
    routed = T.route(frames, det, D.class_names(spark, d), ROUTES, FRAME, STREAM)
    full = T.release(T.branch_counts(frames, routed, FRAME, F.lit(True)), STREAM)
    kept = R.in_areas(det, [AREA])
    return full.join(kept.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_boxes")), FRAME).select(*FRAME, "branches", "n_boxes")


_SUB = """, sb as (select det.*, cast(row_number() over (partition by task_id, frame_id order by det_idx) - 1 as int) as sub_id, class_name from det left join cn using (class_id)),
r2 as (select task_id, frame_id from fr where frame_id % 2 = 0 or coalesce(eos, false)), r3 as (select task_id, frame_id from fr where frame_id % 3 = 0 or coalesce(eos, false)),
routed as (select task_id, frame_id, sub_id, case when class_name in ('pedestrian','turnstile') then 1 when class_name = 'sedan' then 3 else 2 end as port from sb join r2 using (task_id, frame_id) where class_name in ('pedestrian','turnstile','sedan','lorry')
  union select task_id, frame_id, sub_id, 1 from sb join r3 using (task_id, frame_id) where class_name = 'pedestrian'
  union select task_id, frame_id, -1, 4 from r3),
bc as (select fr.*, cast(coalesce(n, 0) as int) as branches from fr left join (select task_id, frame_id, count(*) as n from routed group by all) using (task_id, frame_id)),
gt as (select bc.*, cast(coalesce(g, 0) as int) as received from bc left join (select task_id, frame_id, count(*) as g from routed where not (port = 2 and frame_id % 7 = 0) group by all) using (task_id, frame_id))
"""


_LEVELS = """, sb as (select task_id, frame_id, det_idx, class_name from det left join cn using (class_id)),
o as (select task_id, frame_id, port from fr, (values (1, 2), (2, 3), (3, 4)) v(port, every) where frame_id % every = 0 or coalesce(eos, false)),
i as (select task_id, frame_id, case when class_name in ('pedestrian','turnstile') then 1 else 2 end as part from sb join (select task_id, frame_id from o where port = 3) using (task_id, frame_id) where class_name in ('pedestrian','turnstile','sedan','lorry')),
ib as (select o.task_id, o.frame_id, cast(count(part) as int) as parts, count(part) filter (not (part = 2 and i.frame_id % 7 = 0)) as got from o left join i on i.task_id = o.task_id and i.frame_id = o.frame_id where port = 3 group by all),
ist as (select task_id, min(frame_id) as stall from ib where got <> parts group by task_id),
ic as (select ib.* from ib left join ist using (task_id) where {inner}),
oc as (select fr.task_id, fr.frame_id, (select count(*) from o where o.task_id = fr.task_id and o.frame_id = fr.frame_id) as n,
  (select count(*) from o where o.task_id = fr.task_id and o.frame_id = fr.frame_id and port <> 3) + (select count(*) from ic where ic.task_id = fr.task_id and ic.frame_id = fr.frame_id) as got from fr),
ost as (select task_id, min(frame_id) as stall from oc where got <> n group by task_id),
fu as (select oc.task_id, oc.frame_id, cast(n as int) as branches, coalesce(parts, 0) as parts from oc left join ic on ic.task_id = oc.task_id and ic.frame_id = oc.frame_id left join ost on ost.task_id = oc.task_id where {outer})
"""


def _nms_sql(shift: str, plus: int) -> str:
    p = f"+{plus}" if plus else ""
    def cut(a, s, k="k"):
        return f"greatest(0.0, least({k}.{a}+{k}.{s}, c.{a}+c.{s}) - greatest({k}.{a}, c.{a}){p})"
    inter = cut("x", "w") + "*" + cut("y", "h")
    return f"""with recursive {D.SQL},
b as (select task_id, frame_id, det_idx, class_id, score, cast(x + {shift} as double) as x, cast(y + {shift} as double) as y, cast(w as double) as w, cast(h as double) as h,
  row_number() over (partition by task_id, frame_id order by score desc, det_idx) as rn from det where score is not null),
go as (select task_id, frame_id, rn, [rn] as kept from b where rn = 1
  union all select c.task_id, c.frame_id, c.rn, case when exists (select 1 from b k where k.task_id = c.task_id and k.frame_id = c.frame_id and list_contains(g.kept, k.rn)
    and (k.w{p})*(k.h{p}) + (c.w{p})*(c.h{p}) - {inter} > 0 and {inter} / ((k.w{p})*(k.h{p}) + (c.w{p})*(c.h{p}) - {inter}) > 0.3) then g.kept else list_append(g.kept, c.rn) end
  from go g join b c on c.task_id = g.task_id and c.frame_id = g.frame_id and c.rn = g.rn + 1),
top as (select task_id, frame_id, max_by(kept, rn) as kept from go group by task_id, frame_id)
select b.task_id, b.frame_id, det_idx, class_id, score from b join top on b.task_id = top.task_id and b.frame_id = top.frame_id and list_contains(top.kept, b.rn)"""


_TR = ", bt as (select * from det join tr using (task_id, frame_id, det_idx) where track_id >= 0)"
_GATE = ", pl as (select task_id, frame_id, row_number() over (partition by task_id order by frame_id) as p from (select distinct task_id, frame_id from {src}))" \
        ", gi as (select s.*, p, p - dense_rank() over (partition by task_id, track_id order by p) as i from {src} s join pl using (task_id, frame_id) where track_id >= 0)" \
        ", gr as (select *, dense_rank() over (partition by task_id, track_id, i order by p) as run from gi)"
_RATE = ", rt as (select task_id, cast(floor(frame_id / 50.0) as bigint) as block, count(*) as n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 as s from fr where ts is not null group by all), rw as (select task_id, block, n, round(n / s, 6) as rate from rt where s > 0)"
_SIM = "cast(list_reduce(list_transform(list_zip(cast(q.embedding as double[]), cast(g.embedding as double[])), lambda x: x[1]*x[2]), lambda a, b: a + b) as double)"
_KNN = f"select q.vec_id as query_id, g.vec_id, round({_SIM}, 6) as similarity from embeddings q, embeddings g where q.vec_id % 50 = 0"
_T12 = "cast(floor(epoch_us(ts) / 1000) as bigint) % 86400000 between 0 and 43200000"

ORACLE = {
    "route_class": WITH + _SUB + "select task_id, frame_id, sub_id, port from routed",
    "route_full_frame": WITH + "select task_id, frame_id, -1 as sub_id, 4 as port from fr where frame_id % 3 = 0 or coalesce(eos,false)",
    "route_frame_interval": WITH + "select task_id, frame_id, port from fr, (values (1, 2), (2, 3), (3, 4)) v(port, every) where frame_id % every = 0 or coalesce(eos, false)",
    "route_time_interval": "with recursive " + D.SQL + f""", o as (select task_id, frame_id, epoch_us(ts) as t, row_number() over (partition by task_id order by ts, frame_id) as rn from fr where ts is not null),
go as (select task_id, frame_id, rn, t as last, true as fire from o where rn = 1
  union all select o.task_id, o.frame_id, o.rn, case when o.t - go.last > {int(SECONDS * 1e6)} then o.t else go.last end, o.t - go.last > {int(SECONDS * 1e6)} from go join o on o.task_id = go.task_id and o.rn = go.rn + 1)
select task_id, frame_id from go where fire""",
    "branch_totals": WITH + _SUB + "select task_id, frame_id, branches from bc",
    "converge": WITH + _SUB + "select task_id, frame_id, branches from gt where received = branches",
    "converge_strict": WITH + _SUB + "select task_id, frame_id, branches from gt left join (select task_id, min(frame_id) as stall from gt where received <> branches group by task_id) using (task_id) where stall is null or frame_id < stall",
    "converge_nested": WITH + _SUB + "select task_id, frame_id, count(*) as branches from routed group by all",
    "converge_levels": WITH + _LEVELS.format(inner="got = parts", outer="oc.got = n") + "select task_id, frame_id, branches, parts from fu",
    "zip_stitch": WITH + """, l as (select *, row_number() over (partition by task_id order by frame_id) as i from fr where frame_id % 2 = 0), r as (select *, row_number() over (partition by task_id order by frame_id) as i from fr where frame_id % 4 = 0)
select l.task_id, l.frame_id, l.width + r.width as width, greatest(l.height, r.height) as height from l join r on l.task_id = r.task_id and l.i = r.i and l.frame_id = r.frame_id""",
    "zip_blend": WITH + """, l as (select *, row_number() over (partition by task_id order by frame_id) as i from fr where frame_id % 2 = 0), r as (select *, row_number() over (partition by task_id order by frame_id) as i from fr where frame_id % 2 = 1)
select l.task_id, l.frame_id, r.frame_id as right_frame_id, cast(ceil((l.width + r.width - 101) / 32.0) * 32 as bigint) as out_w from l join r on l.task_id = r.task_id and l.i = r.i""",
    "zip_stereo": WITH + "select l.task_id, l.frame_id, r.width as right_width from fr l join fr r on l.task_id = r.task_id and l.frame_id = r.frame_id where r.error_code = 0",
    "knn_top5": f"select query_id, vec_id, similarity, cast(row_number() over (partition by query_id order by similarity desc, vec_id) as int) as rank from ({_KNN}) qualify rank <= 5",
    "knn_top1": f"select query_id, label, similarity from ({_KNN}) k join embeddings e on e.vec_id = k.vec_id qualify row_number() over (partition by query_id order by similarity desc, k.vec_id) = 1",
    "iou_join": WITH + """, p as (select a.task_id, a.frame_id, a.det_idx as a_det_idx, b.det_idx as b_det_idx, greatest(0.0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x) + 1) * greatest(0.0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y) + 1) as i,
 cast(a.w+1 as double)*(a.h+1) + cast(b.w+1 as double)*(b.h+1) as s from det a join det b on a.task_id = b.task_id and a.frame_id = b.frame_id and a.det_idx < b.det_idx)
select task_id, frame_id, a_det_idx, b_det_idx, round(i / (s - i), 6) as iou from p where s - i > 0 and i / (s - i) > 0.5""",
    "nms_agnostic": _nms_sql("0", 0),
    "nms_class_aware": _nms_sql("coalesce(class_id, 0) * 7680", 0),
    "nms_face": _nms_sql("0", 1),
    "rule_direction": WITH + _TR + """, n as (select *, row_number() over (partition by task_id, track_id order by frame_id, det_idx) - 1 as n from bt),
e as (select *, x + floor(w / 2.0) as cx, y + floor(h / 2.0) as cy from n where n % 2 = 0),
m as (select task_id, frame_id, (cx - lag(cx) over w) * 1.0 + (cy - lag(cy) over w) * 0.5 as dot from e window w as (partition by task_id, track_id order by frame_id, det_idx))
select distinct task_id, frame_id from m where dot >= 0""",
    "rule_alert_gating": WITH + _TR + _GATE.format(src="bt") + " select task_id, frame_id, det_idx, track_id, run from gr where run > 2 and (run - 3) % 5 = 0",
    "rule_bitmask": WITH + f""", bt as (select det.*, coalesce(track_id, -1) as track_id from det left join tr using (task_id, frame_id, det_idx)), ok as (select task_id, frame_id from fr where {_T12}),
s3 as (select bt.* from bt join ok using (task_id, frame_id) where class_id in ({','.join(map(str, range(20)))}))""" + _GATE.format(src="s3") + f""", bits as (
 select task_id, frame_id, 1 as b from bt join ok using (task_id, frame_id) where class_id in ({','.join(map(str, CLASSES))}) and {_sql_area(AREA)}
 union select task_id, frame_id, 2 from bt join ok using (task_id, frame_id) where class_id in (0,1,2,3) and {_sql_area(WIRE)}
 union select task_id, frame_id, 4 from gr where run > 1 and (run - 2) % 3 = 0) select task_id, frame_id, cast(bit_or(b) as int) as tag from bits group by all""",
    "fps_totals": WITH + ", g as (select task_id, count(*) as n_frames, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 as s from fr group by task_id) select task_id, n_frames, round(s, 6) as seconds, case when s > 0 then round(n_frames / s, 6) end as fps from g",
    "fps_window": WITH + _RATE + " select task_id, block, n, rate from rw",
    "fps_ema": "with recursive " + D.SQL + _RATE + """, o as (select *, row_number() over (partition by task_id order by block) as rn from rw),
go as (select task_id, rn, cast(rate as double) as ema from o where rn = 1 union all select o.task_id, o.rn, go.ema * 0.9 + o.rate * (1 - 0.9) from go join o on o.task_id = go.task_id and o.rn = go.rn + 1)
select task_id, cast(max(rn) as int) as blocks, round(max_by(ema, rn), 3) as ema from go group by task_id""",
    "argmax_label": "select vec_id, case when list_max(embedding) > 0 then cast(list_position(embedding, list_max(embedding)) - 1 as int) else 0 end as label_idx from embeddings",
    "softmax_top1": "with e as (select vec_id, list_transform(cast(embedding[1:10] as double[]), lambda x: exp(x * 4.0)) as v from embeddings) select vec_id, cast(list_position(v, list_max(v)) - 1 as int) as label_idx, round(list_max(v) / list_sum(v), 6) as score from e",
    "multilabel": "with e as (select vec_id, list_transform(cast(embedding[1:4] as double[]), lambda x: exp(x)) as v from embeddings) select vec_id, " + ", ".join(f"cast(v[{i + 1}] / list_sum(v) > {t} as int) as m{i}" for i, t in enumerate([0.2, 0.25, 0.28, 0.3])) + " from e",
    "keypoint_bbox": WITH + 'select task_id, frame_id, min(x) as "left", min(y) as top, max(x) as "right", max(y) as bottom from det where (x <> 0 or y <> 0) and coalesce(score, 0) >= 0.1 group by all',
    "shoelace_area": WITH + """select task_id, frame_id, det_idx, abs(cast((x*(y+3) - y*(x+w)) as double) + ((x+w)*(y+h) - (y+3)*(x+w)) + ((x+w)*(y+h) - (y+h)*(x+5)) + ((x+5)*y - (y+h)*x)) / 2 as area,
 round(sqrt(pow(w,2)+9) + sqrt(pow(h-3,2)) + sqrt(pow(w-5,2)) + sqrt(25+pow(h,2)), 6) as round from det""",
    "count_window_label": WITH + """, r as (select fr.task_id, fr.frame_id, label, cast(floor((row_number() over (partition by fr.task_id order by fr.frame_id) - 1) / 48.0) as bigint) as window_id from fr left join (select task_id, frame_id, max(class_id) as label from det group by all) b on b.task_id = fr.task_id and b.frame_id = fr.frame_id),
v as (select task_id, window_id, label from r where label is not null group by task_id, window_id, label qualify row_number() over (partition by task_id, window_id order by count(*) desc, label) = 1)
select r.task_id, r.frame_id, r.window_id, v.label as window_label from r left join v on v.task_id = r.task_id and v.window_id = r.window_id""",
    "overlay_carry_forward": WITH + """, r as (select fr.task_id, fr.frame_id, fr.frame_id % 3 <> 0 as filtered, n from fr left join (select task_id, frame_id, count(*) as n from det group by all) b on b.task_id = fr.task_id and b.frame_id = fr.frame_id),
g as (select *, sum(cast(not filtered as int)) over (partition by task_id order by frame_id rows unbounded preceding) as grp from r)
select task_id, frame_id, case when grp = 0 then null else first_value(n) over (partition by task_id, grp order by frame_id rows between unbounded preceding and unbounded following) end as shown from g""",
    "track_set_diff": WITH + """, t as (select distinct task_id, frame_id, track_id from tr where track_id >= 0), f as (select task_id, frame_id, lead(frame_id) over (partition by task_id order by frame_id) as nf from (select distinct task_id, frame_id from t))
select t.task_id, t.frame_id, t.track_id from t join f on f.task_id = t.task_id and f.frame_id = t.frame_id where nf is not null and not exists (select 1 from t o where o.task_id = t.task_id and o.frame_id = f.nf and o.track_id = t.track_id)""",
    "union_ports": WITH + "select task_id, frame_id, 'a' as src from fr where frame_id % 2 = 0 union all select task_id, frame_id, 'b' from fr where frame_id % 3 = 0",
    "sub_result_join": WITH + _SUB + ", q as (select *, cast(trunc(score * 10) as int) as lid from sb) select task_id, frame_id, sub_id, case when q.class_id = 2 then case when lid < 6 then c.class_name end else c.class_name end as label from q left join cn c on c.class_id = lid",
    "box_track_pairs": WITH + "select task_id, frame_id, det_idx, class_id, track_id from det join tr using (task_id, frame_id, det_idx)",
    "frames_without_boxes": WITH + "select task_id, frame_id from fr where not exists (select 1 from det where det.task_id = fr.task_id and det.frame_id = fr.frame_id)",
    "configured_passthrough": WITH + ", m as (select distinct task_id, frame_id from det where class_id = 1), c as (select distinct task_id from fr where channel_id % 2 = 0) select fr.task_id, fr.frame_id, case when m.task_id is not null then 1 else 0 end as tag from fr left join m on m.task_id = fr.task_id and m.frame_id = fr.frame_id left join c on c.task_id = fr.task_id where m.task_id is not null or c.task_id is null or coalesce(eos, false)",
    "report_rollup": WITH + "select channel_id, class_id, cast(grouping(channel_id, class_id) as int) as level, count(*) as n_boxes, cast(sum(cast(round(score * 1e6) as bigint)) as double) / nullif(count(score), 0) / 1e6 as mean_score from det group by rollup (channel_id, class_id)",
    "report_cube": WITH + "select graph_id, error_code, cast(grouping(graph_id, error_code) as int) as level, count(*) as n_frames from fr group by cube (graph_id, error_code)",
    "report_windowed": WITH + "select channel_id, time_bucket(interval 10 minutes, ts, timestamp '1970-01-01') as window_start, count(*) as n_frames from fr where ts is not null group by all",
    "report_sliding": WITH + ", w as (select graph_id, unnest([time_bucket(interval 5 minutes, ts, timestamp '1970-01-01'), time_bucket(interval 5 minutes, ts, timestamp '1970-01-01') - interval 5 minutes]) as window_start from fr where ts is not null) select graph_id, window_start, count(*) as n_frames from w group by all",
    "report_sessions": WITH + """, s as (select *, case when ts - lag(ts) over (partition by task_id order by ts) < interval 5 seconds then 0 else 1 end as st from fr where ts is not null), g as (select *, sum(st) over (partition by task_id order by ts rows unbounded preceding) as g from s)
select task_id, min(ts) as session_start, count(*) as n_frames from g group by task_id, g""",
    "events_funnel": "select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 2) as total from events group by event_type",
    "pipeline_tripwire": WITH + f"select task_id, frame_id, count(*) as n_boxes, max(score) as best from det join (select task_id, frame_id from fr where frame_id % 2 = 0 or coalesce(eos, false)) using (task_id, frame_id) where class_id in ({','.join(map(str, CLASSES))}) and {_sql_area(WIRE)} group by all",
    "pipeline_structured": WITH + _SUB + f"select bc.task_id, bc.frame_id, branches, n_boxes from bc join (select task_id, frame_id, count(*) as n_boxes from det where {_sql_area(AREA)} group by all) k on k.task_id = bc.task_id and k.frame_id = bc.frame_id",
    "pipeline_levels": WITH + _LEVELS.format(inner="stall is null or frame_id < stall", outer="stall is null or oc.frame_id < stall") + f"select task_id, frame_id, branches, parts, n_boxes from fu join (select task_id, frame_id, count(*) as n_boxes from det where {_sql_area(AREA)} group by all) k using (task_id, frame_id)",
}
QUERIES = {k: globals()[k] for k in ORACLE}
