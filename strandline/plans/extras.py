"""Queries of array helpers, set operations, analytic windows and star-schema reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import aggregates as A
from strandline.operators import outlines as O
from strandline.plans.scans import DK, WITH, _box
from strandline.sources import domain as D
from strandline.sources.tables import table

XYWH = ("x", "y", "w", "h")
#: A threshold for each of the 64 classes of a vector.
LIMITS = [round(0.014 + 0.0001 * (i % 32), 4) for i in range(64)]


def rotated_boxes(spark, d):
    x, y, w, h = _box()
    r = (F.col("det_idx") % 8) * 0.4
    names = ["x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"]
    return D.detections(spark, d, *XYWH).select(*DK, *[c.cast("int").alias(n) for c, n in zip(G.rotated_corners(x.cast("double"), y.cast("double"), w + 0.25, h + 0.25, r), names)])


def regular_angles(spark, d):
    w, h, r = G.regular_angle(F.col("w"), F.col("h"), (F.col("det_idx") % 9) * 0.5)
    return D.detections(spark, d, *XYWH).select(*DK, w.alias("long_side"), h.alias("short_side"), F.round(r, 6).alias("angle"))


def clockwise_corners(spark, d):
    x, y, w, h = _box()
    pts = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x + w, y + h), (x, y + h + 1), (x + w + 1, y), (x + 1, y))])
    p = O.clockwise(pts)
    return D.detections(spark, d, *XYWH).where("w > 0 and h > 0").select(*DK, *[p[i][c].alias(f"{c}{i}") for i in range(4) for c in "xy"])


def disparity_bytes(spark, d):
    """The first 8 elements, scaled among themselves; `disparity_bytes_all` takes the whole vector."""
    v = A.scale_to_byte(F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double"), 4)))
    return table(spark, d, "embeddings").select("vec_id", *[v[i].alias(f"b{i}") for i in range(8)])


def disparity_bytes_all(spark, d):
    v = A.scale_to_byte(F.transform("embedding", lambda x: F.round(x.cast("double"), 4)))
    return table(spark, d, "embeddings").select("vec_id", v.alias("bytes"))


def lut_map(spark, d):
    v = O.look_up(F.array(F.col("det_idx") % 256, F.abs(F.col("x")) % 256, F.col("w")), [255 - i for i in range(256)])
    return D.detections(spark, d, *XYWH).select(*DK, v[0].alias("a"), v[1].alias("b"), v[2].alias("c"))


def _task():
    return F.element_at(F.array(F.lit("FeatureExtract"), F.lit("SingleLabel"), F.lit("MultiLabel")), (F.col("vec_id") % 3 + 1).cast("int"))


def classify_tasks(spark, d):
    """The first 4 classes; `classify_tasks_all` takes the whole vector."""
    c = O.classify(F.slice("embedding", 1, 4), _task(), [0.2, 0.25, 0.28, 0.3])
    return table(spark, d, "embeddings").select("vec_id", c.alias("c")).select("vec_id", "c.label", F.round("c.score", 6).alias("score"), F.col("c.labels")[1].alias("second"))


def classify_tasks_all(spark, d):
    c = O.classify(F.col("embedding"), _task(), LIMITS)
    return table(spark, d, "embeddings").select("vec_id", c.alias("c")).select("vec_id", "c.label", F.round("c.score", 6).alias("score"), "c.labels")


def multilabel_all(spark, d):
    """As `multilabel`, over all 64 classes."""
    return table(spark, d, "embeddings").select("vec_id", A.multi_label(F.col("embedding"), LIMITS).alias("labels"))


def interval_list(spark, d):
    v = O.merged_intervals(F.collect_list("sample_interval"))
    return table(spark, d, "yolox_demo").groupBy("demo_id").agg(v.alias("v")).select("demo_id", F.size("v").alias("n"), F.try_element_at("v", F.lit(1)).alias("least"))


def track_as_of(spark, d):
    """The last error code seen in a stream at or before each tracked box's frame."""
    err = D.frames(spark, d, "error_code").where("error_code <> 0")
    return O.as_of(D.tracks(spark, d).select("task_id", "frame_id").distinct(), err, ["task_id"], "frame_id", "error_code")


def set_intersect(spark, d):
    return D.tracks(spark, d).select("task_id", "frame_id").intersect(D.detections(spark, d, "class_id").where("class_id = 0").select("task_id", "frame_id"))


def set_except(spark, d):
    return D.frames(spark, d, "eos").select("task_id", "frame_id").exceptAll(D.tracks(spark, d).select("task_id", "frame_id").distinct())


def analytic_windows(spark, d):
    w = Window.partitionBy("task_id").orderBy("frame_id")
    return D.frames(spark, d, "ts").select("task_id", "frame_id", F.lead("frame_id").over(w).alias("next_frame"), (F.col("frame_id") - F.lag("frame_id").over(w)).alias("gap"), F.rank().over(w).alias("place"), F.ntile(4).over(w).alias("quarter"))


def class_share(spark, d):
    """Boxes of each class and their share of the channel's."""
    n = D.detections(spark, d, "channel_id", "class_id").groupBy("channel_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("channel_id")), 4))


def report_pricing(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 1).alias("revenue"), F.count(F.lit(1)).alias("n"))


def report_shipping(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount")
    g = o.join(c, "o_custkey").join(li, "o_orderkey").groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return g.orderBy(F.col("revenue").desc(), "o_orderkey").limit(10)


def report_nations(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    li = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"))


_ANG = "case when h > w then ((det_idx % 9) * 0.5 + 3.141592653589793 / 2) else (det_idx % 9) * 0.5 end"


def _corner(sa: str, sb: str, axis: str) -> str:
    c, s = "cos(r)", "sin(r)"
    v = (f"(w+0.25)/2*{c}", f"-(h+0.25)/2*{s}") if axis == "x" else (f"(w+0.25)/2*{s}", f"(h+0.25)/2*{c}")
    return f"cast(round({axis} {sa} ({v[0]}) {sb} ({v[1]})) as int)"


_SM = "list_transform(cast(embedding[1:4] as double[]), lambda x: exp(x))"
_ALL = f"with e as (select vec_id, list_transform(cast(embedding as double[]), lambda x: exp(x)) as v, cast({LIMITS} as double[]) as t from embeddings), p as (select vec_id, v, list_sum(v) as s, list_transform(range(1, 65), lambda i: cast(v[i] / list_sum(v) > t[i] as int)) as m from e) "
ORACLE = {
    "rotated_boxes": WITH + ", q as (select *, (det_idx % 8) * 0.4 as r from det) select task_id, frame_id, det_idx, " + ", ".join(f"{_corner(a, b, ax)} as {ax}{i}" for i, (a, b) in enumerate([("+", "+"), ("+", "-"), ("-", "-"), ("-", "+")], 1) for ax in "xy") + " from q",
    "regular_angles": WITH + f"select task_id, frame_id, det_idx, greatest(w, h) as long_side, least(w, h) as short_side, round(({_ANG}) - 3.141592653589793 * floor(({_ANG}) / 3.141592653589793), 6) as angle from det",
    "clockwise_corners": WITH + "select task_id, frame_id, det_idx, x+1 as x0, y as y0, x+w+1 as x1, y as y1, x+w as x2, y+h as y2, x as x3, y+h+1 as y3 from det where w > 1 and h > 0 union all select task_id, frame_id, det_idx, x+1, y, x+w+1, y, x+w, y+h, x, y+h+1 from det where w = 1 and h > 0",
    "disparity_bytes": "with v as (select vec_id, list_transform(cast(embedding[1:8] as double[]), lambda x: round(x, 4)) as v from embeddings) select vec_id, " + ", ".join(f"cast(trunc((v[{i + 1}] - list_min(v)) / (list_max(v) - list_min(v)) * 255) as int) as b{i}" for i in range(8)) + " from v",
    "disparity_bytes_all": "with v as (select vec_id, list_transform(cast(embedding as double[]), lambda x: round(x, 4)) as v from embeddings), b as (select vec_id, v, list_min(v) as lo, list_max(v) as hi from v) select vec_id, list_transform(v, lambda x: case when hi > lo then cast(trunc((x - lo) / (hi - lo) * 255) as int) else 0 end) as bytes from b",
    "lut_map": WITH + "select task_id, frame_id, det_idx, 255 - det_idx % 256 as a, 255 - abs(x) % 256 as b, case when w between 0 and 255 then 255 - w end as c from det",
    "classify_tasks": f"with e as (select vec_id, {_SM} as v from embeddings) select vec_id, case when vec_id % 3 = 1 then cast(list_position(v, list_max(v)) - 1 as int) end as label, case when vec_id % 3 = 1 then round(list_max(v) / list_sum(v), 6) end as score, case when vec_id % 3 = 2 then cast(v[2] / list_sum(v) > 0.25 as int) end as second from e",
    "classify_tasks_all": _ALL + "select vec_id, case when vec_id % 3 = 1 then cast(list_position(v, list_max(v)) - 1 as int) end as label, case when vec_id % 3 = 1 then round(list_max(v) / s, 6) end as score, case when vec_id % 3 = 2 then m end as labels from p",
    "multilabel_all": _ALL + "select vec_id, m as labels from p",
    "interval_list": "select demo_id, cast(count(distinct sample_interval) as int) as n, min(sample_interval) as least from yolox_demo group by demo_id",
    "track_as_of": WITH + ", t as (select distinct task_id, frame_id from tr), e as (select task_id, frame_id, max(error_code) as error_code from fr where error_code <> 0 group by all) select t.task_id, t.frame_id, e.error_code as as_of from t asof left join e on t.task_id = e.task_id and t.frame_id >= e.frame_id",
    "set_intersect": WITH + "select task_id, frame_id from tr intersect select task_id, frame_id from det where class_id = 0",
    "set_except": WITH + "select task_id, frame_id from fr except all select * from (select distinct task_id, frame_id from tr)",
    "analytic_windows": WITH + "select task_id, frame_id, lead(frame_id) over w as next_frame, frame_id - lag(frame_id) over w as gap, cast(rank() over w as int) as place, cast(ntile(4) over w as int) as quarter from fr window w as (partition by task_id order by frame_id)",
    "class_share": WITH + ", n as (select channel_id, class_id, count(*) as n from det group by all) select *, round(n / cast(sum(n) over (partition by channel_id) as double), 4) as share from n",
    "report_pricing": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 1) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all",
    "report_shipping": "select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by all order by revenue desc, o_orderkey limit 10",
    "report_nations": "select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
}
QUERIES = {k: globals()[k] for k in ORACLE}
