"""Queries of scans, sampling, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import rules as R
from strandline.operators import sampling as S
from strandline.sources import domain as D
from strandline.sources.tables import table

WITH = "with " + D.SQL
LOOPS = 3
NET = 640
AREA = [(200, 100), (1500, 150), (1700, 900), (300, 1000)]
CONCAVE = [(100, 100), (1800, 100), (1800, 1000), (950, 500), (100, 1000)]
WIRE = [(100, 540), (1800, 560)]
CLASSES = [0, 1, 2, 5, 9]
THRESHOLDS = {0: 0.5, 1: 0.25, 2: 0.6, 5: 0.4}
TIMES = [(6 * 3600000, 9 * 3600000), (18 * 3600000, 20 * 3600000 + 1)]
def _box():
    return [F.col(c) for c in "xywh"]


DK = ["task_id", "frame_id", "det_idx"]


def scan_frames(spark, d):
    """Frame numbers over the frames that have a timestamp only; `scan_frames_all` numbers every frame of a run."""
    return S.number_frames(D.frames(spark, d, "ts").where("ts is not null"), ["task_id"], ["ts", "frame_id"]).select("task_id", "frame_id", "frame_no")


def scan_frames_all(spark, d):
    """Every frame of a run numbered from 0 by time; one without a timestamp stands behind the last timed frame of a lower frame id."""
    f = S.carry_time(D.frames(spark, d, "ts"), ["task_id"], "ts", "frame_id")
    return S.number_frames(f, ["task_id"], [F.col("ts").asc_nulls_first(), "frame_id"]).select("task_id", "frame_id", "frame_no")


def sample_drop(spark, d):
    return S.sample_frames(D.frames(spark, d, "eos"), 5).select("task_id", "frame_id")


def sample_keep(spark, d):
    return S.sample_frames(D.frames(spark, d, "eos"), 4, S.KEEP).select("task_id", "frame_id", "filtered")


def loop_replay(spark, d):
    return S.replay(D.frames(spark, d), LOOPS).select("task_id", "loop", "frame_id")


def channel_densify(spark, d):
    seen = table(spark, d, "request_add_channel").where("graph_id is not null and channel_id is not null").groupBy("graph_id", "channel_id").agg(F.min(F.coalesce("received_at", F.lit("9999-01-01").cast("timestamp_ntz"))).alias("first_seen"))
    return S.densify_channels(seen).select("graph_id", "channel_id", F.col("channel_idx").cast("int").alias("channel_idx"))


def roi_scan(spark, d):
    demo = table(spark, d, "yolox_demo").select("cfg_row_id", "roi_left", "roi_top", "roi_width", "roi_height", F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return S.crop_region(demo, F.col("roi_left"), F.col("roi_top"), F.col("roi_width"), F.col("roi_height")).select("cfg_row_id", "roi_x", "roi_y", "roi_w", "roi_h")


def eos_streams(spark, d):
    return D.frames(spark, d, "eos").groupBy("task_id").agg(F.max(F.coalesce("eos", F.lit(False)).cast("int")).alias("ended"), F.max("frame_id").alias("last_frame"))


def source_types(spark, d):
    return table(spark, d, "yolox_demo").where("url is not null").select("cfg_row_id", S.url_source_type(F.col("url")).alias("source"))


def box_clip(spark, d):
    f = D.frames(spark, d, "width", "height")
    c = G.clip_box(*_box(), F.col("width"), F.col("height"))
    return D.detections(spark, d, "x", "y", "w", "h").join(f, ["task_id", "frame_id"]).select(*DK, *[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))])


def letterbox_inverse(spark, d):
    f = D.frames(spark, d, "width", "height").where("width > 0 and height > 0")
    ratio, tx, ty = G.letterbox(F.col("width"), F.col("height"), NET, NET)
    return D.detections(spark, d, "x", "y").join(f, ["task_id", "frame_id"]).select(*DK, F.round((F.col("x") % NET - tx) / ratio, 4).alias("sx"), F.round((F.col("y") % NET - ty) / ratio, 4).alias("sy"))


def roi_offset(spark, d):
    left, top = 64, 32
    return D.detections(spark, d, "x", "y").select(*DK, (F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"))


def safe_crop_rect(spark, d):
    f = D.frames(spark, d, "width", "height")
    c = G.safe_crop(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("width"), F.col("height"))
    return D.detections(spark, d, "x", "y", "w", "h").join(f, ["task_id", "frame_id"]).select(*DK, *[v.alias(n) for v, n in zip(c, ("start_x", "start_y", "crop_w", "crop_h"))])


def square_crop(spark, d):
    f = D.frames(spark, d, "width", "height")
    c = G.square_crop(*_box(), F.col("width"), F.col("height"))
    return D.detections(spark, d, "x", "y", "w", "h").join(f, ["task_id", "frame_id"]).select(*DK, *[v.alias(n) for v, n in zip(c, ("l", "t", "r", "b"))])


def face_expand(spark, d):
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    grow = lambda a, b: (a * 1.5 - b * 0.5).cast("int")
    return D.detections(spark, d, "x", "y", "w", "h").select(*DK, grow(F.col("x"), x2).alias("x1"), grow(F.col("y"), y2).alias("y1"), grow(x2, F.col("x")).alias("x2"), grow(y2, F.col("y")).alias("y2"))


def pose_box_dilate(spark, d):
    c = G.dilate_for_pose(*_box(), 192, 256)
    return D.detections(spark, d, "x", "y", "w", "h").where("w >= 16 and h >= 16").select(*DK, *[v.alias(n) for v, n in zip(c, ("cx", "cy", "cw", "ch"))])


def ocr_crop_dims(spark, d):
    """Width and height of the rotated crop of a quadrilateral skewed by its box, and whether it turns upright."""
    x, y, w, h = _box()
    p = [(x, y), (x + w, y + F.floor(h / 4).cast("int")), (x + w, y + h), (x, y + h - F.floor(h / 4).cast("int"))]
    side = lambda a, b: F.sqrt(F.pow((a[0] - b[0]).cast("double"), 2) + F.pow((a[1] - b[1]).cast("double"), 2)).cast("int")
    cw = F.least(F.greatest(side(p[0], p[1]), side(p[2], p[3]), F.lit(16)), F.lit(1920))
    ch = F.least(F.greatest(side(p[0], p[3]), side(p[1], p[2]), F.lit(16)), F.lit(1080))
    return D.detections(spark, d, "x", "y", "w", "h").select(*DK, cw.alias("crop_w"), ch.alias("crop_h"), (ch / cw >= 1.5).alias("turn"))


def label_text(spark, d):
    rows = D.detections(spark, d, "class_id", "score", "y").where("score is not null").join(D.class_names(spark, d), "class_id")
    return rows.select(*DK, F.format_string("%s:%.2f", "class_name", F.round("score", 2)).alias("text"), F.when(F.col("y") < 20, F.col("y") + 20).otherwise(F.col("y")).alias("text_y"), (F.col("class_id") % 21).alias("colour"))


def label_lookup(spark, d):
    return D.detections(spark, d, "class_id").join(D.class_names(spark, d), "class_id", "left").select(*DK, "class_name")


def class_threshold(spark, d):
    return R.class_threshold(D.detections(spark, d, "class_id", "score"), THRESHOLDS).select(*DK, "class_id", "score")


def size_gates(spark, d):
    return D.detections(spark, d, "w", "h").where((F.col("w") >= 16) & (F.col("h") >= 16) & (F.col("w").cast("long") * F.col("h") > 100) & (F.col("w") < 400)).select(*DK)


def rule_time_of_day(spark, d):
    return D.frames(spark, d, "ts").where(R.in_times(F.col("ts"), TIMES)).select("task_id", "frame_id")


def rule_class_in(spark, d):
    return R.in_classes(D.detections(spark, d, "class_id"), CLASSES).select(*DK, "class_id")


def rule_polygon(spark, d):
    return R.in_areas(D.detections(spark, d, "x", "y", "w", "h"), [AREA, CONCAVE]).select(*DK)


def rule_tripwire(spark, d):
    return R.in_areas(D.detections(spark, d, "x", "y", "w", "h"), [WIRE]).select(*DK)


def skip_elements(spark, d):
    return table(spark, d, "yolox_demo").select("cfg_row_id", R.keeps_element(F.col("skip_element"), 5010).alias("encoded"), R.keeps_element(F.col("skip_element"), 5006).alias("drawn"))


def first_boxes(spark, d):
    from strandline.operators.windows import first_n

    return first_n(D.detections(spark, d, "score").where("score is not null"), ["task_id", "frame_id"], [F.col("score").desc(), "det_idx"], 3).select(*DK)


def _sql_meet(a, b, c, e):
    def turn(p, q, r):
        return f"sign(cast({q[1]}-{p[1]} as double)*({r[0]}-{q[0]}) - cast({q[0]}-{p[0]} as double)*({r[1]}-{q[1]}))"

    def within(p, q, r):
        return f"({q[0]} between least({p[0]},{r[0]}) and greatest({p[0]},{r[0]}) and {q[1]} between least({p[1]},{r[1]}) and greatest({p[1]},{r[1]}))"

    o1, o2, o3, o4 = turn(a, b, c), turn(a, b, e), turn(c, e, a), turn(c, e, b)
    return f"(({o1}<>{o2} and {o3}<>{o4}) or ({o1}=0 and {within(a, c, b)}) or ({o2}=0 and {within(a, e, b)}) or ({o3}=0 and {within(c, a, e)}) or ({o4}=0 and {within(c, b, e)}))"


_CORNERS = [("x", "y"), ("(x+w)", "y"), ("(x+w)", "(y+h)"), ("x", "(y+h)")]
_SIDES = list(zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))


def _sql_area(area):
    around = list(zip(area, area[1:] + area[:1]))
    touch = "(" + " or ".join(_sql_meet(a, b, p, q) for a, b in _SIDES for p, q in around) + ")"
    if len(area) < 3:
        ends = " or ".join(f"({px} between x and x+w and {py} between y and y+h)" for px, py in area)
        return f"({ends} or {touch})"
    inside = []
    for c in _CORNERS:
        met = " + ".join(f"cast({_sql_meet(p, q, c, ('2147483647.0', c[1]))} as int)" for p, q in around)
        inside.append(f"(({met}) % 2 = 1)")
    return "(" + " and ".join(inside) + f" and not {touch})"


_CLIP = "select task_id, frame_id, det_idx, "
_WH = " from det join (select task_id, frame_id, width, height from fr) f using (task_id, frame_id)"


def _sql_crop(lo, hi, size, start, length):
    s, n = f"greatest(least({lo},{size}),0)", f"greatest(least({hi}-({lo}),{size}),16)"
    return (f"case when width>=16 and height>=16 then case when {s}+{n}>{size} and {size}-{s}<16 then {size}-{n} else {s} end end as {start}, "
            f"case when width>=16 and height>=16 then case when {s}+{n}>{size} and {size}-{s}>=16 then {size}-{s} else {n} end end as {length}")


_TS_MS = "cast(floor(epoch_us(ts) / 1000) as bigint) % 86400000"
_DIL = """with {cte}, a as (select *, x + w // 2 as cx0, y + h // 2 as cy0, case when w > h*0.75 then cast(trunc(w/0.75) as int) else h end as sy0,
 case when w < h*0.75 then cast(trunc(h*0.75) as int) else w end as sx0 from det where w >= 16 and h >= 16),
b as (select *, case when cx0 <> -1 then cast(trunc(sx0*1.25) as int) else sx0 end as cw, case when cx0 <> -1 then cast(trunc(sy0*1.25) as int) else sy0 end as ch from a)
select task_id, frame_id, det_idx, cx0 - cw // 2 as cx, cy0 - ch // 2 as cy, cw, ch from b"""
_D = "select task_id, frame_id, det_idx"

ORACLE = {
    "scan_frames": WITH + "select task_id, frame_id, row_number() over (partition by task_id order by ts, frame_id) - 1 as frame_no from fr where ts is not null",
    "scan_frames_all": WITH + ", c as (select task_id, frame_id, last_value(ts ignore nulls) over (partition by task_id order by frame_id rows unbounded preceding) as seen from fr) select task_id, frame_id, row_number() over (partition by task_id order by seen nulls first, frame_id) - 1 as frame_no from c",
    "sample_drop": WITH + "select task_id, frame_id from fr where frame_id % 5 = 0 or coalesce(eos, false)",
    "sample_keep": WITH + "select task_id, frame_id, frame_id % 4 <> 0 as filtered from fr",
    "loop_replay": WITH + f"select task_id, cast(l as int) as loop, frame_id + l * n as frame_id from fr join (select task_id, max(frame_id) + 1 as n from fr group by task_id) using (task_id), range({LOOPS}) t(l)",
    "channel_densify": "select graph_id, channel_id, cast(row_number() over (partition by graph_id order by s, channel_id) - 1 as int) as channel_idx from (select graph_id, channel_id, min(coalesce(received_at, timestamp '9999-01-01')) as s from request_add_channel where graph_id is not null and channel_id is not null group by all)",
    "roi_scan": """with a as (select *, roi_left is not null and roi_top is not null and roi_width is not null and roi_height is not null as has, least(greatest(roi_left,0),1920) as l, least(greatest(roi_top,0),1080) as t from yolox_demo)
select cfg_row_id, case when has then l else 0 end as roi_x, case when has then t else 0 end as roi_y, case when has then least(roi_width,1920-l) else 1920 end as roi_w, case when has then least(roi_height,1080-t) else 1080 end as roi_h from a""",
    "eos_streams": WITH + "select task_id, max(cast(coalesce(eos,false) as int)) as ended, max(frame_id) as last_frame from fr group by task_id",
    "source_types": "select cfg_row_id, case when url like '/%' then 'VIDEO' when substr(url,1,7)='gb28181' then 'GB28181' else upper(substr(url,1,4)) end as source from yolox_demo where url is not null",
    "box_clip": WITH + _CLIP + "least(greatest(x,0),width) as x1, least(greatest(y,0),height) as y1, least(greatest(x+w,0),width) as x2, least(greatest(y+h,0),height) as y2" + _WH,
    "letterbox_inverse": WITH + f", g as (select *, least({NET}.0/width, {NET}.0/height) as r from (select task_id, frame_id, det_idx, x, y, cast(width as double) as width, cast(height as double) as height" + _WH + f" where width > 0 and height > 0))\nselect task_id, frame_id, det_idx, round((x % {NET} - trunc(({NET} - trunc(width*r))/2))/r, 4) as sx, round((y % {NET} - trunc(({NET} - trunc(height*r))/2))/r, 4) as sy from g",
    "roi_offset": WITH + _D + ", x + 64 as x, y + 32 as y from det",
    "safe_crop_rect": WITH + _CLIP + _sql_crop("x", "(x+w)", "width", "start_x", "crop_w") + ", " + _sql_crop("y", "(y+h)", "height", "start_y", "crop_h") + _WH,
    "square_crop": WITH + ", c as (select task_id, frame_id, det_idx, cast(floor((x+x+w)/2.0) as int) as cx, cast(floor((y+y+h)/2.0) as int) as cy, x, y, w, h, width, height" + _WH + "), e as (select *, greatest(cx-x, x+w-cx, cy-y, y+h-cy) + 20 as k from c) select task_id, frame_id, det_idx, greatest(cx-k,0) as l, greatest(cy-k,0) as t, least(cx+k, width) as r, least(cy+k, height) as b from e",
    "face_expand": WITH + _CLIP + "cast(trunc(x*1.5-(x+w)*0.5) as int) as x1, cast(trunc(y*1.5-(y+h)*0.5) as int) as y1, cast(trunc((x+w)*1.5-x*0.5) as int) as x2, cast(trunc((y+h)*1.5-y*0.5) as int) as y2 from det",
    "pose_box_dilate": _DIL.format(cte=D.SQL),
    "ocr_crop_dims": WITH + """, s as (select task_id, frame_id, det_idx, cast(trunc(sqrt(pow(w,2)+pow(h//4,2))) as int) as a, cast(trunc(sqrt(pow(w,2)+pow(h//4,2))) as int) as a2,
 abs(h - h//4) as b, abs(h - h//4) as b2 from det), z as (select *, least(greatest(a,a2,16),1920) as crop_w, least(greatest(b,b2,16),1080) as crop_h from s)
select task_id, frame_id, det_idx, crop_w, crop_h, cast(crop_h as double)/crop_w >= 1.5 as turn from z""",
    "label_text": WITH + _CLIP + "class_name || ':' || cast(cast(cast(score as decimal(18,6)) as decimal(10,2)) as varchar) as text, case when y < 20 then y+20 else y end as text_y, class_id % 21 as colour from det join cn using (class_id) where score is not null",
    "label_lookup": WITH + _CLIP + "class_name from det left join cn using (class_id)",
    "class_threshold": WITH + _CLIP + "class_id, score from det where " + " or ".join(f"(class_id={c} and score>{t})" for c, t in THRESHOLDS.items()),
    "size_gates": WITH + _D + " from det where w>=16 and h>=16 and cast(w as bigint)*h>100 and w<400",
    "rule_time_of_day": WITH + "select task_id, frame_id from fr where " + " or ".join(f"{_TS_MS} between {a} and {b}" for a, b in TIMES),
    "rule_class_in": WITH + _CLIP + f"class_id from det where class_id in ({','.join(map(str, CLASSES))})",
    "rule_polygon": WITH + _D + f" from det where {_sql_area(AREA)} or {_sql_area(CONCAVE)}",
    "rule_tripwire": WITH + _D + f" from det where {_sql_area(WIRE)}",
    "skip_elements": "select cfg_row_id, not coalesce(list_contains(skip_element, 5010), false) as encoded, not coalesce(list_contains(skip_element, 5006), false) as drawn from yolox_demo",
    "first_boxes": WITH + _D + " from det where score is not null qualify row_number() over (partition by task_id, frame_id order by score desc, det_idx) <= 3",
}
QUERIES = {k: globals()[k] for k in ORACLE}
