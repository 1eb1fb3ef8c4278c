"""Queries that take every row, element and level."""

import datetime

from pyspark.sql import functions as F
from strandline.operators import sampling as S
from strandline.plans import registry
from strandline.sources import domain as D

SMALL = "/root/testdata/sf0.001"


def test_every_frame_is_numbered(spark):
    got = registry.queries()["scan_frames_all"](spark, SMALL)
    assert got.count() == D.frames(spark, SMALL, "ts").count() > D.frames(spark, SMALL, "ts").where("ts is not null").count()
    per = got.groupBy("task_id").agg(F.min("frame_no").alias("a"), F.max("frame_no").alias("b"), F.countDistinct("frame_no").alias("n"))
    assert per.where("a <> 0 or b <> n - 1").count() == 0


def test_frames_without_time_keep_their_place(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 0, None), (1, 1, at(1)), (1, 2, None), (1, 3, at(3)), (2, 5, None), (2, 7, None)]
    f = S.carry_time(spark.createDataFrame(rows, "task_id long, frame_id long, ts timestamp_ntz"), ["task_id"], "ts", "frame_id")
    got = S.number_frames(f, ["task_id"], [F.col("ts").asc_nulls_first(), "frame_id"]).collect()
    assert {(r.task_id, r.frame_id): r.frame_no for r in got} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 5): 0, (2, 7): 1}


def test_two_levels_leave_out_incomplete_frames(spark):
    q = registry.queries()
    full = q["converge_levels"](spark, SMALL)
    frames = D.frames(spark, SMALL, "eos")
    out = frames.join(full, D.FRAME, "left_anti")
    assert out.count() > 0 and out.where("frame_id % 7 <> 0").count() == 0
    lost = D.detections(spark, SMALL, "class_id").join(D.class_names(spark, SMALL).where("class_name in ('sedan', 'lorry')"), "class_id")
    assert out.join(lost, D.FRAME, "left_anti").count() == 0
    assert full.where("branches = 3 and parts > 0").count() > 0
    assert q["pipeline_levels"](spark, SMALL).join(full, D.FRAME, "left_anti").count() == 0


def test_whole_vectors_are_read(spark):
    q = registry.queries()
    for name, col in (("disparity_bytes_all", "bytes"), ("multilabel_all", "labels"), ("classify_tasks_all", "labels")):
        rows = [r[col] for r in q[name](spark, SMALL).collect() if r[col] is not None]
        assert rows and {len(r) for r in rows} == {64}
        assert any(r[63] != rows[0][63] for r in rows)
    assert q["classify_tasks_all"](spark, SMALL).where("label > 3").count() > 0
    assert q["disparity_bytes_all"](spark, SMALL).where("array_min(bytes) <> 0 or array_max(bytes) <> 255").count() == 0


def test_every_table_is_written_and_typed(spark):
    q = registry.queries()
    got = q["p5_tables"](spark, SMALL).cache()
    keys = ["record_id", "parent_path", "node_path"]
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, q["p5_found"](spark, SMALL).select(*keys).collect()))
    box = ["record_id", "node_path", "mX", "mY", "mWidth", "mHeight"]
    assert got.where("tag = 'box'").select(*box).exceptAll(q["p5_boxes"](spark, SMALL).select(*box)).count() == 0
    filled = {r.tag for r in got.where("coalesce(mFrameId, mX, mClassify, mSubId) is not null").select("tag").distinct().collect()}
    assert {"frame", "box", "detection"} <= filled
