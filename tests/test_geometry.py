import math

import pytest
from pyspark.sql import functions as F
from strandline.functions import geometry as G

SQUARE = [(10, 10), (100, 10), (100, 100), (10, 100)]
BENT = [(0, 0), (100, 0), (100, 100), (50, 40), (0, 100)]
TRUTH = [
    ((20, 20, 10, 10), SQUARE, True), ((10, 20, 10, 10), SQUARE, False), ((90, 90, 30, 30), SQUARE, False), ((200, 200, 5, 5), SQUARE, False),
    ((0, 0, 200, 200), SQUARE, False), ((40, 10, 10, 10), BENT, True), ((40, 60, 20, 20), BENT, False), ((20, 20, 10, 10), [], True),
    ((0, 0, 50, 50), [(10, 10), (400, 400)], True), ((0, 20, 50, 5), [(25, 0), (25, 400)], True), ((0, 0, 10, 10), [(25, 0), (25, 400)], False), ((0, 0, 10, 10), [(5, 5)], True), ((0, 0, 10, 10), [(50, 5)], False),
]


@pytest.mark.parametrize("box,area,inside", TRUTH)
def test_area_rule(spark, box, area, inside):
    df = spark.createDataFrame([box], "x int, y int, w int, h int")
    assert df.select(G.box_in_area(F.col("x"), F.col("y"), F.col("w"), F.col("h"), area)).first()[0] is inside


def test_letterbox_and_crops(spark):
    df = spark.createDataFrame([(1920, 1080), (640, 640), (300, 900)], "w int, h int")
    r = df.select(*G.letterbox(F.col("w"), F.col("h"), 640, 640)).collect()
    assert [tuple(x)[1:] for x in r] == [(0, 140), (0, 0), (213, 0)]
    c = spark.createDataFrame([(-5, 10, 3, 12, 100, 100), (95, 0, 99, 200, 100, 100), (0, 0, 5, 5, 10, 10)], "a int, b int, c int, d int, w int, h int")
    got = [tuple(x) for x in c.select(*G.safe_crop(*[F.col(k) for k in "abcdwh"])).collect()]
    assert got == [(0, 10, 16, 16), (84, 0, 16, 100), (None,) * 4]


def test_angles_and_areas(spark):
    r = spark.range(1).select(*G.regular_angle(F.lit(2.0), F.lit(5.0), F.lit(3.0)), *G.rotated_corners(F.lit(10.0), F.lit(10.0), F.lit(4.0), F.lit(2.0), F.lit(0.0))).first()
    assert r[0] == 5 and r[1] == 2 and abs(r[2] - (3 + math.pi / 2) % math.pi) < 1e-9
    assert list(r[3:]) == [12, 11, 12, 9, 8, 9, 8, 11]


@pytest.mark.parametrize("a,b,c,d,meet", [((0, 0), (4, 4), (0, 4), (4, 0), True), ((0, 0), (1, 1), (2, 2), (3, 3), False), ((0, 0), (2, 2), (1, 1), (5, 5), True), ((0, 0), (2, 0), (2, 0), (2, 9), True), ((0, 0), (2, 0), (3, 0), (3, 9), False)])
def test_segments(spark, a, b, c, d, meet):
    p = lambda v: (F.lit(v[0]), F.lit(v[1]))
    assert spark.range(1).select(G.segments_meet(p(a), p(b), p(c), p(d))).first()[0] is meet
