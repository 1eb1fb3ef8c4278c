"""Ordering and mapping helpers of arrays: corner order, interval lists, class-to-port sets, look-up tables, task dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.aggregates import argmax, multi_label, softmax


def clockwise(points: Column) -> Column:
    """Four points (array<struct<x,y>>) from the upper left clockwise: by x, then by y within the left and the right pair."""
    by_x = F.array_sort(points)
    pair = lambda a: F.array_sort(F.transform(a, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    left, right = pair(F.slice(by_x, 1, 2)), pair(F.slice(by_x, 3, 2))
    back = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return F.array(back(left[0]), back(right[0]), back(right[1]), back(left[1]))


def merged_intervals(values: Column) -> Column:
    """An interval list without repeats, ascending; nulls are dropped."""
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def class_ports(routes: DataFrame) -> DataFrame:
    """class_name, ports: all ports of a class over the rules that fired, ascending."""
    return routes.groupBy("class_name").agg(F.sort_array(F.collect_set("port")).alias("ports"))


def look_up(values: Column, table: list[int]) -> Column:
    """Every value of an array replaced by its entry; values outside the table become null."""
    lut = F.array(*map(F.lit, table))
    return F.transform(values, lambda v: F.get(lut, v.cast("int")))


def classify(features: Column, task: Column, thresholds: list[float]) -> Column:
    """struct<label, score, labels> by task: FeatureExtract (label null), SingleLabel (softmax), MultiLabel (0/1 list)."""
    p = softmax(features)
    single = task == "SingleLabel"
    return F.struct(F.when(single, argmax(p)).alias("label"), F.when(single, F.array_max(p)).alias("score"), F.when(task == "MultiLabel", multi_label(features, thresholds)).alias("labels"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before its own `at`, per keys; one window, no range join.

    At equal times right's row counts as before; repeated times of right give the greatest value.
    """
    from pyspark.sql import Window

    rows = left.select(*keys, at, F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v")).unionByName(right.select(*keys, at, F.lit(0).alias("__side"), F.col(value).alias("__v")))
    w = Window.partitionBy(*keys).orderBy(at, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("as_of", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*keys, at, "as_of")
