"""Routing of detections to branches and the count-completion join that brings the branches back."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Route:
    """Classes by name; none listed routes the whole frame."""

    classes: list[str]
    port: int


@dataclass
class RouteRule:
    """Routes that fire on every `frame_interval`-th frame, or when more than `time_interval` seconds have passed."""

    routes: list[Route] = field(default_factory=list)
    frame_interval: int | None = None
    time_interval: float | None = None

    def interval(self) -> int:
        return self.frame_interval or 1


def sub_ids(det: DataFrame, frame: list[str], faces: DataFrame | None = None) -> DataFrame:
    """Adds sub_id, the running index over a frame's faces and then its detections, whether or not a route takes them."""
    rows = det.withColumn("__f", F.lit(1))
    if faces is not None:
        rows = faces.withColumn("__f", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return rows.withColumn("sub_id", (F.row_number().over(Window.partitionBy(*frame).orderBy("__f", "det_idx")) - 1).cast("int")).drop("__f")


def fires_by_frame(frames: DataFrame, interval: int) -> DataFrame:
    """Frames whose id is a multiple of the interval, and end markers."""
    return frames.where((F.col("frame_id") % interval == 0) | F.coalesce(F.col("eos"), F.lit(False)))


def throttle(frames: DataFrame, stream: list[str], seconds: float, ts: str = "ts") -> DataFrame:
    """Frames at which a time rule fires: more than `seconds` after the last time it fired, the first frame included.

    Greedy and sequential by nature: each stream is read in order once, with one number of state, whatever its length.
    Frames without a time don't fire. Returns stream columns (as long), frame_id.
    """
    gap = int(seconds * 1_000_000)
    names = [*stream, "frame_id"]

    def run(batches):
        key, last = None, None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(names))]
            at = b.column(len(names)).to_pylist()
            pick = []
            for i, (k, t) in enumerate(zip(zip(*cols[:-1]), at)):
                if k != key:
                    key, last = k, None
                if last is None or t - last > gap:
                    last = t
                    pick.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in pick], pa.int64()) for c in cols], names)

    rows = frames.where(F.col(ts).isNotNull()).select(*[F.col(c).cast("long").alias(c) for c in names], F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    ordered = rows.repartition(*stream).sortWithinPartitions(*stream, "__t", "frame_id")
    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fired_rules(frames: DataFrame, rules: list[RouteRule], frame: list[str], stream: list[str]) -> DataFrame:
    """frame columns, fired: the numbers of the rules that fire on each frame; frames on which none does are left out."""
    rows = frames
    marks = []
    for i, r in enumerate(rules):
        if r.time_interval is not None:
            at = throttle(frames, stream, r.time_interval).select(*frame, F.lit(True).alias(f"__t{i}"))
            rows = rows.join(at, frame, "left")
            marks.append(F.col(f"__t{i}"))
        else:
            marks.append((F.col("frame_id") % r.interval() == 0) | F.coalesce(F.col("eos"), F.lit(False)))
    fired = F.array_compact(F.array(*[F.when(m, i) for i, m in enumerate(marks)]))
    return rows.select(*frame, fired.alias("fired")).where(F.size("fired") > 0)


def class_routes(names: DataFrame, rules: list[RouteRule]) -> DataFrame:
    """class_id, routes (rule, port) of the classes that any rule names; within one rule a later route of a class replaces an earlier one."""
    rows = [(c, i, p) for i, r in enumerate(rules) for c, p in {c: x.port for x in r.routes for c in x.classes}.items()]
    table = names.sparkSession.createDataFrame(rows, "class_name string, rule int, port int")
    return names.join(F.broadcast(table), "class_name").groupBy("class_id").agg(F.collect_set(F.struct("rule", "port")).alias("routes"))


def route(frames: DataFrame, det: DataFrame, names: DataFrame, rules: list[RouteRule], frame: list[str], stream: list[str]) -> DataFrame:
    """Sub-rows frame columns, sub_id, det_idx, port of all rules that fire; sub_id -1 stands for the whole frame.

    Rules become marks of a frame and ports an array of a class, so frames and detections are read once, whatever the number
    of rules. The routes come from the configuration, so they are small whatever the data. A port two rules give counts once.
    """
    fired = fired_rules(frames, rules, frame, stream)
    ports = lambda routes: F.explode(F.array_distinct(F.transform(F.filter(routes, lambda x: F.array_contains("fired", x["rule"])), lambda x: x["port"])))
    subs = sub_ids(det, frame).select(*frame, "sub_id", "det_idx", "class_id").join(F.broadcast(class_routes(names, rules)), "class_id")
    out = subs.join(fired, frame).select(*frame, "sub_id", "det_idx", ports(F.col("routes")).alias("port"))
    whole = [F.struct(F.lit(i).alias("rule"), F.lit(x.port).alias("port")) for i, r in enumerate(rules) for x in r.routes if not x.classes]
    if whole:
        out = out.unionByName(fired.select(*frame, F.lit(-1).alias("sub_id"), F.lit(None).cast("int").alias("det_idx"), ports(F.array(*whole)).alias("port")))
    return out


def branch_counts(frames: DataFrame, routed: DataFrame, frame: list[str], came=None) -> DataFrame:
    """The default port: every frame once, with the number of its branches; with `came`, also `received`, those of them that came back."""
    counts = [F.count(F.lit(1)).cast("int").alias("branches")] + ([] if came is None else [F.count_if(came).cast("int").alias("received")])
    rows = frames.join(routed.groupBy(*frame).agg(*counts), frame, "left")
    return rows.fillna(0, ["branches"] if came is None else ["branches", "received"])


def converge(main: DataFrame, arrived: DataFrame, frame: list[str], stream: list[str], order: str = "frame_id", strict: bool = True) -> DataFrame:
    """Frames all of whose branches have arrived, with `received`.

    strict: within a stream nothing overtakes, so frames behind an incomplete one are held back; otherwise only the
    incomplete frame itself is missing. Frames without branches are complete.
    """
    got = arrived.groupBy(*frame).agg(F.count(F.lit(1)).cast("int").alias("received"))
    return release(main.join(got, frame, "left").fillna(0, ["received"]), stream, order, strict)


def release(counted: DataFrame, stream: list[str], order: str = "frame_id", strict: bool = True) -> DataFrame:
    """As `converge`, of frames that have both counts."""
    if not strict:
        return counted.where("received = branches")
    first = counted.where("received <> branches").groupBy(*stream).agg(F.min(order).alias("__stall"))
    return counted.join(first, stream, "left").where(F.col("__stall").isNull() | (F.col(order) < F.col("__stall"))).drop("__stall")


def nested_parent(path, levels: int = 1):
    """The key a nested converger joins on: a sub-frame path without its last elements."""
    return F.slice(path, 1, F.size(path) - levels)


def zip_ports(left: DataFrame, right: DataFrame, stream: list[str], order: str, check: str | None = None) -> DataFrame:
    """Pairs the i-th rows of two ports, per stream. With `check`, pairs that differ in that column are discarded.

    The left row gives the identity; the right one's columns come with the prefix right_.
    """
    w = Window.partitionBy(*stream).orderBy(order)
    a = left.withColumn("__i", F.row_number().over(w))
    b = right.withColumn("__i", F.row_number().over(w))
    b = b.select(*stream, "__i", *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in stream])
    pairs = a.join(b, [*stream, "__i"]).drop("__i")
    return pairs.where(F.col(check) == F.col(f"right_{check}")) if check else pairs


def zip_on_frame(left: DataFrame, right: DataFrame, frame: list[str]) -> DataFrame:
    """Pairs rows of equal frame; the left gives the identity."""
    return left.join(right.select(*frame, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in frame]), frame)


def sub_result_join(results: DataFrame, det: DataFrame, frame: list[str], special_class: int, special: DataFrame, other: DataFrame) -> DataFrame:
    """Sub-results beside the object they belong to, labelled from one dictionary for `special_class`, else another."""
    a = special.select(F.col("class_id").alias("label_id"), F.col("class_name").alias("special_name"))
    b = other.select(F.col("class_id").alias("label_id"), F.col("class_name").alias("other_name"))
    joined = results.join(det.withColumnRenamed("det_idx", "sub_id"), [*frame, "sub_id"]).join(a, "label_id", "left").join(b, "label_id", "left")
    return joined.withColumn("label", F.when(F.col("class_id") == special_class, F.col("special_name")).otherwise(F.col("other_name"))).drop("special_name", "other_name")


def port_union(*ports: DataFrame) -> DataFrame:
    """All rows of several producers of one port, repeats kept."""
    out = ports[0]
    for p in ports[1:]:
        out = out.unionByName(p)
    return out
