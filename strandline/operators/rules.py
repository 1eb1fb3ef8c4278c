"""The rule filter: class, area, time-of-day, direction and gating predicates and the rule bit mask.

Every rule looks at the frame as it came (rules don't see each other's removals), and each has its own counters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geometry import box_in_area

DAY_MS = 86_400_000


@dataclass
class Rule:
    """One rule of a channel. Areas are lists of points; times are (start, end) milliseconds of the day, ends included."""

    kind: int = 0  # 0: recognised labels, 1: tracks, others: plain
    classes: list[int] = field(default_factory=list)
    areas: list[list[tuple[int, int]]] = field(default_factory=list)
    times: list[tuple[int, int]] = field(default_factory=list)
    direction: tuple[float, float] = (0.0, 0.0)
    trajectory_interval: int = 1
    alert_first: int = 0
    alert_skip: int = 1


def day_ms(text: str, compat: bool = False) -> int:
    """'HH MM SS' or 'HH:MM:SS' in milliseconds. compat: with blanks, the first digit of minutes and seconds is lost."""
    parts = text.replace(":", " ").split()
    if compat and ":" not in text:
        parts = [parts[0], *[p[1:] or "0" for p in parts[1:]]]
    h, m, s = map(int, parts)
    return (h * 3600 + m * 60 + s) * 1000


def in_times(ts: Column, times: list[tuple[int, int]]) -> Column:
    """The time of day lies in any interval; no interval: false."""
    at = F.pmod(F.unix_micros(ts.cast("timestamp")) / 1000, F.lit(DAY_MS)).cast("long")
    hit = F.lit(False)
    for a, b in times:
        hit = hit | at.between(a, b)
    return hit


def in_classes(det: DataFrame, classes: list[int]) -> DataFrame:
    """Detections of the listed classes; none listed: none kept."""
    return det.where(F.col("class_id").isin(classes)) if classes else det.limit(0)


def in_areas(det: DataFrame, areas: list[list[tuple[int, int]]]) -> DataFrame:
    """Detections inside (or, for lines, on) any area; an area without points takes all, no area at all none."""
    hit = F.lit(False)
    for a in areas:
        hit = hit | box_in_area(F.col("x"), F.col("y"), F.col("w"), F.col("h"), a)
    return det.where(hit) if areas else det.limit(0)


def moves_along(det: DataFrame, stream: list[str], direction: tuple[float, float], interval: int) -> DataFrame:
    """Frames in which any track moved along `direction` since its last evaluated frame; frame columns only.

    A track is evaluated on every `interval`-th of its frames; between them, and on its first, it says nothing.
    """
    track = Window.partitionBy(*stream, "track_id").orderBy("frame_id", "det_idx")
    cx, cy = F.col("x") + F.floor(F.col("w") / 2), F.col("y") + F.floor(F.col("h") / 2)
    seen = det.withColumn("__n", F.row_number().over(track) - 1).where(F.col("__n") % interval == 0).withColumn("__x", cx).withColumn("__y", cy)
    dot = (F.col("__x") - F.lag("__x").over(track)) * direction[0] + (F.col("__y") - F.lag("__y").over(track)) * direction[1]
    return seen.withColumn("__d", dot).where("__d >= 0").select(*stream, "frame_id").distinct()


def gate_alerts(det: DataFrame, stream: list[str], ident: str, evaluated: DataFrame, first: int, skip: int) -> DataFrame:
    """Rows of the ids whose run length n lets them through: n > first and (n - first - 1) a multiple of skip.

    A run is consecutive *evaluated* frames of a stream that hold the id (`evaluated`: stream columns, frame_id). Batch
    form: gaps and islands, partitioned by stream and id. A frame with the id twice counts once.
    """
    places = evaluated.select(*stream, "frame_id").distinct().withColumn("__place", F.row_number().over(Window.partitionBy(*stream).orderBy("frame_id")))
    seen = det.where(F.col(ident).isNotNull()).join(places, [*stream, "frame_id"])
    per = Window.partitionBy(*stream, ident).orderBy("__place")
    island = seen.withColumn("__i", F.col("__place") - F.dense_rank().over(per))
    run = Window.partitionBy(*stream, ident, "__i").orderBy("__place")
    gated = island.withColumn("run", F.dense_rank().over(run)).where((F.col("run") > first) & ((F.col("run") - first - 1) % max(skip, 1) == 0))
    return gated.drop("__place", "__i")


def apply_rule(frames: DataFrame, det: DataFrame, rule: Rule, stream: list[str]) -> DataFrame:
    """Detections that one rule lets through: time, then class, area, direction, gating, each over what is left."""
    on_time = frames.where(in_times(F.col("ts"), rule.times)).select(*stream, "frame_id")
    left = in_areas(in_classes(det, rule.classes), rule.areas).join(on_time, [*stream, "frame_id"], "left_semi")
    if rule.kind == 1 and rule.direction != (0.0, 0.0):
        left = left.join(moves_along(left, stream, rule.direction, rule.trajectory_interval), [*stream, "frame_id"], "left_semi")
    if rule.kind == 1:
        left = gate_alerts(left.where("track_id >= 0"), stream, "track_id", left, rule.alert_first, rule.alert_skip).drop("run")
    elif rule.kind == 0 and "label" in left.columns:
        left = gate_alerts(left, stream, "label", left, rule.alert_first, rule.alert_skip).drop("run")
    return left


def rule_mask(frames: DataFrame, det: DataFrame, rules: list[Rule], stream: list[str]) -> DataFrame:
    """Stream, frame_id, tag: bit i is set if rule i lets any detection of the frame through; frames of no rule are left out."""
    hits = frames.select(*stream, "frame_id", F.lit(0).alias("bit")).limit(0)
    for i, r in enumerate(rules):
        one = apply_rule(frames, det, r, stream).select(*stream, "frame_id", F.lit(1 << i).alias("bit"))
        hits = one if i == 0 else hits.unionByName(one)
    return hits.groupBy(*stream, "frame_id").agg(F.bit_or("bit").alias("tag"))


def pass_frames(frames: DataFrame, mask: DataFrame, configured: DataFrame, stream: list[str]) -> DataFrame:
    """Frames behind the filter: tagged ones, end markers, and all frames of streams without rules (tag 0)."""
    tagged = frames.join(mask, [*stream, "frame_id"], "left").join(configured.select(*stream).distinct().withColumn("__c", F.lit(True)), stream, "left")
    return tagged.where(F.col("tag").isNotNull() | F.col("__c").isNull() | F.coalesce(F.col("eos"), F.lit(False))).withColumn("tag", F.coalesce("tag", F.lit(0))).drop("__c")


def class_threshold(det: DataFrame, thresholds: dict[int, float] | float) -> DataFrame:
    """Scores above one threshold, or above each class's; classes without one are dropped. The least prefilters the scan."""
    if not isinstance(thresholds, dict):
        return det.where(F.col("score") > float(thresholds))
    least = min(thresholds.values())
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in (int(kv[0]), float(kv[1]))])
    return det.where(F.col("class_id").isin([int(k) for k in thresholds]) & (F.col("score") > least)).where(F.col("score") > F.try_element_at(limit, F.col("class_id")))


def keeps_element(skip: Column, element: int) -> Column:
    """Whether a row goes through an element: false if its bypass list names it."""
    return ~F.coalesce(F.array_contains(skip, element), F.lit(False))
