"""Runs of alike consecutive events, by optimal segmentation with pruned dynamic programming.

The events of an entity, in order, are cut into runs so that the dissimilarity within runs plus `penalty` for each run is least.
The dissimilarity of a run is the number of its events whose class isn't the run's own (its most frequent one), so a flicker of
a few events of another class stays inside a run where that is cheaper than two more boundaries. Boundaries are forced where
neighbours lie more than `max_gap` apart. A penalty under 1/2 makes every change of class a boundary: a run of k foreign events
can be cut out with at most 2k more boundaries. Runs are then the maximal stretches of one class.

The programme keeps, for each class, the cost of the best segmentation whose last run has it, and drops a class once starting a
run anew is cheaper (pruning): time is linear in the events for the few classes that stay alive. It steps over stretches of equal
neighbours, not over events. Every stretch passes through it whatever the penalty; under 1/2 the pruning leaves one class alive.

A stretch of more than 2 * penalty equal events (an anchor) has its own class in every optimum, so what lies on its two sides can
be solved apart. That lets an entity hold any share of the rows: events are cut into blocks of the order column, blocks are
hashed to tasks, each is solved between its first and its last anchor, and only what lies outside goes on, in one piece for each
side, to blocks of FAN blocks and at last to the entity. Where a block has no anchor at all its stretches go on as they are.

Defined results: rows with a null entity, order or class take no part; repeated rows count once; events of equal order
follow the tie column; a single event is a run of one; an empty table gives no rows. Where several segmentations cost the same,
read from the end: the class that sorts first is taken, and its run goes back as far as it can, whatever the blocks.
`collapse_runs` solves and writes the blocks when it is called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.tables import materialise

#: Width of a block of the order column, in its units, and blocks in a block of the next level.
BLOCK, FAN = 4096, 4096
#: Rows after which finished blocks are solved.
CHUNK = 20_000
FIELDS = ["e1", "e2", "block", "seq", "first_at", "last_at", "key", "n", "fixed", "closed", "done"]
PART_SCHEMA = "e1 long, e2 long, block long, seq long, first_at long, last_at long, key string, n long, fixed boolean, closed boolean, done boolean"


def own_classes(keys: list[int], sizes: list[int], anchors: list[bool], penalty: float) -> list[int]:
    """The class of the run that each stretch belongs to in the optimal segmentation; an anchor keeps its own."""
    start, unit = float(penalty).as_integer_ratio()  # costs are whole numbers, so that equal ones are equal
    live: dict[int, int] = {}  # class of the last run -> least cost
    back: list[dict] = []  # of each stretch: class -> class before, or None: one run from the beginning
    best, least, foreign = None, 0, 0  # foreign: all events so far, which a class that comes later has as dissimilarity
    for key, n, anchor in zip(keys, sizes, anchors):
        n *= unit
        cost = {c: v if c == key else v + n for c, v in live.items() if c == key or not anchor}
        came: dict = {c: c for c in cost}
        fresh, before = least + start, best
        if best is None or foreign + start <= fresh:
            fresh, before = foreign + start, None
        if key not in cost or fresh < cost[key]:
            cost[key], came[key] = fresh, before
        foreign = np.inf if anchor else foreign + n
        least = min(cost.values())
        best = min([c for c, v in cost.items() if v == least])
        live = {c: v for c, v in cost.items() if v <= least + start}
        back.append(came)
    out, c = [0] * len(keys), best
    for j in range(len(keys) - 1, -1, -1):
        out[j] = c
        if back[j][c] is None:
            out[:j] = [c] * j
            break
        c = back[j][c]
    return out


def solve(t: pa.Table, max_gap: int, penalty: float, final: bool) -> pa.RecordBatch:
    """Whole blocks of parts in order (columns FIELDS; `block` tells blocks apart) to decided runs (`done`) and open parts.

    A part is a stretch, or with `fixed` a run whose class is settled; `closed`: a boundary stands before it.
    """
    e1, e2, block, seq, first, last = (t.column(i).to_numpy() for i in range(6))
    group = t.column("__group").to_numpy()
    words = t.column("key").combine_chunks()
    names = words.unique().sort()  # classes of equal cost go by name
    key = pc.index_in(words, names).to_numpy(zero_copy_only=False)
    n, fixed, closed = (t.column(c).to_numpy() for c in ("n", "fixed", "closed"))
    opens = np.ones(len(first), bool)
    opens[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1]) | (group[1:] != group[:-1])
    cut = opens | closed
    cut[1:] |= first[1:] - last[:-1] > max_gap
    starts = cut.copy()
    starts[1:] |= key[1:] != key[:-1]
    a = np.flatnonzero(starts)
    b = np.append(a[1:], len(first)) - 1
    size, own = np.add.reduceat(n, a), key[a]
    settled = np.logical_or.reduceat(fixed, a)
    anchor = settled | (size > 2 * penalty)
    # pieces: stretches between forced boundaries; open at a side where the block ends and the next one may go on
    p = np.flatnonzero(cut[a])
    q = np.append(p[1:], len(a)) - 1
    left = opens[a[p]] & ~closed[a[p]] & (not final)
    right = np.append(opens[a[p[1:]]], True) & (not final)
    rows: list[tuple] = []  # first and last part, class, events, fixed, closed, done
    A, B, own, size, settled, anchor = (x.tolist() for x in (a, b, own, size, settled, anchor))
    raw = lambda x, shut=False: (A[x], B[x], own[x], size[x], 0, shut, 0)
    for j, k, ol, orr in zip(p.tolist(), q.tolist(), left.tolist(), right.tolist()):
        lo, hi = j, k
        if ol or orr:
            first_firm = next((x for x in range(j, k + 1) if anchor[x]), None)
            if first_firm is None:
                rows += [raw(x, x == j and not ol) for x in range(j, k + 1)]
                continue
            if ol:
                lo = first_firm
                settled[lo] = True
            if orr:
                hi = next(x for x in range(k, j - 1, -1) if anchor[x])
                settled[hi] = True
        label = own_classes(own[lo : hi + 1], size[lo : hi + 1], settled[lo : hi + 1], penalty)
        begin = [x for x in range(len(label)) if not x or label[x] != label[x - 1]]
        rows += [raw(x) for x in range(j, lo)]
        for r, (x, y) in enumerate(zip(begin, [*begin[1:], len(label)])):
            held = (r == 0 and ol) or (y == len(label) and orr)
            rows.append((A[lo + x], B[lo + y - 1], label[x], sum(size[lo + x : lo + y]), 1, r > 0 or not ol, not held))
        rows += [raw(x) for x in range(hi + 1, k + 1)]
    r = np.array(rows, np.int64)
    classes = pa.DictionaryArray.from_arrays(pa.array(r[:, 2], pa.int32()), names).cast(pa.string())
    flags = [pa.array(r[:, c].astype(bool)) for c in (4, 5, 6)]
    return pa.RecordBatch.from_arrays([pa.array(e1[r[:, 0]]), pa.array(e2[r[:, 0]]), pa.array(block[r[:, 0]]), pa.array(seq[r[:, 0]]), pa.array(first[r[:, 0]]), pa.array(last[r[:, 1]]), classes, pa.array(r[:, 3]), *flags], FIELDS)


def _blocks(max_gap: int, penalty: float, final: bool):
    """Sorted parts of one level, a block at a time; decided runs among them pass."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            done = b.column(FIELDS.index("done"))
            if done.true_count:
                yield b.filter(done).select(FIELDS)
                b = b.filter(pc.invert(done))
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            keys = [t.column(c).to_numpy() for c in ("e1", "e2", "__group")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = 0 if same.all() else int(len(same) - np.argmin(same[::-1]))  # where the last block starts
            if cut:
                yield solve(t.slice(0, cut).combine_chunks(), max_gap, penalty, final)
            held = t.slice(cut).combine_chunks().to_batches()
            size = len(t) - cut
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks(), max_gap, penalty, final)

    return run


def collapse_runs(events: DataFrame, entity: tuple[str, str], order: str, tie: str, klass: str, max_gap: int, penalty: float = 0.25, min_n: int = 1, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each run of min_n or more events: the entity's two columns, first_at, last_at, duration (last_at - first_at), n, class (the run's own)."""
    rows = events.select(F.col(entity[0]).cast("long").alias("e1"), F.col(entity[1]).cast("long").alias("e2"), F.floor(F.col(order) / block).cast("long").alias("block"), F.col(order).cast("long").alias("first_at"), F.col(klass).cast("string").alias("key"), F.col(tie).cast("long").alias("tie")).where("e1 is not null and e2 is not null and first_at is not null and key is not null")
    once = rows.repartition("e1", "e2", "block").groupBy("e1", "e2", "block", "first_at", "key", "tie").agg(F.lit(1).alias("_1"))
    no = F.lit(False)
    # `seq` orders the parts of a block on later levels: the place of the first event among all of the task's rows
    parts = once.sortWithinPartitions("e1", "e2", "block", "first_at", "tie", "key").select("e1", "e2", "block", F.monotonically_increasing_id().alias("seq"), "first_at", F.col("first_at").alias("last_at"), "key", F.lit(1).cast("long").alias("n"), no.alias("fixed"), no.alias("closed"), no.alias("done"), F.col("block").alias("__group"))
    solved = materialise(parts.mapInArrow(_blocks(max_gap, penalty, False), PART_SCHEMA), "runs")
    level = solved.where("not done").withColumn("__group", F.floor(F.col("block") / fan)).repartition("e1", "e2", "__group")
    level = level.sortWithinPartitions("e1", "e2", "__group", "block", "seq").mapInArrow(_blocks(max_gap, penalty, False), PART_SCHEMA)
    # decided runs keep their block as key, so they don't gather at their entity
    level = level.withColumn("__group", F.when(F.col("done"), F.col("block"))).repartition("e1", "e2", "__group")
    level = level.sortWithinPartitions("e1", "e2", "__group", "block", "seq").withColumn("__group", F.coalesce("__group", F.lit(0))).mapInArrow(_blocks(max_gap, penalty, True), PART_SCHEMA)
    cols = ["e1", "e2", "first_at", "last_at", "n", "key"]
    out = solved.where("done").select(cols).unionByName(level.select(cols)).where(F.col("n") >= min_n)
    return out.select(F.col("e1").alias(entity[0]), F.col("e2").alias(entity[1]), "first_at", "last_at", (F.col("last_at") - F.col("first_at")).alias("duration"), "n", F.col("key").alias("class"))


def class_keys(detected: DataFrame, names: DataFrame, klass: str) -> DataFrame:
    """Adds `class_key`: ids with alike names (case, blanks, underscores and hyphens aside) share one key, others are their own.

    Ids and names keep apart by a leading letter. A null id has a null key.
    """
    flat = F.trim(F.regexp_replace(F.lower("class_name"), r"[\s_\-]+", " "))
    n = names.select(F.col("class_id").alias("__cid"), flat.alias("__flat")).where("__cid is not null and __flat is not null").groupBy("__cid").agg(F.min("__flat").alias("__flat"))
    key = F.coalesce(F.concat(F.lit("n"), F.col("__flat")), F.concat(F.lit("i"), F.col(klass).cast("string")))
    return detected.join(n, F.col(klass) == F.col("__cid"), "left").withColumn("class_key", key).drop("__cid", "__flat")
