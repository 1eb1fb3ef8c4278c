"""Top N rows within every group, by partition lower bounds.

1. Every input partition sorts its rows and keeps its N best distinct items of a group, with their local rank. A redelivered
   item stands beside its copy there and counts once. The survivors are written to the shared folder.
2. The N-th best of a partition is a lower bound for its group: N distinct items at least as good exist. The greatest bound of
   each group comes from a partial aggregation of one row for each partition and group that has N items.
3. The bounds are joined to the survivors where these lie, before anything else moves, and survivors below their group's bound
   are dropped. The bounds are broadcast only if their measured size is at most BROADCAST_BYTES; if not, bounds and survivors
   meet by group, which is the partitioning the ranking needs anyway.
4. What is left is exchanged once, by group, and ranked.

A group of any size thus sends at most N rows for each partition to the ranking task.

Defined results: rows whose score is null or NaN take no part; repeated rows of an item (equal group, score and
tie-break columns) count once; ties follow the tie-break columns ascending, nulls last; groups with a null key are
groups of their own; n < 1 or an empty table gives no rows. `top_n` runs the first two steps when it is called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandline.sources.tables import materialise

#: Size up to which the groups' bounds are broadcast.
BROADCAST_BYTES = 32 << 20


def _changes(col: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are alike."""
    a, b = col[1:], col[:-1]
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _local_best(n_group: int, n: int, names: list[str]):
    """Rows sorted by group, score and ties to the first n distinct ones of each group, with their rank."""

    def run(batches):
        held, rank = None, 0  # the last row so far and its rank
        for b in batches:
            if not b.num_rows:
                continue
            t = (pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])).combine_chunks()
            cols = [c.chunk(0) for c in t.columns]
            size = len(cols[0])
            group, item = np.zeros(size, bool), np.zeros(size, bool)
            for i, c in enumerate(cols):
                changed = _changes(c)
                item[1:] |= changed
                if i < n_group:
                    group[1:] |= changed
            group[0] = item[0] = held is None
            number = np.cumsum(item)
            first = np.where(group, number, 0)
            first[0] = 1 if held is None else number[0] - rank + 1
            ranks = number - np.maximum.accumulate(np.where(group | (np.arange(size) == 0), first, np.iinfo(np.int64).min)) + 1
            keep = item & (ranks <= n)
            held, rank = t.slice(size - 1), int(ranks[-1])
            if keep.any():
                out = t.filter(pa.array(keep)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in out.columns], pa.array(ranks[keep].astype(np.int32))], names)

    return run


def top_n(df: DataFrame, groups: list[str], score: Column, ties: list[str], n: int) -> DataFrame:
    """groups + ties + (score, rank) of the n best items of each group."""
    g = [f"__g{i}" for i in range(len(groups))]
    t = [f"__t{i}" for i in range(len(ties))]
    items = df.select(*[F.col(c).alias(a) for c, a in zip(groups, g)], (score.cast("double") + F.lit(0.0)).alias("__s"), *[F.col(c).alias(a) for c, a in zip(ties, t)]).where("__s is not null and not isnan(__s)")
    order = [F.col("__s").desc(), *[F.col(c).asc_nulls_last() for c in t]]
    out = lambda rows: rows.select(*[F.col(a).alias(c) for c, a in zip(groups + ties, g + t)], F.col("__s").alias("score"), "rank")
    if n < 1:
        return out(items.limit(0).withColumn("rank", F.lit(0)))
    schema = StructType([*items.schema.fields, StructField("__r", IntegerType())])
    local = materialise(items.sortWithinPartitions(*g, *order).mapInArrow(_local_best(len(g), n, schema.names), schema), "top-survivors")
    bounds = local.where(F.col("__r") == n).groupBy(*g).agg(F.max("__s").alias("__b")).select(*[F.col(c).alias(f"__k{c}") for c in g], "__b")
    bounds = materialise(bounds, "top-bounds")
    text = [F.coalesce(F.octet_length(F.col(f"__k{c}").cast("string")), F.lit(0)) for c in g]
    size = bounds.agg(F.sum(sum(text, F.lit(16 + 16 * len(g))))).first()[0] or 0
    same = F.lit(True)
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"__k{c}"))
    left = local.join(F.broadcast(bounds) if size <= BROADCAST_BYTES else bounds, same, "left").where("__b is null or __s >= __b")
    ranked = left.withColumn("rank", F.dense_rank().over(Window.partitionBy(*g).orderBy(*order))).where(F.col("rank") <= n)
    # an item redelivered in another partition holds the same rank twice
    return out(ranked.dropDuplicates([*g, "rank"]))
