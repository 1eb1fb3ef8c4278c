"""Occurrences and record counts of every distinct value.

Rows are first made distinct by their occurrence key (map-side hash aggregation drops most copies before the shuffle),
then counted per record and term, then per term; each step aggregates partially before it shuffles, so a term or a
record that holds a third of the rows arrives as one partial row from each task.

Defined results: null terms are not counted, every other value is (the empty string too); a null in the record key is a
record of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_frequencies(df: DataFrame, term: Column, record: list[str], occurrence: list[str]) -> DataFrame:
    """term, occurrences, records. `occurrence` with `record` identifies one occurrence however often it was delivered."""
    keys = [f"__r{i}" for i in range(len(record))]
    occ = [f"__o{i}" for i in range(len(occurrence))]
    rows = df.select(term.cast("string").alias("term"), *[F.col(c).alias(a) for c, a in zip(record + occurrence, keys + occ)]).where(F.col("term").isNotNull())
    once = rows.groupBy("term", *keys, *occ).agg(F.lit(1).alias("__one"))
    per_record = once.groupBy("term", *keys).agg(F.count(F.lit(1)).alias("n"))
    return per_record.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def record_total(df: DataFrame, term: Column, record: list[str]) -> DataFrame:
    """One row: the number of records that hold the field at all."""
    keys = [f"__r{i}" for i in range(len(record))]
    rows = df.where(term.isNotNull()).select(*[F.col(c).alias(a) for c, a in zip(record, keys)])
    return rows.groupBy(*keys).agg(F.lit(1).alias("__one")).agg(F.count(F.lit(1)).alias("total"))


def mark_terms(freq: DataFrame, total: DataFrame, rare_below: int = 5, common_above: float = 0.25, fewest: int = 1) -> DataFrame:
    """Adds total and mark: 'rare' below `rare_below` records or `fewest` occurrences, else 'common' above that share of the field's records, else null.

    Both sides name their field in field_name; `total` has one row for each field.
    """
    mark = F.when((F.col("records") < rare_below) | (F.col("occurrences") < fewest), "rare").when(F.col("records") > F.col("total") * common_above, "common")
    return freq.join(F.broadcast(total), "field_name").withColumn("mark", mark)
