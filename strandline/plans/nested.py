"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import nested
from strandline.sources.tables import shared_path, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The links of all nodes, from the tagged rows with their payloads as `p5_tables` writes them."""
    return nested.emit_nodes(table(spark, d, "sink_frames")).select("record_id", "parent_path", "node_path")


def p5_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of boxes with its schema applied."""
    return nested.typed_table(nested.emit_nodes(table(spark, d, "sink_frames")), nested.BOX)


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """All five flat tables, typed, under their tag; the tagged rows are written once, by tag, into the shared folder."""
    path = shared_path(spark, "nodes")
    nested.flatten_to(table(spark, d, "sink_frames"), path)
    nodes = spark.read.schema(nested.NODE_SCHEMA).parquet(path)
    out = None
    for tag in nested.TABLE_FIELDS:
        t = nested.typed_table(nodes, tag).withColumn("tag", F.lit(tag))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


QUERIES = {"p5_found": p5_found, "p5_boxes": p5_boxes, "p5_tables": p5_tables}
ORACLE: dict[str, str] = {}
