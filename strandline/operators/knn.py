"""Nearest vectors of a gallery by inner product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of gallery vectors that one block sends to every task.
BLOCK_BYTES = 64 << 20


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def knn(queries: DataFrame, gallery: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, similarity (six digits), rank of the k best gallery vectors; ties go to the lowest id.

    The gallery goes to the tasks in blocks of bounded size, each a matrix product per Arrow batch; the k best of each block
    are ranked together. Null vectors and vectors of another length than the block's take no part.
    """
    rows = gallery.select(F.col(id_col).cast("long"), vec_col).where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    out = None
    for ids, matrix in gallery_blocks(rows):
        part = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("v")).where("v is not null").mapInArrow(_search(ids, matrix, k), "query_id long, vec_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gallery_blocks(rows: DataFrame):
    ids, vecs, size = [], [], 0
    for i, v in rows.toLocalIterator():
        if vecs and (size + len(v) * 8 > BLOCK_BYTES or len(v) != len(vecs[0])):
            yield np.array(ids), np.array(vecs)
            ids, vecs, size = [], [], 0
        ids.append(i)
        vecs.append(v)
        size += len(v) * 8
    if vecs:
        yield np.array(ids), np.array(vecs)


def _search(ids: np.ndarray, matrix: np.ndarray, k: int):
    order = np.argsort(ids)
    ids, matrix = ids[order], matrix[order].astype(np.float64)

    def run(batches):
        for b in batches:
            keep = [i for i, v in enumerate(b.column(1)) if len(v) == matrix.shape[1]]
            if not keep:
                continue
            q = np.array([b.column(1)[i].as_py() for i in keep], np.float64)
            sim = np.round(q @ matrix.T, 6)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            qid = np.array(b.column(0).take(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(sim, best, 1).ravel())], ["query_id", "vec_id", "similarity"])

    return run


def nearest_label(queries: DataFrame, gallery: DataFrame, labels: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, label, similarity: the label of the best of the gallery, as the similarity lookup appends it."""
    return knn(queries, gallery, 1, id_col, vec_col).join(labels.withColumnRenamed(id_col, "vec_id"), "vec_id").select("query_id", "label", "similarity")
