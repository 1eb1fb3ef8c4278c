"""Parquet tables and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session takes a folder of this machine; on a cluster, whose executors each would have a folder
    of their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/strandline-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/strandline-{label}-{uuid.uuid4().hex}"
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes `df` once, at once, as parquet into the shared folder and reads it back.

    The files are on storage that outlives any executor, so a lost executor only costs the tasks it was running. A plan that
    holds such a step runs up to it when it is built, also for `explain`.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, for stages that compute much per row: over as many partitions as strandline.scan.partitions says.

    Without that setting the scan stays as its files and spark.sql.files.maxPartitionBytes cut it, whatever its size.
    """
    n = scan.sparkSession.conf.get("strandline.scan.partitions", None)
    return scan.repartition(int(n)) if n else scan
