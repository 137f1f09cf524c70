"""Shared pieces: tables staged in the cluster's shared folder, and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions that a task writes one after the other share a file beyond so many for each core.
FILES_PER_CORE = 8

#: For each ``scratch`` that is open, the tables staged since.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a folder under the system's temp folder is used if driver and executors are one
    process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "tessella")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    It cuts the lineage, so that what follows neither recomputes ``df`` nor depends on the
    executors that made it. Its files are as many as keep all cores busy several times over, not as many as there
    are partitions: most of these tables are small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    for paths in _open:
        paths.append(path)
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    for df in tables:
        delete(df.sparkSession, df._staged_path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes on leaving all tables that were staged inside.

    Operators return lazy results that read their staged tables, so those stay until someone who knows that the
    results have been written deletes them; with ``scratch`` around operator and write, that is done here.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            delete(spark, path)


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the links ``x[k], y[k]``."""
    comp = np.arange(n)
    while True:
        new = comp.copy()
        np.minimum.at(new, x, comp[y])
        np.minimum.at(new, y, comp[x])
        new = new[new]
        if (new == comp).all():
            return comp
        comp = new


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``: rows ``(id, component_id)``.

    ``component_id`` is the smallest id reachable. Only ids that occur in an edge get a row; null
    ends and loops are ignored. Each round takes the smallest label among the neighbours and then
    follows the label's own label, so that long chains shrink by doubling; the labels of a round
    are a table in the shared folder, and only the number of changed labels comes to the driver.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = staged(edges.union(edges.select("b", "a")).toDF("src", "dst").distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
    labels = staged(labels.select("id", F.least("id", "m").alias("comp"), F.lit(True).alias("changed")), f"{name}-0")
    for k in range(1, most):
        near = both.join(labels.select(F.col("id").alias("src"), "comp"), "src")
        near = near.groupBy(F.col("dst").alias("id")).agg(F.min("comp").alias("m"))
        hooked = labels.select("id", F.col("comp").alias("old")).join(near, "id", "left")
        hooked = hooked.select("id", "old", F.least("old", "m").alias("c"))
        parent = labels.select(F.col("id").alias("c"), F.col("comp").alias("up"))
        moved = hooked.join(parent, "c", "left").select("id", "old", F.least("c", "up").alias("comp"))
        new = staged(moved.select("id", "comp", (F.col("comp") != F.col("old")).alias("changed")), f"{name}-{k}")
        unstage(labels)
        labels = new
        if not labels.where("changed").limit(1).count():
            unstage(both)
            return labels.select("id", F.col("comp").alias("component_id"))
    raise RuntimeError(f"components did not settle in {most} rounds")
