"""Iteration: cutting lineage, and the shared relaxation loop."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a frontier is broadcast; beyond it, the join shuffles both sides.
BROADCAST_ROWS = 200_000

_dirs: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only where it is unset and all runs in one process, as in tests, a temporary folder."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.applicationId not in _dirs:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evograph-"))
        _dirs.add(spark.sparkContext.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: lineage ends here, and lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def relax(dist: DataFrame, frontier: DataFrame, arcs: DataFrame, within: DataFrame | None = None, most: int | None = None, key: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Delta relaxation: (final distances, rounds).

    ``dist`` and ``frontier`` are (*key, v, d), ``arcs`` is (src, dst, w) with w >= 0.  Each round extends the rows that
    improved in the last one; sums above ``most`` are discarded before they are formed.  With ``within``,
    only its vertices (v) may change.  Weights being non-negative, the fixed point is the shortest distance.
    """
    names, rounds = [*key, "v", "d"], 0
    dist, frontier = cut(dist.select(*names)), cut(frontier.select(*names))
    while size := frontier.count():
        rounds += 1
        step = arcs.join(sized(frontier, size).withColumnRenamed("v", "src"), "src")
        if most is not None:
            step = step.where(F.col("w") <= F.lit(most) - F.col("d"))
        if within is not None:
            step = step.join(within.select(F.col("v").alias("dst")), "dst", "left_semi")
        best = step.groupBy(*key, F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("_new"))
        frontier = cut(best.join(dist, [*key, "v"], "left").where("d is null or _new < d").select(*key, "v", F.col("_new").alias("d")))
        dist = cut(dist.unionByName(frontier).groupBy(*key, "v").agg(F.min("d").alias("d")))
    return dist, rounds
