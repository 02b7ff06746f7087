"""Graph files: Parquet snapshots, a compact binary file, partition files, and checked datasets."""

from __future__ import annotations

import hashlib
import shutil
import struct
import urllib.request
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from .memory import _frame


def save_graph(graph: Graph, path: str) -> None:
    """Arcs as Parquet, sorted by ranges of the source so that scans of a vertex prune, with one row of metadata beside them."""
    graph.arcs().repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/arcs")
    graph.spark.createDataFrame([(graph.n, graph.directed, graph.version)], "n long, directed boolean, version long").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> Graph:
    meta = spark.read.schema("n long, directed boolean, version long").json(f"{path}/meta").first()
    g = Graph(spark, meta.n, meta.directed)
    g.base, g.version = spark.read.parquet(f"{path}/arcs"), meta.version
    return g


BINARY_MAGIC = b"EVOG0001"


def save_binary(graph: Graph, path: str) -> None:
    """A driver-side file for small graphs: magic, vertices, pairs, then (u, v) in order of adjacency; direction is not stored."""
    pairs = graph.arcs().orderBy("src", "dst").toPandas().to_numpy("<u4")
    Path(path).write_bytes(BINARY_MAGIC + struct.pack("<QQ", graph.n, len(pairs)) + pairs.tobytes())


def load_binary(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    raw = Path(path).read_bytes()
    if raw[:8] != BINARY_MAGIC:
        raise ValueError("not a graph file")
    if len(raw) < 24 or len(raw) != 24 + 8 * struct.unpack("<Q", raw[16:24])[0]:
        raise ValueError("the graph file is cut off")
    pairs = np.frombuffer(raw, "<u4", offset=24).reshape(-1, 2)
    pairs = pairs if directed else pairs[pairs[:, 0] <= pairs[:, 1]]
    return Graph.from_edges(_frame(spark, pairs[:, 0], pairs[:, 1]), directed, struct.unpack("<Q", raw[8:16])[0])


PARTITION_HEAD = struct.Struct("<4sHHQQ")
PARTITION_MAGIC = b"EVPF"


def write_partition(path: str, number: int, payload: bytes, version: int = 1) -> None:
    Path(path).write_bytes(PARTITION_HEAD.pack(PARTITION_MAGIC, version, 0, number, len(payload)) + payload)


def read_partition(path: str, number: int) -> bytes:
    raw = Path(path).read_bytes()
    if len(raw) < PARTITION_HEAD.size:
        raise ValueError("the partition file is cut off")
    magic, version, _, found, size = PARTITION_HEAD.unpack_from(raw)
    if magic != PARTITION_MAGIC or version != 1:
        raise ValueError("not a partition file of this version")
    if found != number:
        raise ValueError(f"partition {found}, not {number}")
    if len(raw) != PARTITION_HEAD.size + size:
        raise ValueError("the partition file is cut off")
    return raw[PARTITION_HEAD.size :]


def prepare_dataset(source: str, target: str, sha256: str | None = None) -> str:
    """Copy or download a file and hold it against its digest; a file that fails is removed."""
    if "://" in source:
        with urllib.request.urlopen(source) as got, open(target, "wb") as out:
            shutil.copyfileobj(got, out)
    else:
        shutil.copyfile(source, target)
    with open(target, "rb") as f:
        found = hashlib.file_digest(f, "sha256").hexdigest()
    if sha256 and found != sha256.lower():
        Path(target).unlink()
        raise ValueError(f"digest {found}, not {sha256}")
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
