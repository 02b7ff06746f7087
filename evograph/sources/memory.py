"""Edges from arrays and tables in the driver's memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators.graph import Graph


def _frame(spark: SparkSession, src, dst) -> DataFrame:
    src, dst = np.asarray(src, np.int64), np.asarray(dst, np.int64)
    if len(src) and (min(src.min(), dst.min()) < 0 or max(src.max(), dst.max()) > schema.UNREACHABLE):
        raise ValueError("vertex ids must lie in 0 to 2^32 - 1")
    return spark.createDataFrame(pd.DataFrame({"src": src, "dst": dst}), "src long, dst long")


def from_numpy_edges(spark: SparkSession, edges, directed: bool = False) -> Graph:
    a = np.asarray(edges)
    if a.ndim != 2 or a.shape[1] != 2:
        raise ValueError("edges must have the shape (n, 2)")
    return Graph.from_edges(_frame(spark, a[:, 0], a[:, 1]), directed)


def from_scipy_csr(spark: SparkSession, csr, directed: bool = False) -> Graph:
    """From any object with shape, indptr and indices; isolated vertices count through the shape."""
    n, m = csr.shape
    indptr, indices = np.asarray(csr.indptr, np.int64), np.asarray(csr.indices, np.int64)
    if n != m:
        raise ValueError("the matrix must be square")
    if len(indptr) != n + 1 or indptr[0] != 0 or (np.diff(indptr) < 0).any() or indptr[-1] != len(indices):
        raise ValueError("the row offsets are malformed")
    if len(indices) and (indices.min() < 0 or indices.max() >= n):
        raise ValueError("a column is out of range")
    src = np.repeat(np.arange(n), np.diff(indptr))
    keep = np.ones(len(src), bool) if directed else indices >= src
    return Graph.from_edges(_frame(spark, src[keep], indices[keep]), directed, n)


def from_arrow_columns(spark: SparkSession, src, dst, directed: bool = False) -> Graph:
    if len(src) != len(dst):
        raise ValueError("the columns differ in length")
    plain = lambda c: c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()
    return Graph.from_edges(_frame(spark, plain(src), plain(dst)), directed)


def from_arrow_table(spark: SparkSession, table: pa.Table, src: str = "src", dst: str = "dst", directed: bool = False) -> Graph:
    return from_arrow_columns(spark, table.column(src), table.column(dst), directed)
