"""Helpers shared by the operators: shared storage, Arrow passes and words."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a slice of rows that is worked on together; a longer row is worked on alone.
MOST_BYTES = 8 << 20

_own_dir: dict[str, str] = {}
_written: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only where that is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="evograph-llm-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses no rows."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = weakref.ref(out), path
    return out


def release(*written: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these, once nothing will read them again, and the shuffle files of finished jobs.

    Spark deletes shuffle files when the driver's JVM collects what refers to them, which it may not do for long; so it is asked to.
    """
    for df in written:
        of, path = _written.pop(id(df), (None, None))
        if of and of() is df:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if written:
        written[0].sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def slices(batch: pa.RecordBatch, rows: int = 512, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``rows`` rows and, unless one row alone has more, ``most`` bytes."""
    sizes, known = np.zeros(batch.num_rows, np.int64), 0
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, known = sizes + length, known + int(length.sum())
    # Nested columns count evenly.
    upto = np.cumsum(sizes + max(0, batch.nbytes - known) // max(batch.num_rows, 1))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | T.StructType, rows: int = 512, most: int = MOST_BYTES) -> DataFrame:
    """``mapInArrow`` over :func:`slices`.

    ``make`` runs once a task and returns a function from a dictionary of input columns (lists)
    to one of output columns (lists or arrays), so a slice is all that is held at a time.
    """
    out = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, rows, most):
                got = step(part.to_pydict())
                arrays = [pa.array(got[f.name], type=f.type) for f in out]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
