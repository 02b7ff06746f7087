"""Adjacency codecs: deltas, variable bytes and fixed-width blocks, in numpy and as sizes in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 128
LIMITS = (1 << 7, 1 << 14, 1 << 21, 1 << 28)


def deltas(ids) -> np.ndarray:
    """First id and differences; ids must be sorted, unsigned 32-bit."""
    a = np.asarray(ids, np.int64)
    if len(a) and (a[0] < 0 or a[-1] >= 1 << 32 or (np.diff(a) < 0).any()):
        raise ValueError("ids must be sorted unsigned 32-bit numbers")
    return np.diff(a, prepend=0)


def undeltas(d) -> np.ndarray:
    a = np.cumsum(np.asarray(d, np.uint64))
    if len(a) and a[-1] >= 1 << 32:
        raise ValueError("a delta overflows")
    return a.astype(np.int64)


def varbyte_encode(values) -> bytes:
    """Seven bits a byte, low first, the high bit set on all but a value's last byte."""
    v = np.asarray(values, np.uint64)
    n = 1 + sum((v >= limit).astype(np.int64) for limit in LIMITS)
    at = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(n.sum()) - at
    out = (np.repeat(v, n) >> (7 * k).astype(np.uint64)) & np.uint64(127)
    return (out | np.where(k < np.repeat(n, n) - 1, 128, 0).astype(np.uint64)).astype(np.uint8).tobytes()


def varbyte_decode(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    if b[-1] & 128:
        raise ValueError("the stream is cut off")
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (ends - starts).max() > 4:
        raise ValueError("a value overflows")
    k = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((b & 127).astype(np.uint64) << (7 * k).astype(np.uint64), starts)
    if values.max() >= 1 << 32:
        raise ValueError("a value overflows")
    return values.astype(np.int64)


def blocked_varbyte(ids, block: int = BLOCK) -> tuple[bytes, list[tuple[int, int, int]]]:
    """Bytes, and (first value, values, first byte) of each block, whose deltas start anew."""
    out, marks = bytearray(), []
    for k in range(0, len(ids), block):
        part = ids[k : k + block]
        marks.append((k, len(part), len(out)))
        out += varbyte_encode(deltas(part))
    return bytes(out), marks


def blocked_varbyte_decode(raw: bytes, marks: list[tuple[int, int, int]]) -> np.ndarray:
    ends = [m[2] for m in marks[1:]] + [len(raw)] * bool(marks)
    parts = [undeltas(varbyte_decode(raw[m[2] : z])) for m, z in zip(marks, ends, strict=True)]
    if any(len(p) != m[1] for p, m in zip(parts, marks, strict=True)):
        raise ValueError("a block has another number of values")
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fixed_encode(ids, block: int = BLOCK) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """Little-endian deltas in lanes of 1, 2 or 4 bytes, and (first value, values, first byte, lane) of each block."""
    if block <= 0:
        raise ValueError("block size must be positive")
    out, marks = bytearray(), []
    for k in range(0, len(ids), block):
        d = deltas(ids[k : k + block])
        lane = 1 if d.max() < 1 << 8 else 2 if d.max() < 1 << 16 else 4
        marks.append((k, len(d), len(out), lane))
        out += d.astype(f"<u{lane}").tobytes()
    return bytes(out), marks


def fixed_decode(raw: bytes, marks: list[tuple[int, int, int, int]]) -> np.ndarray:
    parts = [undeltas(np.frombuffer(raw, f"<u{lane}", n, at)) for _, n, at, lane in marks]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def ratio(values: int, encoded: int) -> float:
    """Plain bytes over encoded ones; 1 if both are empty, 0 if only the encoding is."""
    return values * 4 / encoded if encoded else float(values == 0)


def encode_lists(lists: DataFrame, column: str = "neighbors") -> DataFrame:
    """Add ``varbyte`` and ``fixed`` bytes of sorted arrays, in Arrow batches."""
    varbyte = F.pandas_udf(lambda s: s.map(lambda x: varbyte_encode(deltas(x))), "binary")
    fixed = F.pandas_udf(lambda s: s.map(lambda x: fixed_encode(x)[0]), "binary")
    for f in (varbyte, fixed):
        f.func.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lists.withColumns({"varbyte": varbyte(column), "fixed": fixed(column)})


def sizes(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(v, n, varbyte_bytes, fixed_bytes) of each vertex's sorted neighbours, without encoding them."""
    w = Window.partitionBy("src").orderBy("dst")
    rows = arcs.select("src", "dst", F.row_number().over(w).alias("_k"), F.lag("dst", 1, 0).over(w).alias("_p"))
    rows = rows.withColumn("_b", F.floor((F.col("_k") - 1) / block)).withColumn("_d", F.col("dst") - F.col("_p"))
    bytes_of = 1 + sum(F.when(F.col("_d") >= limit, 1).otherwise(0) for limit in LIMITS)
    lane_of = F.when((F.col("_k") - 1) % block == 0, F.col("dst")).otherwise(F.col("_d"))
    per_block = rows.groupBy("src", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum(bytes_of).alias("_v"), F.max(lane_of).alias("_m"))
    lane = F.when(F.col("_m") < 1 << 8, 1).when(F.col("_m") < 1 << 16, 2).otherwise(4)
    return per_block.groupBy(F.col("src").alias("v")).agg(F.sum("_n").alias("n"), F.sum("_v").alias("varbyte_bytes"), F.sum(F.col("_n") * lane).alias("fixed_bytes"))


def choice(rows: DataFrame, vector: bool = True, overhead: float = 1.10) -> DataFrame:
    """Add ``codec``: fixed where smaller, or with a vector decoder where at most ``overhead`` as large."""
    if overhead < 1.0:
        raise ValueError("the allowed overhead must be at least 1")
    near = F.lit(vector) & (F.col("n") > 0) & (F.col("fixed_bytes") <= overhead * F.col("varbyte_bytes"))
    return rows.withColumn("codec", F.when((F.col("fixed_bytes") < F.col("varbyte_bytes")) | near, "fixed").otherwise("varbyte"))


def calibrate(rows: DataFrame) -> DataFrame:
    """Median overhead of the fixed codec among families where it decodes faster; rows (family, codec, encoded_bytes, decode_us)."""
    f, v = rows.where("codec = 'fixed'").alias("f"), rows.where("codec = 'varbyte'").alias("v")
    both = f.join(v, F.col("f.family") == F.col("v.family")).select((F.col("f.encoded_bytes") / F.col("v.encoded_bytes")).alias("overhead"), (F.col("f.decode_us") < F.col("v.decode_us")).alias("wins"))
    return both.agg(F.percentile(F.when(F.col("wins"), F.col("overhead")), F.lit(0.5)).alias("overhead"), F.count_if("wins").alias("families"))
