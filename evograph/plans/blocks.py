"""Rounds over blocks of vertices whose arcs stay where they are.

A block holds the vertices whose ids share all but the last ``BITS`` bits, and its arcs as arrays, ordered by the other
end's block.  Blocks are dealt to partitions once and cached; a round brings each block its own values and what the others
send it, in one shuffle of packed messages, and runs in numpy.  Lost partitions are rebuilt from the checkpoint behind them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixpoint

BITS = 13
MASK = (1 << BITS) - 1
SIZE = 1 << BITS

#: What a block gets: its own values (``sender`` -1) or a message of another; ``a``, ``b`` and ``c`` are numbers that the driver sums or bounds.
INBOX = "block long, sender long, offs binary, vals binary, a double, b double, c double"
_SCHEMA = pa.schema([("block", pa.int64()), ("sender", pa.int64()), ("offs", pa.binary()), ("vals", pa.binary()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64())])


def block_of(c: str, bits: int = BITS) -> Column:
    return F.shiftright(c, bits)


def deal(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "block")


def pack_arcs(arcs: DataFrame, bits: int = BITS) -> tuple[DataFrame, int]:
    """(blocks (block, src, dst[, w]), cached; their partitions)."""
    weighted = "w" in arcs.columns

    def pack(key, rows):
        src, dst = (rows.column(c).to_numpy() for c in ("src", "dst"))
        order = np.lexsort((dst, src, dst >> bits))
        out = {"block": [key[0].as_py()], "src": [(src[order] & (1 << bits) - 1).astype(np.uint16).tobytes()], "dst": [dst[order].tobytes()]}
        if weighted:
            out["w"] = [rows.column("w").to_numpy()[order].tobytes()]
        return pa.table(out, schema=pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in out if c != "block"]))

    packed = fixpoint.cut(arcs.groupBy(block_of("src", bits).alias("block")).applyInArrow(pack, "block long, src binary, dst binary" + ", w binary" * weighted))
    spark = arcs.sparkSession
    parts = max(16, 2 * spark.sparkContext.defaultParallelism, packed.count() // 32)
    return deal(packed, parts).persist(), parts


def pack_values(values: DataFrame, column: str, dtype: type, bits: int = BITS) -> DataFrame:
    """Inbox rows of (v, ``column``)."""

    def pack(key, rows):
        return inbox([(key[0].as_py(), -1, rows.column("v").to_numpy() & (1 << bits) - 1, rows.column(column).to_numpy().astype(dtype), 0.0, 0.0, 0.0)])

    return values.groupBy(block_of("v", bits).alias("block")).applyInArrow(pack, INBOX)


def unpack_values(rows: DataFrame, column: str, dtype: type, sql: str, bits: int = BITS) -> DataFrame:
    """(v, ``column``) of the blocks' own values."""

    def unpack(batches):
        for batch in batches:
            for block, offs, vals in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array((block << bits) + np.frombuffer(offs, np.uint16).astype(np.int64)), pa.array(np.frombuffer(vals, dtype))], names=["v", column])

    return rows.where("sender = -1").select("block", "offs", "vals").mapInArrow(unpack, f"v long, {column} {sql}")


def inbox(rows: list[tuple]) -> pa.Table:
    """Rows (block, sender, offsets, values, a, b, c)."""
    block, sender, offs, vals, a, b, c = zip(*rows) if rows else ([],) * 7
    return pa.table([pa.array(block, pa.int64()), pa.array(sender, pa.int64()), pa.array([np.asarray(o, np.uint16).tobytes() for o in offs], pa.binary()), pa.array([np.ascontiguousarray(v).tobytes() for v in vals], pa.binary()), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(c, pa.float64())], schema=_SCHEMA)


class Block:
    """A block's arcs and what it was sent."""

    def __init__(self, key, left: pa.Table, right: pa.Table, dtype: type, bits: int = BITS):
        self.id, self.arcs = key[0].as_py(), left.num_rows > 0
        read = lambda c, t: np.frombuffer(left.column(c)[0].as_py(), t)
        if self.arcs:
            self.src, self.dst = read("src", np.uint16).astype(np.int64), read("dst", np.int64)
            self.w = read("w", np.int64) if "w" in left.column_names else None
            to = self.dst >> bits
            at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            #: The arcs of each other block: (block, from, to).
            self.segments = list(zip(to[at].tolist(), at.tolist(), [*at[1:].tolist(), len(to)]))
        self.offs, self.vals, self.sent = np.empty(0, np.int64), np.empty(0, dtype), []
        for sender, offs, vals in zip(*(right.column(c).to_pylist() for c in ("sender", "offs", "vals"))):
            o, v = np.frombuffer(offs, np.uint16).astype(np.int64), np.frombuffer(vals, dtype)
            if sender == -1:
                self.offs, self.vals = o, v
            else:
                self.sent.append((sender, o, v))


def one_round(packed: DataFrame, parts: int, rows: DataFrame, step: Callable[[object, pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """The next inbox."""
    return fixpoint.cut(packed.groupBy("block").cogroup(deal(rows, parts).groupBy("block")).applyInArrow(step, INBOX))


FAR = np.iinfo(np.int64).max
#: Rounds after which the distances held so far are written as one table.
TOGETHER = 8
#: Bits of a block in a search, as many as an offset has: paths leave wide blocks less often.
WIDE = 16


def relax(dist: DataFrame, frontier: DataFrame, arcs: DataFrame, most: int) -> DataFrame:
    """(v, d): shortest distances from ``dist`` (v, d), of which ``frontier`` (v, d) is what has improved; arcs (src, dst, w), w >= 0, sums above ``most`` dropped.

    A block goes on until nothing in it improves, then offers the least sums to others.  Only blocks with offers are read, sent and
    computed in a round.
    """
    spark = arcs.sparkSession
    packed, parts = pack_arcs(arcs.select("src", "dst", "w"), WIDE)
    held = fixpoint.cut(pack_values(dist, "d", np.int64, WIDE))
    offers = fixpoint.cut(pack_values(frontier, "d", np.int64, WIDE).withColumn("sender", F.lit(-2).cast("long")))
    step, rounds = _relax_step(most), 0
    while active := [(r.block,) for r in offers.select("block").distinct().collect()]:
        rounds += 1
        now = F.broadcast(spark.createDataFrame(active, "block long"))
        some = packed.join(now, "block", "left_semi")
        rows = offers.unionByName(held.join(now, "block", "left_semi"))
        out = one_round(some, parts, rows, step)
        offers = out.where("sender <> -1")
        held = held.join(now, "block", "left_anti").unionByName(out.where("sender = -1"))
        if rounds % TOGETHER == 0:
            held = fixpoint.cut(held.coalesce(parts))
    packed.unpersist()
    return fixpoint.cut(unpack_values(held, "d", np.int64, "long", WIDE))


def _relax_step(most: int):
    def step(key, left, right):
        b = Block(key, left, right, np.int64, WIDE)
        size, mask = 1 << WIDE, (1 << WIDE) - 1
        d, better = np.full(size, FAR), np.zeros(size, bool)
        d[b.offs] = b.vals
        for sender, offs, vals in b.sent:
            less = (vals < d[offs]) | ((vals == d[offs]) & (sender == -2))
            d[offs[less]], better[offs[less]] = vals[less], True
        out, ever = [], better.copy()
        if b.arcs and better.any():
            own = next((slice(i, j) for to, i, j in b.segments if to == b.id), slice(0, 0))
            src, near, w = b.src[own], b.dst[own] & mask, b.w[own]
            while better.any():
                take = np.flatnonzero(better[src])
                take = take[w[take] <= most - d[src[take]]]
                before = d.copy()
                np.minimum.at(d, near[take], d[src[take]] + w[take])
                better = d < before
                ever |= better
            for to, i, j in b.segments:
                if to != b.id:
                    take = np.flatnonzero(ever[b.src[i:j]]) + i
                    take = take[b.w[take] <= most - d[b.src[take]]]
                    if len(take):
                        heads, at = np.unique(b.dst[take] & mask, return_inverse=True)
                        least = np.full(len(heads), FAR)
                        np.minimum.at(least, at, d[b.src[take]] + b.w[take])
                        out.append((to, b.id, heads, least, 0.0, 0.0, 0.0))
        reached = np.flatnonzero(d < FAR)
        return inbox([(b.id, -1, reached, d[reached], 0.0, 0.0, 0.0), *out])

    return step
