"""k-core numbers by the H-index fixed point."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import blocks
from .graph import degrees


def core_numbers(arcs: DataFrame, vertices: DataFrame, most: DataFrame | None = None) -> DataFrame:
    """(v, core).  Estimates start at the degree and fall to the largest h such that h neighbours have an estimate of at least h.

    Any start that is nowhere too small leads to the same numbers; ``most`` (v, most) is such a bound.  A block lowers its own estimates as far
    as they go before it sends them, so rounds are spent on what lies between blocks.
    """
    start = vertices.join(degrees(arcs), "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("core"))
    if most is not None:
        start = start.join(most, "v", "left").select("v", F.least("core", F.coalesce("most", "core")).alias("core"))
    packed, parts = blocks.pack_arcs(arcs.select("src", "dst"))
    rows = blocks.one_round(packed, parts, blocks.pack_values(start, "core", np.int32), _step(True))
    while True:
        rows = blocks.one_round(packed, parts, rows, _step(False))
        if not rows.agg(F.sum("a")).first()[0]:
            break
    packed.unpersist()
    return blocks.unpack_values(rows, "core", np.int32, "int").select("v", F.col("core").cast("long").alias("core"))


def h_indices(src: np.ndarray, est: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, largest h such that h of the vertex's arcs have an estimate of at least h)."""
    keys = np.sort((src << 32) | ((1 << 31) - est))
    src, est = keys >> 32, (1 << 31) - (keys & 0xFFFFFFFF)
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
    rank = np.arange(len(src)) - np.repeat(first, np.diff(np.r_[first, len(src)])) + 1
    return src[first], np.maximum.reduceat(np.minimum(est, rank), first)


def _step(first: bool):
    def step(key, left, right):
        b = blocks.Block(key, left, right, np.int32)
        if not b.arcs:
            return blocks.inbox([(b.id, -1, b.offs, np.zeros(len(b.offs), np.int32), 0.0, 0.0, 0.0)])
        est = np.zeros(blocks.SIZE, np.int64)
        est[b.offs] = b.vals
        changed = 0
        if not first:
            seen, sent, own, near = np.zeros(len(b.dst), np.int64), {s: (o, v) for s, o, v in b.sent}, None, b.dst & blocks.MASK
            for to, i, j in b.segments:
                if to == b.id:
                    own = slice(i, j)
                    seen[own] = est[near[own]]
                elif to in sent:
                    theirs = np.zeros(blocks.SIZE, np.int64)
                    theirs[sent[to][0]] = sent[to][1]
                    seen[i:j] = theirs[near[i:j]]
            before, take = est.copy(), slice(None)
            while True:
                at, h = h_indices(b.src[take], np.minimum(seen[take], est[b.src[take]]))
                fell = at[h < est[at]]
                est[at] = np.minimum(h, est[at])
                if own is None or not len(fell):
                    break
                fallen, touched = np.zeros(blocks.SIZE, bool), np.zeros(blocks.SIZE, bool)
                fallen[fell] = True
                seen[own] = est[near[own]]
                touched[b.src[own][fallen[near[own]]]] = True
                take = np.flatnonzero(touched[b.src])
                if not len(take):
                    break
            changed = int((est != before).sum())
        out = [(b.id, -1, b.offs, est[b.offs].astype(np.int32), float(changed), 0.0, 0.0)]
        for to, i, j in b.segments:
            if to != b.id:
                who = b.src[i:j][np.r_[True, b.src[i + 1:j] != b.src[i:j - 1]]]
                out.append((to, b.id, who, est[who].astype(np.int32), 0.0, 0.0, 0.0))
        return blocks.inbox(out)

    return step
