"""PageRank by power iteration, with two stopping rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..plans import blocks, fixpoint
from .graph import degrees


class Rounds:
    """Power iteration over cached blocks: a round sends what each block owes to another, summed by vertex."""

    def __init__(self, arcs: DataFrame, n: int, damping: float):
        self.n, self.damping = n, damping
        self.packed, self.parts = blocks.pack_arcs(arcs.select("src", "dst"))

    def start(self, ranks: DataFrame) -> None:
        self.rows = blocks.one_round(self.packed, self.parts, blocks.pack_values(ranks, "rank", np.float64), _step(None, self.damping))
        self.lost = self.rows.agg(F.sum("c")).first()[0]

    def advance(self) -> tuple[float, float]:
        """One round; its change (L1, largest)."""
        base = ((1.0 - self.damping) + self.damping * self.lost) / self.n
        self.rows = blocks.one_round(self.packed, self.parts, self.rows, _step(base, self.damping))
        l1, linf, self.lost = self.rows.agg(F.sum("a"), F.max("b"), F.sum("c")).first()
        return l1, linf

    def ranks(self) -> DataFrame:
        return blocks.unpack_values(self.rows, "rank", np.float64, "double")

    def close(self) -> None:
        self.packed.unpersist()


def _step(base: float | None, damping: float):
    """A round with what every vertex gets in any case; None only sends."""

    def step(key, left, right):
        b = blocks.Block(key, left, right, np.float64)
        out_degree = np.bincount(b.src, minlength=blocks.SIZE) if b.arcs else np.zeros(blocks.SIZE, np.int64)
        rank, got = np.zeros(blocks.SIZE), np.zeros(blocks.SIZE)
        rank[b.offs] = b.vals
        new, near = b.vals, b.dst & blocks.MASK if b.arcs else None
        if base is not None:
            for _, offs, vals in b.sent:
                got[offs] += vals
            for to, i, j in b.segments if b.arcs else ():
                if to == b.id:
                    got += np.bincount(near[i:j], rank[b.src[i:j]] / out_degree[b.src[i:j]], blocks.SIZE)
            new = base + damping * got[b.offs]
        change = np.abs(new - b.vals)
        out = [(b.id, -1, b.offs, new, float(change.sum()), float(change.max(initial=0.0)), float(new[out_degree[b.offs] == 0].sum()))]
        if b.arcs:
            share = np.zeros(blocks.SIZE)
            share[b.offs] = new
            share /= np.maximum(out_degree, 1)
            for to, i, j in b.segments:
                if to != b.id:
                    heads, at = np.unique(near[i:j], return_inverse=True)
                    out.append((to, b.id, heads, np.bincount(at, share[b.src[i:j]], len(heads)), 0.0, 0.0, 0.0))
        return blocks.inbox(out)

    return step


@dataclass(frozen=True)
class Solve:
    ranks: DataFrame
    iterations: int
    l1: float
    linf: float
    converged: bool
    #: The open iteration, if it was to be kept.
    state: Rounds | None = None


def spread(arcs: DataFrame) -> DataFrame:
    """Arcs with the share ``w`` of a vertex's rank that each carries; cached once for all rounds."""
    out = degrees(arcs).select(F.col("v").alias("src"), (1.0 / F.col("degree")).alias("w"))
    return fixpoint.cut(arcs.join(out, "src"))


def solve(arcs: DataFrame, n: int, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-10, rule: str = "l1", keep: bool = False, after: Solve | None = None) -> Solve:
    """Power iteration from uniform ranks until the L1 change is below, or with ``rule="linf"`` the largest change at most, the tolerance.

    ``after`` is a kept solve of the same arcs, whose rounds are gone on with: they are those that this one would begin with.
    """
    if not 0.0 <= damping <= 1.0:
        raise ValueError("damping must lie in [0, 1]")
    spark = arcs.sparkSession
    uniform = schema.vertices(spark, n).withColumn("rank", F.lit(1.0 / max(n, 1)))
    if not n:
        return Solve(uniform, 0, 0.0, 0.0, True)
    if after is None:
        state, k, l1, linf = Rounds(arcs, n, damping), 0, float("inf"), float("inf")
        state.start(uniform)
    else:
        state, k, l1, linf = after.state, after.iterations, after.l1, after.linf
    while not (done := l1 < tolerance if rule == "l1" else linf <= tolerance) and k < rounds:
        l1, linf = state.advance()
        k += 1
    if not keep:
        state.close()
    return Solve(state.ranks(), k, l1, linf, done, state if keep else None)


def fixed_rounds(arcs: DataFrame, n: int, rounds: int, damping: float = 0.85) -> DataFrame:
    """(v, rank) after a given number of rounds."""
    return solve(arcs, n, damping, rounds, tolerance=0.0).ranks


def dangling_count(arcs: DataFrame, n: int) -> int:
    return n - arcs.select("src").distinct().count()


def difference(a: DataFrame, b: DataFrame) -> tuple[float, float]:
    """(L1, largest) absolute difference of two rank tables."""
    d = F.abs(F.coalesce(F.col("a.rank"), F.lit(0.0)) - F.coalesce(F.col("b.rank"), F.lit(0.0)))
    row = a.alias("a").join(b.alias("b"), "v", "full").agg(F.sum(d), F.max(d)).first()
    return float(row[0] or 0.0), float(row[1] or 0.0)


def residual(ranks: DataFrame, state: Rounds) -> tuple[float, float]:
    """(L1, largest) change that one more round would make; the state's own ranks are given up."""
    state.start(ranks)
    return state.advance()
