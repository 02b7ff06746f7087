"""When to fold the overlay into a fresh base."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGE_ARCS = 100_000_000


@dataclass(frozen=True)
class Policy:
    storage: float = 1.25
    latency: float = 1.25


def scale_aware(arcs: int, latency: float = 1.25) -> Policy:
    """A wider storage bound for graphs of 100 million arcs or more, where rebuilding is dear."""
    return Policy(1.50 if arcs >= LARGE_ARCS else 1.25, latency)


@dataclass(frozen=True)
class Signal:
    storage_ratio: float
    latency_ratio: float
    storage_exceeded: bool
    latency_exceeded: bool

    @property
    def should_consolidate(self) -> bool:
        return self.storage_exceeded or self.latency_exceeded


def evaluate(storage: float, base_storage: float, latency: float, base_latency: float, policy: Policy = Policy()) -> Signal:
    """Ratios to the consolidated state, 1 where that is zero, against the policy's bounds, which count as exceeded when met."""
    s = storage / base_storage if base_storage else 1.0
    t = latency / base_latency if base_latency > 0 else 1.0
    return Signal(s, t, s >= policy.storage, t >= policy.latency)


def evaluate_columns(df: DataFrame) -> DataFrame:
    """:func:`evaluate` with :func:`scale_aware` over rows (arcs, storage, base_storage, latency, base_latency)."""
    s = F.when(F.col("base_storage") == 0, 1.0).otherwise(F.col("storage") / F.col("base_storage"))
    t = F.when(F.col("base_latency") <= 0, 1.0).otherwise(F.col("latency") / F.col("base_latency"))
    bound = F.when(F.col("arcs") >= LARGE_ARCS, 1.50).otherwise(1.25)
    df = df.withColumns({"storage_ratio": s, "latency_ratio": t})
    df = df.withColumns({"storage_exceeded": F.col("storage_ratio") >= bound, "latency_exceeded": F.col("latency_ratio") >= 1.25})
    return df.withColumn("consolidate", F.col("storage_exceeded") | F.col("latency_exceeded"))


@dataclass
class Controller:
    """Storage breaches act at once; latency must breach for some epochs in a row, with real growth, outside the cooldown."""

    cooldown: int = 10
    breaches: int = 5
    growth: float = 1.10
    streak: int = 0
    last: int = 0

    def observe(self, signal: Signal, epoch: int) -> bool:
        cooling = bool(self.last) and epoch < self.last + self.cooldown
        counts = not signal.storage_exceeded and not cooling and signal.latency_exceeded and signal.storage_ratio >= self.growth
        self.streak = self.streak + 1 if counts else 0
        return signal.storage_exceeded or self.streak >= self.breaches

    def mark(self, epoch: int) -> None:
        self.last, self.streak = epoch, 0
