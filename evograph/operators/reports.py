"""Summaries of measured runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_traces(runs: DataFrame) -> DataFrame:
    """A row per batch from runs that hold arrays (dataset, batch_size, repetition, policy, batch_us, oracle_batch_us, explicit_full, oracle_full, internal_fallback)."""
    arrays = ["batch_us", "oracle_batch_us", "explicit_full", "oracle_full", "internal_fallback"]
    rest = [c for c in runs.columns if c not in arrays]
    return runs.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("batch", "e")).select(*rest, "batch", *(F.col(f"e.{a}").alias(a) for a in arrays))


def regret_summary(rows: DataFrame, keys: tuple[str, ...] = ("dataset", "batch_size", "policy")) -> DataFrame:
    """Regret max(0, (cost - best) / best) by regime: samples, mean, median, p95, p99, max (interpolated), and the shares of wrong, full and fallen-back batches.

    Rows hold batch_us, oracle_batch_us, explicit_full, oracle_full, internal_fallback.
    """
    regret = F.greatest(F.lit(0.0), (F.col("batch_us") - F.col("oracle_batch_us")) / F.col("oracle_batch_us"))
    rows = rows.withColumn("_r", regret)
    at = lambda q: F.percentile("_r", F.lit(q))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_r").alias("mean_regret"), at(0.5).alias("median_regret"), at(0.95).alias("p95_regret"), at(0.99).alias("p99_regret"), F.max("_r").alias("max_regret"),
        share(F.col("explicit_full") != F.col("oracle_full")).alias("wrong_arm_rate"), share(F.col("explicit_full")).alias("full_choice_fraction"), share(F.col("internal_fallback")).alias("internal_fallback_fraction"),
    )


def regret_rollup(summary: DataFrame) -> DataFrame:
    """Across regimes, by policy: mean of means, worst mean, worst p95, largest."""
    return summary.groupBy("policy").agg(F.count(F.lit(1)).alias("regimes"), F.avg("mean_regret").alias("equal_regime_mean"), F.max("mean_regret").alias("worst_mean"), F.max("p95_regret").alias("worst_p95"), F.max("max_regret").alias("max_regret"))


def crossover(rows: DataFrame) -> DataFrame:
    """(dataset, algorithm, update_fraction, runs, medians, nearest-rank p95 of both arms, median speedup, all_correct) of repeated measurements."""
    nearest = lambda c: F.expr(f"percentile_disc(0.95) within group (order by {c})")
    return rows.groupBy("dataset", "algorithm", "update_fraction").agg(
        F.count(F.lit(1)).alias("runs"), F.median("incremental_ns").alias("incremental_median_ns"), F.median("full_recompute_ns").alias("full_median_ns"),
        nearest("incremental_ns").alias("incremental_p95_ns"), nearest("full_recompute_ns").alias("full_p95_ns"), F.median("speedup").alias("median_speedup"), F.bool_and("correct").alias("all_correct"),
    )


def first_crossover(summary: DataFrame) -> DataFrame:
    """(dataset, algorithm, crossover_fraction): the first fraction at which recomputation is as fast; null if none."""
    return summary.groupBy("dataset", "algorithm").agg(F.min(F.when(F.col("median_speedup") <= 1, F.col("update_fraction"))).alias("crossover_fraction"))


def fallback_accounting(rows: DataFrame) -> DataFrame:
    """Work done twice, by mode: rows (mode, batch_us, explicit_full, internal_fallback, wasted_us)."""
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("batches"), F.count_if("internal_fallback").alias("fallbacks"), F.count_if("explicit_full").alias("explicit_full"), F.sum(F.when(F.col("internal_fallback"), F.col("wasted_us")).otherwise(0.0)).alias("double_work_us"), F.sum("batch_us").alias("total_us"))


def avoided_fallbacks(rows: DataFrame) -> DataFrame:
    """One row: batches at which the repair alone fell back, how many of them the selector ran in full at once, and the work that saved."""
    alone = rows.where("mode = 'fallback_only'").select("batch", F.col("internal_fallback").alias("fell"), F.col("wasted_us").alias("waste"))
    chosen = rows.where("mode = 'selector_plus_fallback'").select("batch", "explicit_full")
    hit = F.col("fell") & F.col("explicit_full")
    return alone.join(chosen, "batch").agg(F.count_if("fell").alias("fallbacks"), F.count_if(hit).alias("avoided"), F.sum(F.when(hit, F.col("waste")).otherwise(0.0)).alias("avoided_us"))


def ablation_summary(summary: DataFrame) -> DataFrame:
    return regret_rollup(summary).orderBy("equal_regime_mean")


def experiment_matrix(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of a few short axes, given in code."""
    rows = reduce(lambda got, axis: [(*r, v) for r in got for v in axis], axes.values(), [()])
    return spark.createDataFrame(rows, list(axes))


def variant_ratios(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(metric, base, other, ratio): medians of two variants; rows (variant, metric, value)."""
    med = rows.groupBy("metric").pivot("variant", [base, other]).agg(F.median("value"))
    return med.select("metric", F.col(base).alias("base"), F.col(other).alias("other"), (F.col(other) / F.nullif(F.col(base), F.lit(0.0))).alias("ratio"))
