"""Candidate summary: one row per candidate with every aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.operators import aggregates as A

KEYS = A.KEYS


def per_repetition(units: DataFrame) -> DataFrame:
    """Everything that adds up, per candidate and repetition, in one pass."""
    is_done = A.is_done()

    def when_done(c):
        return F.when(is_done, c)

    return units.groupBy(*KEYS, "repetition").agg(
        F.count_if(is_done).alias("completed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("failed", "pending", "skipped")],
        F.sum(when_done(F.col("score"))).alias("score_sum"),
        F.count_if(is_done & F.col("pass")).alias("passes"),
        F.sum(when_done(F.coalesce(F.col("wall_ms"), F.lit(0.0)))).alias("wall"),
        F.min(when_done(F.col("ttft_ms"))).alias("ttft_min"),
        F.max(when_done(F.col("ttft_ms"))).alias("ttft_max"),
        F.min(when_done(F.col("tokens_per_second"))).alias("rate_min"),
        F.max(when_done(F.col("tokens_per_second"))).alias("rate_max"),
        F.count_if(is_done & F.col("failed_gate").isNotNull()).alias("gate_failures"),
    )


def additive(units: DataFrame) -> DataFrame:
    """A1, A2, A3, A5, A9 and the extremes of A4, rolled up from repetitions."""
    repetition_mean = F.try_divide(F.col("score_sum"), F.col("completed"))
    n = F.sum("completed")
    rolled = per_repetition(units).groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("completed", "failed", "pending", "skipped")],
        F.try_divide(F.sum("score_sum"), n).alias("mean_score"),
        F.try_divide(F.sum("passes").cast("double"), n).alias("pass_rate"),
        F.min(repetition_mean).alias("score_min"),
        F.max(repetition_mean).alias("score_max"),
        F.coalesce(F.sum("wall"), F.lit(0.0)).alias("wall_ms_total"),
        F.min("ttft_min").alias("ttft_min"), F.max("ttft_max").alias("ttft_max"),
        F.min("rate_min").alias("rate_min"), F.max("rate_max").alias("rate_max"),
        F.when(n > 0, F.sum("gate_failures") == 0).alias("gates_passed"),
    )
    return rolled


def outputs_view(units: DataFrame) -> DataFrame:
    """A6 and A7 in the one pass that reads outputs."""
    return A.example_agreement(units).groupBy(*KEYS).agg(
        F.bool_and(F.when(F.col("n") > 1, F.col("same"))).alias("outputs_deterministic"),
        F.sum("truncated_empty").alias("truncated_empty_count"),
    )


def candidate_summary(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per candidate, whether or not it has units.

    ``units(run_id, candidate_id, unit_id, example_id, repetition, status, score,
    pass, failed_gate, output, done_reason, ttft_ms, tokens_per_second,
    wall_ms)``; ``candidates(run_id, candidate_id, candidate_seq, model_name,
    size_bytes, status, status_reason, predicted_peak_mib, measured_peak_mib,
    offload_suspect_reason, ...)``.
    """
    joined = (
        candidates.join(additive(units), KEYS, "left")
        .join(A.latency_medians(units), KEYS, "left")
        .join(outputs_view(units), KEYS, "left")
        .join(A.gate_failure_counts(units), KEYS, "left")
    )
    zero = {
        c: F.coalesce(F.col(c), F.lit(0))
        for c in ("completed", "failed", "pending", "skipped", "truncated_empty_count")
    }
    return joined.withColumns({
        **zero,
        "wall_ms_total": F.coalesce(F.col("wall_ms_total"), F.lit(0.0)),
        "memory_delta_percent": A.memory_delta_percent(
            F.col("measured_peak_mib"), F.col("predicted_peak_mib")
        ),
    })
