"""Aggregates over unit results, outputs and telemetry.

Groups are keyed by (run_id, candidate_id). Everything combines on the map
side; no aggregate collects the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.predicates import is_truncated_empty
from gradelake.operators.scale import exact_medians, group_index

KEYS = ["run_id", "candidate_id"]


def is_done() -> Column:
    """Completed and scored; every quality figure is over these units."""
    return (F.col("status") == "completed") & F.col("score").isNotNull()


def done(units: DataFrame) -> DataFrame:
    return units.filter(is_done())


def status_counts(units: DataFrame) -> DataFrame:
    """Units per status; completed counts only units that have a score (A1)."""
    return units.groupBy(*KEYS).agg(
        F.count_if(is_done()).alias("completed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("failed", "pending", "skipped")],
    )


def quality(units: DataFrame) -> DataFrame:
    """Mean score and pass rate; null without completed units (A2)."""
    return units.groupBy(*KEYS).agg(
        F.avg(F.when(is_done(), F.col("score"))).alias("mean_score"),
        F.avg(F.when(is_done(), F.coalesce(F.col("pass"), F.lit(False)).cast("double"))).alias(
            "pass_rate"
        ),
    )


def repetition_means(units: DataFrame) -> DataFrame:
    """Mean score of each repetition pass."""
    return done(units).groupBy(*KEYS, "repetition").agg(F.avg("score").alias("mean_score"))


def repetition_spread(units: DataFrame) -> DataFrame:
    """Lowest and highest of the per-repetition means (A3)."""
    return repetition_means(units).groupBy(*KEYS).agg(
        F.min("mean_score").alias("score_min"), F.max("mean_score").alias("score_max")
    )


def latency_stats(units: DataFrame) -> DataFrame:
    """Exact median, min and max of first-token time and rate (A4)."""
    completed = done(units)
    extremes = completed.groupBy(*KEYS).agg(
        F.min("ttft_ms").alias("ttft_min"), F.max("ttft_ms").alias("ttft_max"),
        F.min("tokens_per_second").alias("rate_min"), F.max("tokens_per_second").alias("rate_max"),
    )
    medians = latency_medians(units)
    return extremes.join(medians, KEYS, "left")


def latency_medians(units: DataFrame) -> DataFrame:
    medians = exact_medians(done(units), KEYS, ["ttft_ms", "tokens_per_second"], ["unit_id"])
    return medians.withColumnsRenamed(
        {"ttft_ms_median": "ttft_median", "tokens_per_second_median": "rate_median"}
    )


def wall_total(units: DataFrame) -> DataFrame:
    """Total wall time of completed units, missing as zero (A5)."""
    spent = F.when(is_done(), F.coalesce(F.col("wall_ms"), F.lit(0.0))).otherwise(0.0)
    return units.groupBy(*KEYS).agg(F.sum(spent).alias("wall_ms_total"))


def _fingerprints() -> list[Column]:
    """128 bits of an output text, as numbers, so that min and max stay hash based."""
    text = F.coalesce(F.col("output"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("second seed"), text)]


def example_agreement(units: DataFrame) -> DataFrame:
    """Per example: completed repetitions, and whether all outputs are the same.

    Whole outputs are hashed before the shuffle: only numbers travel.
    """
    first, second = _fingerprints()
    truncated = is_truncated_empty(F.col("done_reason"), F.col("output"))
    return (
        done(units)
        .select(
            *KEYS, "example_id", first.alias("h1"), second.alias("h2"),
            F.coalesce(truncated, F.lit(False)).alias("truncated"),
        )
        .groupBy(*KEYS, "example_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            ((F.min("h1") == F.max("h1")) & (F.min("h2") == F.max("h2"))).alias("same"),
            F.count_if("truncated").alias("truncated_empty"),
        )
    )


def determinism(units: DataFrame) -> DataFrame:
    """Whether repeated examples always gave the same output; null when none repeat."""
    return example_agreement(units).groupBy(*KEYS).agg(
        F.bool_and(F.when(F.col("n") > 1, F.col("same"))).alias("outputs_deterministic")
    )


def truncated_empty(units: DataFrame) -> DataFrame:
    """Completed units cut off before any visible output."""
    cut = is_done() & is_truncated_empty(F.col("done_reason"), F.col("output"))
    return units.groupBy(*KEYS).agg(F.count_if(cut).alias("truncated_empty_count"))


def gate_failures(units: DataFrame) -> DataFrame:
    """Completed units per failing gate and the first of them, one row each."""
    failing = done(units).filter(F.col("failed_gate").isNotNull())
    return failing.groupBy(*KEYS, F.col("failed_gate").alias("gate")).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.min(F.struct("example_id", "repetition", "unit_id")).alias("first_unit"),
    )


def gate_failure_counts(units: DataFrame) -> DataFrame:
    """The same as a map per candidate, one entry per declared gate, in order of first failure."""
    entries = F.array_sort(F.collect_list(F.struct("first_unit", "gate", "n_units")))
    return gate_failures(units).groupBy(*KEYS).agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["gate"], e["n_units"]))).alias(
            "gate_failure_counts")
    )


def gates_passed(units: DataFrame) -> DataFrame:
    """True, false, or null without completed units."""
    return units.groupBy(*KEYS).agg(
        F.bool_and(F.when(is_done(), F.col("failed_gate").isNull())).alias("gates_passed")
    )


def memory_delta_percent(measured: Column, predicted: Column) -> Column:
    """Measured against predicted peak, percent; null without either or on zero (A10)."""
    return F.try_divide(measured - predicted, predicted) * 100


def token_spend(units: DataFrame) -> DataFrame:
    """Tokens of all units that have a generation."""
    return units.filter(F.col("output").isNotNull()).groupBy("run_id").agg(
        F.sum(F.coalesce("prompt_token_count", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("output_token_count", F.lit(0))).alias("output_tokens"),
        F.count(F.lit(1)).alias("generations"),
    )


def peak_memory(samples: DataFrame) -> DataFrame:
    """Highest raw sample per candidate."""
    return samples.groupBy("candidate_id").agg(
        F.max("used_mib").alias("peak_mib"), F.count("used_mib").alias("n_samples")
    )


def generation_timing(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """First-token time, rate, wall time and count per generation.

    ``tokens(generation_id, at)`` and ``spans(generation_id, started_at,
    finished_at)``; times are TIMESTAMP. A generation without tokens is kept.
    """
    per_generation = tokens.groupBy("generation_id").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.count(F.lit(1)).alias("n"),
    )
    joined = spans.join(per_generation, "generation_id", "left")
    return joined.select("generation_id", *timing_columns())


def millis(later: Column, earlier: Column) -> Column:
    """Milliseconds between two timestamps."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000.0


def token_rate(n: Column, span_ms: Column) -> Column:
    """Tokens per second after the first; null below two tokens or without a span."""
    return F.when((n >= 2) & (span_ms > 0), (n - 1) * 1000.0 / span_ms)


def timing_columns() -> list[Column]:
    n = F.coalesce(F.col("n"), F.lit(0))
    span = millis(F.col("last_at"), F.col("first_at"))
    return [
        millis(F.col("first_at"), F.col("started_at")).alias("ttft_ms"),
        token_rate(n, span).alias("tokens_per_second"),
        millis(F.col("finished_at"), F.col("started_at")).alias("wall_ms"),
        n.alias("token_count"),
    ]


#: Token texts joined at a time when an output is put together.
PIECE = 4096


def _joined_in_order(order: str, text: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(pieces, lambda p: p[text]), "")


def assemble_output(tokens: DataFrame) -> DataFrame:
    """Output text of each generation, in token order.

    Joined in two steps, so no task collects more than ``PIECE`` tokens of a
    long generation at a time, and the second step moves joined pieces only.
    """
    pieces = (
        tokens.withColumn("piece", F.floor(F.col("seq") / PIECE))
        .groupBy("generation_id", "piece")
        .agg(_joined_in_order("seq", "text").alias("text"))
    )
    return pieces.groupBy("generation_id").agg(_joined_in_order("piece", "text").alias("output"))


def process_memory(rows: DataFrame) -> DataFrame:
    """Resident memory per tick, KiB summed then rounded to MiB."""
    return rows.groupBy("tick").agg(
        F.floor(F.sum("rss_kib") / 1024.0 + 0.5).cast("bigint").alias("used_mib")
    )


#: Problems per row of a roll-up.
PROBLEM_PAGE = 1000


def problem_rollup(problems: DataFrame) -> DataFrame:
    """All problems of each pack with their number.

    ``problems(pack, seq, message)``. The list comes in pages of at most
    ``PROBLEM_PAGE`` messages, whole and in order, so that a pack with millions
    of bad rows is not one cell.
    """
    numbered = group_index(
        problems, ["pack"], [F.col("seq"), F.col("message")],
        F.floor(F.col("seq") / 65536), "i", "problem_count",
    )
    return (
        numbered.groupBy(
            "pack", F.floor(F.col("i") / PROBLEM_PAGE).alias("page"), "problem_count"
        )
        .agg(F.array_sort(F.collect_list(F.struct("i", "message"))).alias("found"))
        .select(
            "pack", "page", "problem_count",
            F.transform("found", lambda p: p["message"]).alias("problems"),
        )
    )


def rescore_counts(diff: DataFrame) -> DataFrame:
    """Re-scored units and how many changed, per run."""
    return diff.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("changed").alias("changed")
    )


# Fixed values of the time estimate.
ASSUMED_RATE = 20.0
SECONDS_PER_UNIT = 2
SECONDS_PER_CANDIDATE = 30


def estimate_seconds(units: Column, max_tokens: Column, rate: Column | None = None) -> Column:
    """Seconds for one candidate's units, whole."""
    per_second = F.lit(ASSUMED_RATE) if rate is None else F.coalesce(rate, F.lit(ASSUMED_RATE))
    total = units * (max_tokens / per_second + SECONDS_PER_UNIT) + SECONDS_PER_CANDIDATE
    return F.floor(total + 0.5).cast("bigint")


def plan_estimate(plan: DataFrame) -> DataFrame:
    """Total seconds per run over ``plan(run_id, units, max_tokens)``."""
    return plan.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum(estimate_seconds(F.col("units"), F.col("max_tokens"))).alias("total_seconds"),
    )
