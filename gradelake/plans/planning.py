"""Planning, resuming and ordering (P2, P3, P6, T-*, W6, W9, R9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import display
from gradelake.functions.fit import MIB
from gradelake.operators.aggregates import estimate_seconds
from gradelake.operators.joins import assess_fit
from gradelake.operators.scale import group_index
from gradelake.operators.sets import merge_candidates


def limit_examples(examples: DataFrame, n: int) -> DataFrame:
    """First ``n`` examples of each pack by id (P2). The limit is the feature."""
    if n < 1:
        raise ValueError("the example limit must be at least 1")
    place = F.row_number().over(Window.partitionBy("pack").orderBy("example_id"))
    return examples.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """Newest runs first (T-2)."""
    return runs.orderBy(F.desc("created_at_ms"), F.desc("run_seq")).limit(n)


def pick_run(runs: DataFrame, wanted: str | None = None) -> DataFrame:
    """The newest run, or the newest whose id is or starts with ``wanted``."""
    if wanted is not None:
        runs = runs.filter(F.col("run_id").startswith(wanted))
    return recent_runs(runs, 1)


def plan_filter(assessed: DataFrame, force: bool = False) -> DataFrame:
    """Flag and reason for candidates predicted not to fit; unknown ones run."""
    skip = (F.col("fit.verdict") == "does-not-fit") & F.lit(not force)
    reason = F.concat(F.col("fit.reason"), F.lit("; rerun with --force to attempt it anyway"))
    return assessed.withColumns({"included": ~skip, "skip_reason": F.when(skip, reason)})


def order_plan(plan: DataFrame) -> DataFrame:
    """Largest first, then in listing order (T-1)."""
    return plan.orderBy(F.desc("size_bytes"), "candidate_seq")


def order_units(units: DataFrame) -> DataFrame:
    """Units by candidate, example and repetition (T-5)."""
    return units.orderBy("candidate_id", "example_id", "repetition")


def newest_resumable(runs: DataFrame, units: DataFrame) -> DataFrame:
    """Newest run with a pending unit."""
    open_runs = units.filter(F.col("status") == "pending").select("run_id").distinct()
    newest = F.max_by("run_id", F.struct("created_at_ms", "run_seq"))
    return runs.join(open_runs, "run_id", "left_semi").agg(newest.alias("run_id")).filter(
        F.col("run_id").isNotNull()
    )


def remaining_time(plan: DataFrame) -> DataFrame:
    """Seconds left as seen at the start of each candidate.

    ``plan(run_id, candidate_seq, units, max_tokens, rate)`` in execution order;
    ``rate`` is what the candidate itself measures, so it counts from the next
    candidate on. The first measured rate of a run stays in use.
    """
    first = plan.filter(F.col("rate").isNotNull()).groupBy("run_id").agg(
        F.min("candidate_seq").alias("_seq"), F.min_by("rate", "candidate_seq").alias("_rate")
    )
    placed = group_index(
        plan, ["run_id"], [F.col("candidate_seq")], F.floor(F.col("candidate_seq") / 65536),
        "position", "candidates",
    )
    known = F.when(F.col("candidate_seq") > F.col("_seq"), F.col("_rate"))
    each = estimate_seconds(F.col("units"), F.col("max_tokens"), F.col("rate_in_use"))
    left = F.col("candidates") - F.col("position")
    return (
        placed.join(first, "run_id", "left")
        .withColumn("rate_in_use", known)
        .withColumn("seconds_left", each * left)
        .drop("_seq", "_rate")
    )


def model_listing(
    explicit: DataFrame, local: DataFrame, info: DataFrame, context: Column, free_mib: Column
) -> DataFrame:
    """Models with fit, or the reason they are excluded."""
    merged = merge_candidates(explicit, local).withColumnRenamed("name", "model_name")
    listed = assess_fit(merged, info, context, free_mib)
    remote = F.col("remote")
    return listed.select(
        "model_name", F.coalesce("quantization", F.lit("?")).alias("quantization"),
        F.coalesce("parameter_size", F.lit("?")).alias("parameter_size"),
        (F.col("size_bytes") / MIB).alias("weights_mib"),
        F.when(~remote, F.col("fit.predicted_peak_mib")).alias("predicted_peak_mib"),
        F.when(~remote, F.col("fit.verdict")).alias("verdict"),
        F.when(remote, F.col("excluded_reason"))
        .when(F.col("fit.verdict") != "fits", F.col("fit.reason"))
        .alias("note"),
        F.concat(display.whole(F.col("size_bytes") / MIB), F.lit(" MiB")).alias("weights_text"),
    )
