"""Frontier table and recommendation (R2, R3, R10; W1-W3, W12, P9, P10, U2).

These read their summary several times. Over a summary that is still to be
computed from units, pass ``cut_lineage(candidate_summary(...))``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import display
from gradelake.functions.fit import MIB
from gradelake.functions.predicates import ineligibility_reason, is_gate_passing
from gradelake.operators.frontier import frontier
from gradelake.operators.joins import peer_names, size_peers
from gradelake.session import cut_lineage

KEYS = ["run_id", "candidate_id"]

# Fixed values of the offload rules.
PLATEAU = 0.6
COLLAPSE = 0.25


def with_reasons(summary: DataFrame) -> DataFrame:
    """Summary with eligibility and, where not eligible, the reason."""
    counts = F.col("gate_failure_counts")
    return summary.withColumns({
        "blocked": ineligibility_reason(
            F.col("status"), F.col("status_reason"), F.col("mean_score"),
            F.col("gates_passed"), counts,
        ),
        "eligible": is_gate_passing(
            F.col("status"), F.col("mean_score"), F.col("gates_passed")
        ),
    })


def points(judged: DataFrame) -> DataFrame:
    """Competing candidates with their axis values."""
    return judged.filter("eligible").select(
        *KEYS, F.col("mean_score").alias("quality"),
        F.col("measured_peak_mib").alias("vram_mib"),
        F.col("rate_median").alias("tokens_per_second"),
    )


def frontier_table(summary: DataFrame) -> DataFrame:
    """Every candidate as frontier, dominated or excluded, with the reason."""
    judged = with_reasons(summary)
    on_it = frontier(points(judged)).select(*KEYS, F.lit(True).alias("_on"))
    placed = judged.join(on_it, KEYS, "left")
    group = (
        F.when(~F.col("eligible"), "excluded")
        .when(F.col("_on"), "frontier")
        .otherwise("dominated")
    )
    reason = F.when(~F.col("eligible"), F.coalesce(F.col("blocked"), F.lit("not eligible")))
    return placed.select(
        *KEYS, "candidate_seq", "model_name", group.alias("class"), reason.alias("reason"),
        F.col("mean_score").alias("quality"), F.col("measured_peak_mib").alias("vram_mib"),
        F.col("rate_median").alias("tokens_per_second"),
    )


# Why a run has no recommendation.
NO_CANDIDATES = "no candidates were evaluated"
NONE_PASSED = "no candidate passed all gate scorers, so nothing is recommendable on this task"


def check_tolerance(tolerance: float) -> float:
    if not math.isfinite(tolerance) or tolerance < 0 or tolerance >= 1:
        raise ValueError(
            f"quality tolerance must be a fraction in [0, 1), got {tolerance}; "
            "pass 0.02 for a 2% tolerance"
        )
    return float(tolerance)


def quality_threshold(judged: DataFrame, tolerance: float) -> DataFrame:
    """Best eligible candidate and the quality to reach, per run.

    A combinable aggregate; ties go to the first candidate in order.
    """
    best = F.min_by(
        F.struct("candidate_id", "model_name", "mean_score", "measured_peak_mib", "size_bytes"),
        F.struct(-F.col("mean_score"), F.col("candidate_seq")),
    )
    return (
        judged.filter("eligible").groupBy("run_id").agg(best.alias("best"))
        .withColumn("threshold", F.col("best.mean_score") * F.lit(1.0 - tolerance))
    )


def within_tolerance(judged: DataFrame, thresholds: DataFrame) -> DataFrame:
    return judged.filter("eligible").join(thresholds, "run_id").filter(
        F.col("mean_score") >= F.col("threshold")
    )


def footprint_kind(within: DataFrame) -> DataFrame:
    """How the run's picks are ordered: vram, weights or none."""
    measured = F.bool_and(F.col("measured_peak_mib").isNotNull())
    weightless = F.bool_and(F.col("size_bytes") == 0)
    return within.groupBy("run_id").agg(
        F.when(measured, "vram").when(weightless, "none").otherwise("weights").alias("kind")
    )


def footprint_mib(kind: Column, peak: Column, size: Column) -> Column:
    return (
        F.when(kind == "vram", F.coalesce(peak, F.lit(float("inf"))))
        .when(kind == "none", 0.0)
        .otherwise(size / MIB)
    )


def pick(within: DataFrame, kinds: DataFrame) -> DataFrame:
    """Smallest footprint, then quality, rate, name and order; one row per run."""
    size = footprint_mib(F.col("kind"), F.col("measured_peak_mib"), F.col("size_bytes"))
    order = F.struct(
        size, -F.col("mean_score"), -F.coalesce(F.col("rate_median"), F.lit(0.0)),
        F.collate(F.col("model_name"), "UNICODE"), F.col("candidate_seq"),
    )
    chosen = F.struct(
        "candidate_id", "model_name", "mean_score", "rate_median", size.alias("mib")
    )
    return within.join(kinds, "run_id").groupBy("run_id", "kind").agg(
        F.min_by(chosen, order).alias("pick")
    )


def run_decisions(judged: DataFrame, tolerance: float) -> DataFrame:
    """One row per run with an eligible candidate: best, threshold, kind and pick."""
    thresholds = quality_threshold(judged, tolerance)
    within = within_tolerance(judged, thresholds)
    return thresholds.join(pick(within, footprint_kind(within)), "run_id")


def _size_text(kind: Column, mib: Column) -> Column:
    return F.when(
        kind == "vram", F.concat(display.whole(mib), F.lit(" MiB peak memory"))
    ).otherwise(
        F.concat(
            display.whole(mib),
            F.lit(" MiB weights on disk (peak memory was not measured on this run)"),
        )
    )


def pick_reason(tolerance: float) -> Column:
    """One sentence with the numbers behind the pick."""
    kind, best, chosen = F.col("kind"), F.col("best"), F.col("pick")
    quality = display.score(chosen["mean_score"])
    rate = display.rate(F.coalesce(chosen["rate_median"], F.lit(0.0)))
    size = _size_text(kind, chosen["mib"])
    best_mib = footprint_mib(kind, best["measured_peak_mib"], best["size_bytes"])
    api = F.concat(
        chosen["model_name"], F.lit(" has the best measured quality ("), quality, F.lit(") at "),
        rate,
        F.lit(
            " tok/s among gate-passing candidates; this is an API backend run, so the ranking "
            "uses quality and latency only (no local footprint applies)."
        ),
    )
    smallest = F.concat(
        chosen["model_name"], F.lit(" has the best measured quality ("), quality,
        F.lit(") and the smallest footprint ("), size,
        F.lit(") among the candidates within the quality tolerance."),
    )
    trade = F.concat(
        chosen["model_name"], F.lit(" holds quality "), quality,
        F.lit(f", within {tolerance * 100:.0f}% of the best ("),
        display.score(best["mean_score"]), F.lit(" from "), best["model_name"], F.lit("), at "),
        size, F.lit(" versus "), display.whole(best_mib), F.lit(" MiB."),
    )
    return (
        F.when(kind == "none", api)
        .when(chosen["candidate_id"] == best["candidate_id"], smallest)
        .otherwise(trade)
    )


def runner_up_case() -> Column:
    """Which rule keeps a candidate from being the pick."""
    extra = _own_mib() - F.col("pick.mib")
    return (
        F.when(F.col("blocked").isNotNull(), "blocked")
        .when(F.col("mean_score") < F.col("threshold"), "below-tolerance")
        .when(F.col("kind") == "none", "slower")
        .when(extra == 0, "tie-break")
        .otherwise("larger")
    )


def _own_mib() -> Column:
    return footprint_mib(F.col("kind"), F.col("measured_peak_mib"), F.col("size_bytes"))


def runner_up_reason() -> Column:
    best, chosen = F.col("best.mean_score"), F.col("pick")
    drop = (best - F.col("mean_score")) / best * 100
    case = runner_up_case()
    unit = F.when(F.col("kind") == "vram", " MiB more peak memory than ").otherwise(
        " MiB more weights than "
    )
    return (
        F.when(case == "blocked", F.col("blocked"))
        .when(
            case == "below-tolerance",
            F.concat(
                F.lit("quality "), display.score(F.col("mean_score")), F.lit(" is "),
                display.rate(drop), F.lit("% below the best "), display.score(best),
                F.lit(", outside the tolerance"),
            ),
        )
        .when(
            case == "slower",
            F.concat(
                F.lit("same quality band but "),
                display.rate(F.coalesce(F.col("rate_median"), F.lit(0.0))),
                F.lit(" tok/s median versus "),
                display.rate(F.coalesce(chosen["rate_median"], F.lit(0.0))), F.lit(" for "),
                chosen["model_name"],
            ),
        )
        .when(
            case == "tie-break",
            F.concat(
                F.lit("identical footprint to "), chosen["model_name"],
                F.lit("; lost the tie-break on quality, then throughput"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("same quality band but "), display.whole(_own_mib() - chosen["mib"]), unit,
                chosen["model_name"],
            )
        )
    )


def recommend(summary: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Every candidate of every run with its part in the recommendation.

    ``role`` is pick, runner-up, or nearest-miss where a run has no eligible
    candidate. Ordered by run, pick first, then by quality.
    """
    tolerance = check_tolerance(tolerance)
    judged = with_reasons(summary)
    decided = judged.join(run_decisions(judged, tolerance), "run_id", "left")
    picked = F.col("pick.candidate_id") == F.col("candidate_id")
    role = (
        F.when(F.col("pick").isNull(), "nearest-miss")
        .when(picked, "pick")
        .otherwise("runner-up")
    )
    reason = (
        F.when(F.col("pick").isNull(), F.coalesce(F.col("blocked"), F.lit("not eligible")))
        .when(picked, pick_reason(tolerance))
        .otherwise(runner_up_reason())
    )
    return decided.select(
        *KEYS, "candidate_seq", "model_name", role.alias("role"),
        F.when(F.col("pick").isNull(), "none").otherwise("recommended").alias("kind"),
        F.col("kind").alias("footprint_kind"),
        F.when(role == "runner-up", runner_up_case()).alias("runner_up_case"),
        F.col("mean_score").alias("quality"), "threshold",
        F.when(F.col("pick").isNotNull(), _own_mib()).alias("footprint_mib"),
        reason.alias("reason"),
    ).orderBy(
        "run_id", F.col("role") != "pick", quality_rank("quality"), "candidate_seq",
    )


def outcomes(summary: DataFrame, tolerance: float = 0.02, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: run_id, kind, the pick's candidate_id and model_name, reason.

    Where nothing can be recommended the kind is none and the reason says so. ``runs`` adds runs
    that have no candidates.
    """
    pick = F.when(F.col("role") == "pick", F.struct("candidate_id", "model_name", "reason"))
    found = recommend(summary, tolerance).groupBy("run_id").agg(
        F.max(pick).alias("pick"), F.count(F.lit(1)).alias("candidates"))
    if runs is not None:
        found = runs.select("run_id").distinct().join(found, "run_id", "left")
    nothing = F.when(F.col("candidates").isNull(), NO_CANDIDATES).otherwise(NONE_PASSED)
    return found.select(
        "run_id", F.when(F.col("pick").isNull(), "none").otherwise("recommended").alias("kind"),
        "pick.candidate_id", "pick.model_name", F.coalesce("pick.reason", nothing).alias("reason"))


def quality_rank(quality: str) -> Column:
    """Sort key of a mean score, missing as zero.

    The last bits of a mean depend on the order its partitions were summed in, so
    they are rounded off: equal means keep their listing order in every run.
    """
    return F.desc(F.round(F.coalesce(F.col(quality), F.lit(0.0)), 12))


def nearest_misses(summary: DataFrame) -> DataFrame:
    """Candidates by quality, best first, missing as zero, in order on ties (T-3)."""
    return with_reasons(summary).orderBy(
        "run_id", quality_rank("mean_score"), "candidate_seq"
    )


def offload_suspects(candidates: DataFrame) -> DataFrame:
    """Completed candidates that look split between processors, with the reason.

    ``candidates`` carries ``tokens_per_second`` (the median rate). They are read once and
    written to the checkpoint folder, as every side of the bands and the peers' names come from them.
    """
    finished = cut_lineage(candidates.filter(F.col("status") == "completed"))
    plateau = F.coalesce(
        F.col("measured_peak_mib") < F.col("predicted_peak_mib") * PLATEAU, F.lit(False)
    )
    # The candidate's own rate may be the band's best; it is never below its own quarter.
    collapse = F.coalesce(
        (F.col("peer_count") > 0)
        & (F.col("tokens_per_second") < F.col("band_best_rate") * COLLAPSE),
        F.lit(False),
    )
    ruled = cut_lineage(size_peers(finished).withColumn(
        "rule", F.when(plateau, "plateau").when(collapse, "collapse")
    ).filter(F.col("rule").isNotNull()))
    names = peer_names(ruled.filter(F.col("rule") == "collapse"), finished)
    reason = F.when(
        F.col("rule") == "plateau",
        F.concat(
            F.lit("suspected cpu/gpu split: measured peak "),
            display.whole(F.col("measured_peak_mib")), F.lit(" MiB plateaued under 60% of the "
            "predicted "), display.whole(F.col("predicted_peak_mib")),
            F.lit(" MiB while the model still ran"),
        ),
    ).otherwise(
        F.concat(
            F.lit("suspected cpu/gpu split: "), display.rate(F.col("tokens_per_second")),
            F.lit(" tok/s is under 25% of the "), display.rate(F.col("band_best_rate")),
            F.lit(" tok/s that similar-size candidates ("), F.col("peers"), F.lit(") reached"),
        )
    )
    return ruled.join(names, KEYS, "left").withColumn("reason", reason)
