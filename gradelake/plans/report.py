"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions import display
from gradelake.functions.predicates import flags
from gradelake.operators import scoring
from gradelake.operators.aggregates import rescore_counts
from gradelake.operators.joins import rescore_diff
from gradelake.operators.scale import lookup_join
from gradelake.plans.decide import check_tolerance, frontier_table, outcomes, recommend
from gradelake.plans.summary import candidate_summary
from gradelake.session import cut_lineage

_FLAG_COLUMNS = (
    "status", "status_reason", "gates_passed", "gate_failure_counts", "truncated_empty_count",
    "completed", "offload_suspect_reason", "outputs_deterministic",
)


def flagged(summary: DataFrame) -> DataFrame:
    """Summary with its report flags."""
    return summary.withColumn("flags", flags({c: F.col(c) for c in _FLAG_COLUMNS}))


def comparison(summary: DataFrame) -> DataFrame:
    """One display row per candidate."""
    local = F.col("fit_verdict") != "not-applicable"
    peak = display.whole(F.col("measured_peak_mib"))
    delta = F.col("memory_delta_percent")
    memory = (
        F.when(~local, "n/a")
        .when(F.col("measured_peak_mib").isNull(), "n/m")
        .when(delta.isNull(), peak)
        .otherwise(F.concat(peak, F.lit(" ("), display.signed_percent(delta), F.lit("%)")))
    )
    dash = F.lit("-")
    return flagged(summary).select(
        "run_id", "candidate_id", "candidate_seq", "model_name",
        F.when(local, F.coalesce("quantization", F.lit("?"))).otherwise(dash).alias(
            "quantization"
        ),
        display.with_spread(
            F.col("mean_score"), F.col("score_min"), F.col("score_max"), display.score
        ).alias("quality"),
        F.coalesce(display.rate(F.col("pass_rate") * 100), dash).alias("pass_percent"),
        F.coalesce(display.whole(F.col("ttft_median")), dash).alias("ttft_ms"),
        F.coalesce(display.rate(F.col("rate_median")), dash).alias("tokens_per_second"),
        memory.alias("peak_mib"),
        F.array_join(F.transform("flags", lambda f: f["token"]), ",").alias("flags"),
    ).orderBy("run_id", "candidate_seq")


def flag_legend(summary: DataFrame) -> DataFrame:
    """One row per flag with its detail, in report order."""
    return flagged(summary).select(
        "run_id", "candidate_seq", "model_name", F.posexplode("flags").alias("place", "f")
    ).select("run_id", "candidate_seq", "model_name", "place", "f.token", "f.detail")


def report(
    units: DataFrame, candidates: DataFrame, tolerance: float = 0.02,
    notes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All report tables over one summary.

    The summary has one row per candidate, however many units there are. It is
    written once to the checkpoint folder, so that neither the tables nor a lost
    executor make Spark go through the units again.
    """
    check_tolerance(tolerance)
    summary = cut_lineage(candidate_summary(units, candidates))
    tables = {
        "summary": summary,
        "frontier": frontier_table(summary),
        "recommendation": recommend(summary, tolerance),
        "outcomes": outcomes(summary, tolerance),
        "comparison": comparison(summary),
        "flags": flag_legend(summary),
    }
    if notes is not None:
        tables["notes"] = notes
    return tables


def rescored_units(
    units: DataFrame, examples: DataFrame, packs: DataFrame, matching: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Units with fresh scores where their pack still matches, and a note per run.

    ``units`` carry ``(run_id, unit_id, pack, example_id, status, output, score,
    pass, failed_gate, details STRING)``; ``matching(run_id, matches)`` says
    whether the pack is what the run was planned from. Others keep what is stored.
    """
    prepared, names, schemas = scoring.bind(packs)
    known = examples.select("pack", "example_id", "expected").withColumn("_known", F.lit(True))
    joined = lookup_join(units, matching, ["run_id"], ["unit_id"])
    joined = lookup_join(joined, known, ["pack", "example_id"], ["unit_id"])
    joined = lookup_join(joined, prepared, ["pack"], ["unit_id"])
    ready = (
        F.coalesce(F.col("matches"), F.lit(False))
        & (F.col("status") == "completed")
        & F.col("output").isNotNull() & F.col("score").isNotNull()
        & F.coalesce(F.col("_known"), F.lit(False))
    )
    stored = ("score", "pass", "failed_gate", "details")
    asked = (
        joined.withColumn("ready", ready)
        .withColumn("failure_reason", F.when(~F.col("ready"), "kept as stored"))
        .withColumnsRenamed({c: f"stored_{c}" for c in stored})
    )
    fresh = scoring.score_rows(asked, names, schemas).withColumn("details", F.to_json("details"))
    same = F.lit(True)
    for c in ("score", "pass", "details"):
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    use = F.col("ready") & ~same
    out = fresh.withColumn("changed", use).withColumns({
        c: F.when(F.col("changed"), F.col(c)).otherwise(F.col(f"stored_{c}")) for c in stored
    })
    rescored = out.select(*units.columns, "ready", "changed")
    tally = rescored.groupBy("run_id").agg(
        F.count_if("ready").alias("checked"), F.count_if("changed").alias("changed")
    )
    text = F.concat(
        F.lit("re-scored from raw outputs with the current scorers: "),
        F.col("changed").cast("string"), F.lit(" of "), F.col("checked").cast("string"),
        F.lit(" scores changed from the stored values"),
    )
    drifted = "stored scores shown as recorded: the task pack changed since this run"
    noted = tally.join(matching, "run_id", "left").select(
        "run_id", "checked", "changed",
        F.when(~F.coalesce(F.col("matches"), F.lit(False)), drifted)
        .when(F.col("changed") > 0, text)
        .alias("note"),
    )
    return rescored, noted


__all__ = [
    "comparison", "flag_legend", "flagged", "report", "rescore_counts", "rescore_diff",
    "rescored_units",
]
