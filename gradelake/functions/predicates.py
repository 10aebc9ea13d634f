"""Row predicates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.text import is_blank, sanitize_path

# Messages that look like running out of memory.
OOM_PATTERN = (
    r"(?i)out of memory|\boom\b|cuda|vram|unable to allocate|requires more (system )?memory"
    r"|resource limitations|failed to load|crashed mid-generation|ended without a done line"
)
# The backends a version string can name, by prefix.
BACKEND_PREFIXES = ("anthropic", "rapid-mlx")
DEFAULT_BACKEND = "ollama"
TRANSPORT_MARKER = "cannot reach Ollama"

INTERRUPTED = "interrupted before finishing; resume will complete its pending units"


def render_prompt(template: Column, text: Column) -> Column:
    """Every placeholder replaced by the input, literally."""
    return F.replace(template, F.lit("{{input}}"), text)


def is_oom_suspect(message: Column) -> Column:
    return message.rlike(OOM_PATTERN)


def is_transport_error(message: Column) -> Column:
    return message.contains(TRANSPORT_MARKER)


def is_truncated_empty(done_reason: Column, output: Column) -> Column:
    """The token budget was used up without visible output."""
    return (done_reason == "length") & is_blank(F.coalesce(output, F.lit("")))


def gate_list(counts: Column) -> Column:
    """``name (n units), ...`` of a ``map<gate, count>``."""
    def one(entry: Column) -> Column:
        unit = F.when(entry["value"] == 1, " unit)").otherwise(" units)")
        return F.concat(entry["key"], F.lit(" ("), entry["value"].cast("string"), unit)

    return F.array_join(F.transform(F.map_entries(counts), one), ", ")


def ineligibility_reason(
    status: Column, status_reason: Column, mean_score: Column,
    gates_passed: Column, gate_counts: Column,
) -> Column:
    """Why a candidate cannot compete, first rule wins; null when it can."""
    gates = F.coalesce(gate_list(gate_counts), F.lit(""))
    return (
        F.when(
            status == "oom",
            F.concat(F.lit("did not run: "), F.coalesce(status_reason, F.lit("out of memory"))),
        )
        .when(status == "running", INTERRUPTED)
        .when(
            status != "completed",
            F.concat(
                F.lit("did not complete: "),
                F.coalesce(status_reason, F.lit("no reason recorded")),
            ),
        )
        .when(mean_score.isNull(), "no completed generations to score")
        .when(
            ~F.coalesce(gates_passed, F.lit(False)),
            F.concat(
                F.lit("failed gate scorers: "),
                F.when(gates == "", "gate outcomes unavailable").otherwise(gates),
            ),
        )
    )


def is_gate_passing(status: Column, mean_score: Column, gates_passed: Column) -> Column:
    """Completed, scored, and every gate passed (P10)."""
    return (
        (status == "completed") & F.coalesce(gates_passed, F.lit(False)) & mean_score.isNotNull()
    )


def flags(agg: dict[str, Column]) -> Column:
    """Report flags in their fixed order, ``array<struct<token, detail>>``."""
    def flag(when: Column, token: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(token).alias("token"), detail.alias("detail")))

    reason = agg["status_reason"]
    found = F.array(
        flag(agg["status"] == "oom", "oom", F.coalesce(reason, F.lit("out of memory"))),
        flag(agg["status"] == "failed", "failed", F.coalesce(reason, F.lit("no reason recorded"))),
        flag(agg["status"] == "running", "incomplete", F.lit(INTERRUPTED)),
        flag(
            ~agg["gates_passed"], "gates!",
            F.concat(
                F.lit("failed gate scorers: "),
                F.coalesce(gate_list(agg["gate_failure_counts"]), F.lit("")),
            ),
        ),
        flag(
            agg["truncated_empty_count"] > 0, "trunc!",
            F.concat(
                agg["truncated_empty_count"].cast("string"), F.lit(" of "),
                agg["completed"].cast("string"),
                F.lit(
                    " completed units hit the max_tokens budget before emitting any visible "
                    "output, so their scores measure truncation, not task quality; "
                    "raise generation.max_tokens in task.yaml"
                ),
            ),
        ),
        flag(
            agg["offload_suspect_reason"].isNotNull(), "offload?", agg["offload_suspect_reason"]
        ),
        flag(
            ~agg["outputs_deterministic"], "nondet",
            F.lit(
                "outputs differ across repetitions; the backend did not produce repeatable "
                "output for identical requests"
            ),
        ),
    )
    return F.filter(found, lambda f: f.isNotNull())


def backend_kind(version: Column) -> Column:
    """Backend named by a version string."""
    kind = F.when(version.startswith(BACKEND_PREFIXES[0]), BACKEND_PREFIXES[0])
    for prefix in BACKEND_PREFIXES[1:]:
        kind = kind.when(version.startswith(prefix), prefix)
    return kind.otherwise(DEFAULT_BACKEND)


def provenance_label(provenance: Column) -> Column:
    """Label of a drafted pack nobody reviewed yet."""
    return F.when(
        provenance.isNotNull() & ~provenance["reviewed"],
        F.concat(
            F.lit("pack drafted by "), provenance["drafted_by"], F.lit(" from "),
            provenance["source"], F.lit(" on "), provenance["drafted_at"],
            F.lit(
                "; expected values are model-authored and unreviewed, so quality measures "
                "agreement with the drafter (set provenance.reviewed in task.yaml after checking)"
            ),
        ),
    )


def output_path(model: Column, example_id: Column, repetition: Column) -> Column:
    """Place of one raw output in an export."""
    return F.concat(
        F.lit("outputs/"), sanitize_path(model), F.lit("/"), sanitize_path(example_id),
        F.lit("-rep"), repetition.cast("string"), F.lit(".txt"),
    )
