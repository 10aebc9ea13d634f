"""Memory-fit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions import display

MIB = 1024.0 * 1024.0
# Fixed values of the fit model.
OVERHEAD_MIB = 1024.0
KV_ELEMENT_BYTES = 2.0
FREE_HEADROOM = 0.95
UNIFIED_BUDGET_FRACTION = 0.75


def kv_cache_mib(arch: Column, context: Column) -> Column:
    """KV-cache size of an architecture struct at a context length."""
    cells = (
        arch["block_count"].cast("double")
        * arch["kv_head_count"]
        * (arch["key_length"] + arch["value_length"])
        * context
    )
    return cells * KV_ELEMENT_BYTES / MIB


def predict_fit(size_bytes: Column, arch: Column, context: Column, free_mib: Column) -> Column:
    """Fit struct: verdict, reason and the parts of the sum (F8)."""
    weights = size_bytes.cast("double") / MIB
    kv = F.when(arch.isNotNull(), kv_cache_mib(arch, context))
    peak = weights + kv + OVERHEAD_MIB
    budget = free_mib * FREE_HEADROOM
    numbers = F.concat(
        F.lit("predicted peak "), display.whole(peak), F.lit(" MiB "),
        F.when(peak <= budget, "is within ").otherwise("exceeds "), display.whole(budget),
        F.lit(" MiB (95% of "), display.whole(free_mib), F.lit(" MiB free)"),
    )
    verdict = (
        F.when(arch.isNull() | free_mib.isNull(), "unknown")
        .when(peak <= budget, "fits")
        .otherwise("does-not-fit")
    )
    reason = (
        F.when(
            arch.isNull(),
            "architecture metadata unavailable, so the KV cache cannot be estimated; "
            "attempt with --force",
        )
        .when(
            free_mib.isNull(),
            "free memory could not be sampled (no working memory telemetry), "
            "so no fit verdict is possible",
        )
        .otherwise(numbers)
    )
    return F.struct(
        verdict.alias("verdict"), reason.alias("reason"), peak.alias("predicted_peak_mib"),
        weights.alias("weights_mib"), kv.alias("kv_cache_mib"),
        F.lit(OVERHEAD_MIB).alias("overhead_mib"), free_mib.cast("double").alias("free_mib"),
    )


def unpredictable_fit(reason: Column | str, applicable: bool = True) -> Column:
    """The other verdicts: nothing to predict, or no local fit at all."""
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit("unknown" if applicable else "not-applicable").alias("verdict"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        none.alias("predicted_peak_mib"), F.lit(0.0).alias("weights_mib"),
        none.alias("kv_cache_mib"), F.lit(0.0).alias("overhead_mib"), none.alias("free_mib"),
    )


def architecture_from_info(info: Column) -> Column:
    """Architecture struct of a ``map<string, string>`` of model metadata, or null."""
    name = F.nullif(F.try_element_at(info, F.lit("general.architecture")), F.lit(""))

    def number(field: str) -> Column:
        value = F.try_element_at(info, F.concat(name, F.lit("." + field))).try_cast("double")
        return F.when((value > 0) & (value < float("inf")), value)

    heads = number("attention.head_count")
    head_size = F.try_divide(number("embedding_length"), heads)
    blocks = number("block_count")
    kv_heads = F.coalesce(number("attention.head_count_kv"), heads)
    key = F.coalesce(number("attention.key_length"), head_size)
    value = F.coalesce(number("attention.value_length"), head_size)
    longest = number("context_length")
    complete = F.lit(True)
    for part in (name, blocks, kv_heads, key, value, longest):
        complete = complete & part.isNotNull()
    return F.when(
        complete,
        F.struct(
            name.alias("architecture"), blocks.alias("block_count"),
            kv_heads.alias("kv_head_count"), key.alias("key_length"),
            value.alias("value_length"), longest.alias("max_context"),
        ),
    )


def unified_free_mib(total_mib: Column, used_mib: Column) -> Column:
    """Free part of a unified-memory budget."""
    budget = F.floor(total_mib * UNIFIED_BUDGET_FRACTION)
    return F.greatest(F.lit(0), budget - used_mib)
