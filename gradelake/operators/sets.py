"""Set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.text import json_string
from gradelake.operators.scale import keep_first


def exclude_remote(models: DataFrame) -> DataFrame:
    """Models with the reason a remote one is left out."""
    reason = F.concat(
        F.lit("remote ("), F.col("origin"), F.lit("); cloud models cannot be measured locally")
    )
    return models.withColumn("excluded_reason", F.when(F.col("remote"), reason))


def merge_candidates(explicit: DataFrame, local: DataFrame) -> DataFrame:
    """Explicit candidates, then local models; the first of each name counts.

    Both carry ``(seq, name, remote, ...)``. A remote name also keeps later
    models of that name out.
    """
    first = explicit.withColumns({"part": F.lit(0), "origin": F.lit("from run config")})
    second = local.withColumns({"part": F.lit(1), "origin": F.lit("from local store")})
    merged = keep_first(first.unionByName(second), ["name"], ["part", "seq"])
    return exclude_remote(merged)


def missing_labels(labels: Column, prompt: Column) -> Column:
    """Labels the prompt never shows, case folded."""
    lowered = F.lower(prompt)
    return F.filter(labels, lambda label: ~F.contains(lowered, F.lower(label)))


def is_off_label(expected: Column, labels: Column) -> Column:
    """Expected value that is no string or not a declared label, exactly.

    False where no labels are declared.
    """
    known = F.coalesce(F.array_contains(labels, json_string(expected)), F.lit(False))
    return labels.isNotNull() & ~known


def off_label(examples: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` distinct off-label expected values of each pack, as JSON text (U4).

    ``examples(pack, seq, expected, labels)``.
    """
    offenders = (
        examples.filter(is_off_label(F.col("expected"), F.col("labels")))
        .groupBy("pack", F.to_json("expected").alias("value"))
        .agg(F.min("seq").alias("first_seq"))
    )
    place = F.row_number().over(Window.partitionBy("pack").orderBy("first_seq", "value"))
    return (
        offenders.withColumn("place", place)
        .filter(F.col("place") <= n)
        .groupBy("pack")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_v"))
        .select("pack", F.transform("_v", lambda v: v["value"]).alias("off_label"))
    )


def plan_union(included: DataFrame, skipped: DataFrame) -> DataFrame:
    """Plan of what runs and what was skipped, with a flag."""
    return included.withColumn("included", F.lit(True)).unionByName(
        skipped.withColumn("included", F.lit(False)), allowMissingColumns=True
    )
