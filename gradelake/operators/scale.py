"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gradelake.session import cut_lineage

#: Largest planned size of a side that is broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024
#: Largest planned size of an input that is spread over idle cores.
SPREAD_BYTES = 512 * 1024 * 1024
#: Pieces a hot key is split into when the other side is too large to broadcast.
SALTS = 16


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, or None where it is not available."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before work that is heavy per row.

    Files come in splits; an input of less than one split per core leaves cores
    idle. Only inputs planned below ``SPREAD_BYTES`` are moved, so at scale this
    never shuffles anything.
    """
    size = planned_bytes(df)
    if size is None or size >= SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def measured_bytes(df: DataFrame) -> int:
    """Size of a small, already written table as JSON text, summed by Spark."""
    row = F.length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).first()["n"]


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    size: float | None = None,
    most: int | None = None,
) -> DataFrame:
    """Join facts, whose keys may be badly skewed, to rows that are few per key.

    A lookup whose size, as given or as planned, is within ``most`` (by default
    ``BROADCAST_BYTES``) is broadcast. Otherwise every key is split into ``SALTS`` pieces by a hash of
    ``spread_by`` (stable across task retries, unlike a random salt) and the
    lookup is repeated once per piece; AQE may still turn this into a broadcast
    join when the lookup proves small at run time. Join keys never match null.
    """
    keys = list(keys)
    if size is None:
        size = planned_bytes(lookup)
    if size is not None and size <= (BROADCAST_BYTES if most is None else most):
        return facts.join(F.broadcast(lookup), keys, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def group_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    index: str = "row_index",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row within its group, without one task per group.

    ``bucket`` must never decrease along ``order``. Rows are numbered inside
    (group, bucket), and the buckets' starting positions come from their counts,
    so a hot group is spread over as many tasks as it has buckets. Only the
    count table, one row per bucket, is windowed by group alone.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", bucket)
    by_group = Window.partitionBy(*keys)
    starts = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_n").over(
                    by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    wanted = [*keys, "_bucket", "_start"]
    if total is not None:
        starts = starts.withColumn(total, F.sum("_n").over(by_group))
        wanted.append(total)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(starts.select(*wanted), [*keys, "_bucket"], "left")
        .withColumn(index, (F.col("_start") + F.col("_row") - 1).cast("bigint"))
        .drop("_bucket", "_row", "_start")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order.

    A combinable ``min_by`` rather than a window, so copies of a hot key
    collapse before the shuffle. ``order`` has to be unique within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


#: Accuracy of the sketch that brackets a median, and the half width of the bracket as a share
#: of the group, several times the sketch's error.
SKETCH_ACCURACY = 10_000
BRACKET = 0.0006
#: Distinct values of a group that are put in order together.
ORDERED = 100_000
#: Points between which the values of a larger group are counted.
POINTS = 64


def exact_medians(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], spread_by: Sequence[str]
) -> DataFrame:
    """Exact, interpolating medians per group, one ``<metric>_median`` column each.

    ``median`` keeps every distinct value of a group in one task's memory. Here
    a mergeable sketch brackets the middle of each group first; a second pass
    counts what lies below and above and keeps exact counts only for values
    inside the bracket, about a thousandth of the group. Groups whose bracket missed
    the middle, or holds more than can be put in order together, are narrowed down further by
    ``_narrowed``. Written once: the result has one row per group.
    """
    keys = list(keys)
    metrics = list(metrics)
    ends = F.array(F.lit(0.5 - BRACKET), F.lit(0.5 + BRACKET))
    value = [F.col(m).cast("double") for m in metrics]
    # Written once and measured: with a few groups the second pass then needs no
    # shuffle of the facts, only a broadcast of the brackets.
    brackets = cut_lineage(df.groupBy(*keys).agg(
        *[F.percentile_approx(v, ends, F.lit(SKETCH_ACCURACY)).alias(f"_{m}") for v, m in zip(value, metrics)],
        *[F.count(v).alias(f"_n_{m}") for v, m in zip(value, metrics)],
    ))
    columns = list(dict.fromkeys([*keys, *spread_by, *metrics]))
    bracketed = lookup_join(
        df.select(*columns), brackets, keys, spread_by, "inner", measured_bytes(brackets)
    )

    def zone(i: int) -> Column:
        low, high = F.col(f"_{metrics[i]}")[0], F.col(f"_{metrics[i]}")[1]
        return F.when(value[i] < low, 0).when(value[i] <= high, 1).when(value[i].isNotNull(), 2)

    def kept(i: int) -> Column:
        """Whether the bracket is small enough for its values to be kept; else they are only counted."""
        return F.col(f"_n_{metrics[i]}") * (3 * BRACKET) <= ORDERED

    placed = bracketed.select(
        *keys,
        *[zone(i).alias(f"z{i}") for i in range(len(metrics))],
        *[F.when(kept(i), value[i]).alias(f"v{i}") for i in range(len(metrics))],
    )
    inside = [
        F.when(F.col(f"z{i}") == 1, F.struct(F.lit(i).alias("metric"), F.col(f"v{i}").alias("value")))
        for i in range(len(metrics))
    ]
    # One row per unit carries the counts, and one more per value inside a bracket.
    tally = F.struct(F.lit(-1).alias("metric"), F.lit(None).cast("double").alias("value"))
    counted = (
        placed.select("*", F.explode(F.array_compact(F.array(tally, *inside))).alias("_p"))
        .groupBy(*keys, "_p.metric", "_p.value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.count_if(F.col(f"z{i}") == z).alias(f"n{i}_{z}")
                for i in range(len(metrics)) for z in (0, 2)
            ],
        )
    )
    # The counts below and above become rows of their own metric.
    outside = F.array(*[
        F.struct(
            F.lit(i).alias("metric"), F.lit(z).alias("zone"),
            F.lit(None).cast("double").alias("value"), F.col(f"n{i}_{z}").alias("n"),
        )
        for i in range(len(metrics)) for z in (0, 2)
    ])
    own = F.array(F.struct("metric", F.lit(1).alias("zone"), "value", "n"))
    counts = counted.select(
        *keys, F.explode(F.when(F.col("metric") == -1, outside).otherwise(own)).alias("_p")
    ).select(*keys, "_p.*").filter("n > 0")
    seen = Observation()
    found = cut_lineage(_at_middle(counts, [*keys, "metric"], ["zone", "value"]).observe(
        seen, F.count_if(F.col("value").isNull()).alias("missed")))
    # What is known by now; the rest has no value at its rank, as it lies outside or is only counted.
    known = found.filter("value IS NOT NULL").select(*keys, "metric", "side", "value")
    missed = found.filter("value IS NULL").select(*keys, "metric", "side", "rank")
    if seen.get["missed"]:
        long = df.select(*keys, F.posexplode(F.array(*value)).alias("metric", "value")).filter("value IS NOT NULL")
        known = known.unionByName(_narrowed(long, [*keys, "metric"], missed))
    return known.groupBy(*keys).agg(*[
        (F.sum(F.when(F.col("metric") == i, F.col("value"))) / 2).alias(f"{m}_median")
        for i, m in enumerate(metrics)
    ])


def _at_middle(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The entries of counted, ordered entries that hold a group's two middle ranks, as sides 0 and 1."""
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("total", F.sum("n").over(group)).withColumn("upto", upto)
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), F.floor((F.col("total") - 1 + side) / 2).alias("rank"))
        for side in (0, 1)
    ])
    hit = F.filter(sides, lambda s: (F.col("upto") - F.col("n") <= s["rank"]) & (s["rank"] < F.col("upto")))
    return ranked.filter(F.size(hit) > 0).select(
        *counts.columns, F.explode(hit).alias("_s")).select("*", "_s.side", "_s.rank").drop("_s", "n")


def _narrowed(values: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """keys, side, value: the values at wanted ranks of groups of any size.

    ``wanted(keys, side, rank)``. Each round counts a group's values between a few of its own
    quantiles and goes on with the stretch that holds the rank, without its ends; so it gets
    smaller every time, and after a few rounds its values are few enough to be ordered, or it is
    one value.
    """
    at = [*keys, "side"]
    open_still = wanted.select(
        *at, "rank", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    known: list[DataFrame] = []
    while True:
        inside = lookup_join(values, open_still, keys, ["value"], "inner").filter(
            "(low IS NULL OR value > low) AND (high IS NULL OR value < high)")
        shares = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])
        sketched = cut_lineage(inside.groupBy(*at, "rank").agg(
            F.percentile_approx("value", shares, F.lit(SKETCH_ACCURACY)).alias("points"),
            F.min("value").alias("least"), F.max("value").alias("most"), F.approx_count_distinct("value").alias("n"),
        ).select(*at, "rank", "n", F.array_sort(F.array_distinct(
            F.concat("points", F.array("least", "most")))).alias("points")))
        small = sketched.filter(F.col("n") <= ORDERED).select(*at, "rank")
        ordered = lookup_join(inside.drop("low", "high", "rank"), small, at, ["value"], "inner").groupBy(
            *at, "rank", "value").agg(F.count(F.lit(1)).alias("n"))
        known.append(_at_rank(ordered, at, ["value"]).select(*at, "value"))
        large = sketched.filter(F.col("n") > ORDERED).select(*at, "rank", "points")
        below = F.size(F.filter("points", lambda p: p < F.col("value")))
        # An even place lies between two points, an odd one is a point itself.
        place = 2 * below + F.array_contains("points", F.col("value")).cast("int")
        counted = lookup_join(inside.drop("low", "high", "rank"), large, at, ["value"], "inner").groupBy(
            *at, "rank", "points", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
        hit = cut_lineage(_at_rank(counted, at, ["place"]))
        point = F.get("points", F.floor(F.col("place") / 2).cast("int"))
        known.append(hit.filter("place % 2 = 1").select(*at, point.alias("value")))
        between = hit.filter("place % 2 = 0")
        if between.isEmpty():
            return reduce(DataFrame.unionByName, known)
        open_still = between.select(
            *at, (F.col("rank") - F.col("before")).alias("rank"),
            F.get("points", (F.col("place") / 2).cast("int") - 1).alias("low"), point.alias("high"))


def _at_rank(counts: DataFrame, at: list[str], order: list[str]) -> DataFrame:
    """The counted, ordered entry of each group that holds its ``rank``, with the count ``before`` it."""
    ordered = Window.partitionBy(*at).orderBy(*order)
    before = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("before", before).filter(
        (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
