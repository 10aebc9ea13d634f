"""Pareto frontier with missing measurements.

A missing axis compares as equal, so dominance is not transitive across
candidates with different missing axes. It is transitive among candidates that
miss the same axes, and a point beaten there is beaten on fewer axes too by
whatever beat it. So the undominated points of each such class are the only
ones that can matter as dominators, and a class can be thinned piece by piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.operators.scale import SALTS

#: (column, whether higher wins)
AXES = (("quality", True), ("vram_mib", False), ("tokens_per_second", True))
#: Most points compared with each other in one piece of a class.
PIECE = 2048


def dominates(a: str, b: str, axes: Sequence[tuple[str, bool]] = AXES) -> Column:
    """Row ``a`` is no worse than ``b`` on every axis and better on one."""
    never_worse, once_better = F.lit(True), F.lit(False)
    for name, higher in axes:
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        better, worse = (x > y, x < y) if higher else (x < y, x > y)
        never_worse = never_worse & ~F.coalesce(worse, F.lit(False))
        once_better = once_better | F.coalesce(better, F.lit(False))
    return never_worse & once_better


def frontier(
    points: DataFrame,
    axes: Sequence[tuple[str, bool]] = AXES,
    partition: str = "run_id",
) -> DataFrame:
    """Points no other point of their partition dominates.

    Ties stay. Anti joins emit no pairs; pieces of a class hold at most about
    ``PIECE`` distinct points, and the final check of a hot partition is spread
    over salted pieces of its points against the few surviving dominators.
    """
    names = [name for name, _ in axes]
    distinct = points.select(partition, *names).distinct()
    missing = F.concat(*[F.col(n).isNull().cast("int").cast("string") for n in names])
    classed = distinct.withColumn("_class", missing)
    sizes = classed.groupBy(partition, "_class").agg(
        F.ceil(F.count(F.lit(1)) / PIECE).alias("_pieces")
    )
    pieces = classed.join(sizes, [partition, "_class"]).withColumn(
        "_piece", F.pmod(F.xxhash64(*names), F.col("_pieces"))
    )
    inside = [partition, "_class", "_piece"]
    left, right = pieces.alias("l"), pieces.alias("r")
    same_piece = F.lit(True)
    for key in inside:
        same_piece = same_piece & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    strong = left.join(right, same_piece & dominates("r", "l", axes), "left_anti").select(
        partition, *names
    )
    spread = F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int")
    asked = points.withColumn("_salt", spread).alias("p")
    rivals = strong.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    ).alias("d")
    same = (F.col(f"p.{partition}") == F.col(f"d.{partition}")) & (
        F.col("p._salt") == F.col("d._salt")
    )
    return asked.join(rivals, same & dominates("d", "p", axes), "left_anti").drop("_salt")
