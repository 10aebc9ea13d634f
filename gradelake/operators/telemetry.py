"""Memory-sample series."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.operators.aggregates import millis
from gradelake.operators.scale import group_index, lookup_join
from gradelake.session import cut_lineage

#: Fixed value: longest timeline kept per candidate.
TIMELINE_CAP = 4096
#: Samples of a candidate are numbered hour by hour.
_HOUR = 3600


def survives(index: Column, total: Column, cap: int) -> Column:
    """Whether a sample is still there after append-and-halve decimation.

    Whenever the kept list reaches ``cap`` (a power of two), every second entry
    goes. With half = cap / 2, the first halving happens at ``cap`` samples and
    then at every ``half`` more; a sample of batch j has seen the halvings since
    then, and survives k of them when its place in the batch is a multiple of 2**k.
    """
    if cap < 2 or cap & (cap - 1):
        raise ValueError("the timeline cap must be a power of two")
    half = cap // 2

    def batches(past: Column) -> Column:
        return F.when(past < 0, 0).otherwise(F.floor(past / half) + 1)

    since_cap = index - cap
    batch = batches(since_cap)
    halvings = batches(total - cap) - batch
    place = F.when(since_cap < 0, index).otherwise(F.pmod(since_cap, F.lit(half)))
    # A first-batch sample is judged by its index; later batches cannot outlive log2(half).
    stride = F.pow(F.lit(2.0), halvings)
    fits = F.pmod(place.cast("double"), stride) == 0
    return fits & ((batch == 0) | (stride <= half))


def decimate(samples: DataFrame, cap: int = TIMELINE_CAP) -> DataFrame:
    """Bounded timeline of each candidate.

    ``samples(candidate_id, at TIMESTAMP, used_mib, sample_id)``. The position of
    each sample is found without sorting a candidate in one task.
    """
    numbered = group_index(
        samples, ["candidate_id"], [F.col("at"), F.col("sample_id")],
        F.floor(F.unix_seconds("at") / _HOUR), "sample_index", "sample_total",
    )
    return numbered.filter(survives(F.col("sample_index"), F.col("sample_total"), cap))


def sample_offsets(samples: DataFrame) -> DataFrame:
    """Whole milliseconds since the candidate's first sample."""
    first = samples.groupBy("candidate_id").agg(F.min("at").alias("first_at"))
    joined = lookup_join(samples, first, ["candidate_id"], ["at"])
    offset = F.floor(millis(F.col("at"), F.col("first_at")) + 0.5).cast("bigint")
    return joined.withColumn("offset_ms", offset).drop("first_at")


_SCANNED = "{key}, block bigint, asks boolean, at bigint, value double, found bigint"


def _scan_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a candidate and block from the latest back: questions with the next low sample, blocks with their least.

    Of the samples behind, only those are kept that are lower than all between: for the
    question's limit the nearest of them that is low enough is found by bisection.
    """
    block: tuple | None = None
    values: list[float] = []  # rising towards the nearest
    places: list[int] = []
    kind: pa.DataType | None = None
    done: list[tuple] = []

    def close() -> None:
        if block is not None and values:
            done.append((*block, False, block[1], values[0], None))
        values.clear()
        places.clear()

    def rows() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
        done.clear()
        return pa.RecordBatch.from_arrays(
            columns, names=["candidate_id", "block", "asks", "at", "value", "found"])

    for batch in batches:
        kind = batch.column("candidate_id").type
        for candidate, number, at, asks, value in zip(
            *(batch.column(c).to_pylist() for c in ("candidate_id", "block", "at", "asks", "value"))
        ):
            if (candidate, number) != block:
                close()
                block = candidate, number
            if asks:
                low = bisect_right(values, value) - 1
                done.append((candidate, number, True, at, value, places[low] if low >= 0 else None))
            else:
                while values and values[-1] >= value:
                    values.pop()
                    places.pop()
                values.append(value)
                places.append(at)
        if done:
            yield rows()
    close()
    if done:
        yield rows()


def _scanned(samples: DataFrame, questions: DataFrame) -> DataFrame:
    """Both inputs (candidate_id, block, at, value), block by block, latest first; see ``_scan_back``."""
    rows = samples.withColumn("asks", F.lit(False)).unionByName(questions.withColumn("asks", F.lit(True)))
    key = f"candidate_id {samples.schema['candidate_id'].dataType.simpleString()}"
    return (
        rows.repartition("candidate_id", "block")
        .sortWithinPartitions("candidate_id", "block", F.col("at").desc(), "asks")
        .mapInArrow(_scan_back, _SCANNED.format(key=key))
    )


def next_low(samples: DataFrame, questions: DataFrame) -> DataFrame:
    """The first sample at or after each question that is no higher than its limit.

    ``samples(candidate_id, at, value)`` and ``questions(candidate_id, at, value)``, times in
    microseconds, without nulls; gives ``candidate_id, at, value, found``. Questions meet the
    samples of their own hour first, then the least values of later hours, then the samples of the hour
    that has one: each input row is looked at a fixed number of times and no pair is made.
    """
    def hour(at: Column) -> Column:
        return F.floor(at / (_HOUR * 1_000_000)).cast("bigint")

    by_hour = samples.select("candidate_id", hour(F.col("at")).alias("block"), "at", "value")
    asked = questions.select("candidate_id", hour(F.col("at")).alias("block"), "at", "value")
    near = cut_lineage(_scanned(by_hour, asked))
    one_block = F.lit(0).cast("bigint").alias("block")
    least = near.filter("NOT asks").select("candidate_id", one_block, "at", "value")
    open_still = near.filter("asks AND found IS NULL")
    later = open_still.select("candidate_id", one_block, (F.col("block") + 1).alias("at"), "value").distinct()
    far = cut_lineage(_scanned(least, later).filter("asks AND found IS NOT NULL").select(
        "candidate_id", F.col("found").alias("block"), F.col("at").alias("from_block"), "value"))
    first = far.select(
        "candidate_id", "block", (F.col("block") * (_HOUR * 1_000_000)).alias("at"), "value").distinct()
    wanted = first.select("candidate_id", "block").distinct()
    within = _scanned(by_hour.join(wanted, ["candidate_id", "block"], "left_semi"), first).filter("asks").select(
        "candidate_id", "block", "value", "found")
    settled = far.join(within, ["candidate_id", "block", "value"])
    resolved = open_still.select("candidate_id", (F.col("block") + 1).alias("from_block"), "at", "value").join(
        settled.select("candidate_id", "from_block", "value", "found"), ["candidate_id", "from_block", "value"], "left")
    return near.filter("asks AND found IS NOT NULL").select("candidate_id", "at", "value", "found").unionByName(
        resolved.select("candidate_id", "at", "value", "found"))


def settle_audit(
    samples: DataFrame, unloads: DataFrame, slack_mib: float = 256.0, timeout_ms: float = 15000.0
) -> DataFrame:
    """Whether memory came back to its baseline in time after each unload.

    ``unloads(candidate_id, unloaded_at, baseline_mib)``. Without a baseline
    nothing is awaited; without a low sample in time the unload is flagged.
    """
    limit = (F.col("baseline_mib") + slack_mib).cast("double")
    asked = unloads.filter("candidate_id IS NOT NULL AND unloaded_at IS NOT NULL AND baseline_mib IS NOT NULL").select(
        "candidate_id", F.unix_micros("unloaded_at").alias("at"), limit.alias("value")).distinct()
    measured = samples.filter("candidate_id IS NOT NULL AND at IS NOT NULL AND used_mib IS NOT NULL").select(
        "candidate_id", F.unix_micros("at").alias("at"), F.col("used_mib").cast("double").alias("value"))
    found = next_low(measured, asked).select(
        F.col("candidate_id").alias("_candidate"), F.col("at").alias("_at"), F.col("value").alias("_limit"), "found")
    waited = (F.col("found") - F.col("_at")) / F.lit(1000.0)
    late = F.coalesce(waited > timeout_ms, F.lit(True))
    joined = unloads.join(
        found, (F.col("candidate_id") == F.col("_candidate"))
        & (F.unix_micros("unloaded_at") == F.col("_at")) & (limit == F.col("_limit")), "left")
    return joined.select(
        *[unloads[c] for c in unloads.columns], F.timestamp_micros("found").alias("settled_at"),
        waited.alias("waited_ms"), F.when(F.col("baseline_mib").isNull(), False).otherwise(late).alias("flagged"))
