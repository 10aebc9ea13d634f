"""Joins of the evaluation tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.fit import architecture_from_info, predict_fit
from gradelake.functions.text import json_kind
from gradelake.operators.aggregates import memory_delta_percent
from gradelake.operators.scale import lookup_join
from gradelake.session import cut_lineage

UNIT = ["run_id", "unit_id"]


def unit_results(units: DataFrame, generations: DataFrame, scores: DataFrame) -> DataFrame:
    """Units with their generation and score, where there is one."""
    return units.join(generations, "unit_id", "left").join(scores, "unit_id", "left")


def scoring_input(outputs: DataFrame, examples: DataFrame, packs: DataFrame) -> DataFrame:
    """Outputs with their example and pack spec.

    An output whose example is gone is kept, with the reason it cannot be scored.
    """
    known = examples.select("pack", "example_id", "expected").withColumn("_known", F.lit(True))
    # Examples take up their pack's spec first, so the outputs are joined only once.
    keyed = lookup_join(known, packs, ["pack"], ["example_id"])
    joined = lookup_join(outputs, keyed, ["pack", "example_id"], ["unit_id"])
    missing = F.concat(
        F.lit("example "), F.col("example_id").cast("string"),
        F.lit(" is missing from the pack; the pack changed since planning"),
    )
    return joined.withColumn(
        "failure_reason", F.when(F.col("_known").isNull(), missing)
    ).drop("_known")


def pending_work(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Units still to run: pending ones of candidates that did not run out of memory."""
    alive = candidates.filter(F.col("status") != "oom").select("run_id", "candidate_id")
    pending = units.filter(F.col("status") == "pending")
    return lookup_join(pending, alive, ["run_id", "candidate_id"], ["unit_id"], "left_semi")


_OCTAVE = 1 << 52


def size_position(size: Column) -> Column:
    """Whole number that grows with size and by exactly 2**52 when size doubles.

    The bit pattern of the size as a double: exact for sizes below 2**53 bytes.
    """
    exponent = F.length(F.bin(size)) - 1
    mantissa = F.expr("shiftleft(_size, 52 - (length(bin(_size)) - 1))") - F.lit(_OCTAVE)
    return exponent.cast("bigint") * F.lit(_OCTAVE) + mantissa


def size_peers(candidates: DataFrame) -> DataFrame:
    """Per candidate: rated candidates of the run from half to twice its size.

    ``peer_count`` leaves the candidate itself out; ``band_best_rate`` is the
    best rate in the band, itself included. No pairs are formed. Candidates of
    one size are one point; on the scale of ``size_position`` the band has a
    constant width of two octaves, so it is the tail of one two-octave block and
    the head of the next, and two running windows answer every band.
    """
    rated = F.col("tokens_per_second").isNotNull()
    sized = candidates.select(
        "run_id", F.col("size_bytes").alias("_size"),
        F.when(rated, F.col("tokens_per_second")).alias("rate"), rated.cast("int").alias("one"),
    )
    points = sized.groupBy("run_id", "_size").agg(
        F.max("rate").alias("best"), F.sum("one").alias("n")
    )
    width = 2 * _OCTAVE
    # Shifted by a block, so that no band starts below zero.
    placed = points.filter("_size > 0").withColumn(
        "at", size_position(F.col("_size")) + F.lit(width)
    )

    def side(edge: Column, is_tail: bool) -> DataFrame:
        data = placed.select(
            "run_id", F.col("_size"), "at", F.col("best"), F.col("n"), F.lit(0).alias("ask")
        )
        asks = placed.select(
            "run_id", F.col("_size"), edge.alias("at"), F.lit(None).cast("double").alias("best"),
            F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("ask"),
        )
        by_at = F.desc("at") if is_tail else F.asc("at")
        running = (
            Window.partitionBy("run_id", "_block").orderBy(by_at, "ask")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        return (
            data.unionByName(asks)
            .withColumn("_block", F.expr(f"`at` div {width}L"))
            .withColumn("best", F.max("best").over(running))
            .withColumn("n", F.sum("n").over(running))
            .filter("ask = 1")
            .select("run_id", "_size", "best", "n")
        )

    tail = side(F.col("at") - _OCTAVE, True)
    head = side(F.col("at") + _OCTAVE, False)
    empty_size = points.filter("_size = 0").select("run_id", "_size", "best", "n")
    bands = (
        tail.unionByName(head).unionByName(empty_size)
        .groupBy("run_id", "_size")
        .agg(F.max("best").alias("band_best_rate"), F.sum("n").alias("_n"))
        .withColumnRenamed("_size", "size_bytes")
    )
    joined = candidates.join(bands, ["run_id", "size_bytes"], "left")
    return joined.select(
        *candidates.columns,
        (F.col("_n") - rated.cast("int")).alias("peer_count"),
        "band_best_rate",
    )


def peer_names(flagged: DataFrame, candidates: DataFrame) -> DataFrame:
    """Names of the rated peers of flagged candidates, in candidate order.

    Only the few flagged rows are paired, by run and octave of size.
    """
    octave = F.length(F.bin("size_bytes"))
    left = flagged.select("run_id", "candidate_id", F.col("size_bytes").alias("own_size")).select(
        "*",
        F.explode(
            F.when(F.col("own_size") == 0, F.array(F.lit(0)))
            .otherwise(F.sequence(F.length(F.bin("own_size")) - 1, F.length(F.bin("own_size")) + 1))
        ).alias("octave"),
    )
    right = candidates.filter(F.col("tokens_per_second").isNotNull()).select(
        "run_id", F.col("candidate_id").alias("peer_id"), "candidate_seq", "model_name",
        "size_bytes",
        F.when(F.col("size_bytes") == 0, 0).otherwise(octave).alias("octave"),
    )
    close = (
        (F.col("peer_id") != F.col("candidate_id"))
        & (F.col("size_bytes") >= F.col("own_size") * 0.5)
        & (F.col("size_bytes") <= F.col("own_size") * 2.0)
    )
    named = F.array_sort(F.collect_list(F.struct("candidate_seq", "model_name")))
    return (
        left.join(right, ["run_id", "octave"])
        .filter(close)
        .groupBy("run_id", "candidate_id")
        .agg(F.array_join(F.transform(named, lambda p: p["model_name"]), ", ").alias("peers"))
    )


def rescore_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored against fresh score, pass and details of each unit.

    Both sides carry ``(run_id, unit_id, score, pass, details)``; details may be
    any type that converts to JSON.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        details = F.col("details")
        if dict(df.dtypes)["details"] != "string":
            details = F.to_json(details)
        return df.select(
            *UNIT, F.col("score").alias(f"{name}_score"), F.col("pass").alias(f"{name}_pass"),
            details.alias(f"{name}_details"),
        )

    same = F.lit(True)
    for field in ("score", "pass", "details"):
        same = same & F.col(f"stored_{field}").eqNullSafe(F.col(f"fresh_{field}"))
    return side(stored, "stored").join(side(fresh, "fresh"), UNIT).withColumn("changed", ~same)


def assess_fit(
    models: DataFrame, info: DataFrame, context: Column, free_mib: Column
) -> DataFrame:
    """Models with their architecture, where known, and the fit verdict.

    ``info(model_name, arch)``, one row per model at most.
    """
    joined = lookup_join(models, info, ["model_name"], ["model_name"])
    return joined.withColumn(
        "fit", predict_fit(F.col("size_bytes"), F.col("arch"), context, free_mib)
    )


#: Units of a work plan that one task makes, about.
UNITS_A_TASK = 1 << 22
#: Repetitions of examples, and candidates about, that are listed in one row to meet each other.
LISTED = 128
#: A task holds its lists while it makes their units; an entry counts as so many units.
UNITS_AN_ENTRY = 16
#: Largest measured size of a plan's candidates that are broadcast.
CANDIDATE_BYTES = 64 * 1024 * 1024


def work_plan(candidates: DataFrame, examples: DataFrame, reps: Column) -> DataFrame:
    """Every (candidate, example, repetition) of a run, all pending.

    Candidates and examples meet through their pack; the number of rows is the
    number of units to run, so the candidates are looked up. ``reps`` is read from the
    examples, which are few and make many units each: they are dealt to as many tasks as
    the units need, and only then repeated and listed. Candidates take one list after
    the other, so that in a written plan a candidate stands in runs and a list recurs
    within a page: the plan holds every unit, but takes a bit or two for each.
    """
    chosen = candidates.select("run_id", "candidate_id", "candidate_seq", "pack")
    wanted = examples.select("pack", "example_id", reps.alias("_reps")).filter("_reps IS NOT NULL")
    repetitions = F.sequence(F.lit(1), F.col("_reps"))

    def size(*columns: str) -> Column:
        return F.sum(F.length(F.to_json(F.struct(*columns)))).cast("double")

    # As doubles: a plan may hold more units than a long counts, and this only sizes tasks.
    each = chosen.groupBy("pack").agg(
        F.count(F.lit(1)).cast("double").alias("_c"), size(*chosen.columns).alias("_bytes")
    )
    listed = wanted.groupBy("pack").agg(F.sum(F.size(repetitions)).cast("double").alias("_n"))
    weight = F.coalesce("_n", F.lit(0.0)) * (F.col("_c") + UNITS_AN_ENTRY)
    packs = cut_lineage(each.filter("pack IS NOT NULL").join(listed, "pack", "left").select(
        "pack", "_bytes", (weight / UNITS_A_TASK).alias("_tasks"), F.ceil(F.col("_c") / LISTED).alias("_blocks")
    ))
    total = packs.agg(
        F.sum("_tasks").alias("tasks"), F.sum("_bytes").alias("chosen"), size(*packs.columns).alias("packs")
    ).first()
    tasks = max(1, math.ceil(total["tasks"] or 0))
    # Pack after pack, so that a task has few packs; a row's place is stable across retries.
    before = F.sum("_tasks").over(Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1))
    starts = packs.select("pack", "_tasks", F.coalesce(before, F.lit(0.0)).alias("_start"))
    within = F.pmod(F.xxhash64("example_id"), F.lit(1 << 30)) / (1 << 30)
    task = F.least(F.floor(F.col("_start") + F.col("_tasks") * within), F.lit(tasks - 1)).cast("int")
    repeated = (
        lookup_join(wanted, starts, ["pack"], ["example_id"], "inner", total["packs"] or 0)
        .select("pack", "example_id", "_reps", task.alias("_task"))
        .repartitionById(tasks, "_task")
        .select("_task", "pack", "example_id", F.explode(repetitions).alias("repetition"))
    )
    # Lists of a pack are about equally long, and whole bytes however few bits an entry takes.
    together = Window.partitionBy("_task", "pack")
    entries = F.count(F.lit(1)).over(together)
    length = F.ceil(entries / F.ceil(entries / LISTED) / 8) * 8
    place = F.row_number().over(together.orderBy("repetition", "example_id")) - 1
    lists = repeated.withColumn("_list", F.floor(place / length)).groupBy("_task", "pack", "_list").agg(
        F.collect_list(F.struct("example_id", "repetition")).alias("_listed")
    )
    # A join makes all rows for a list before it hands on the first, so it meets blocks of candidates.
    needed = packs.filter("_tasks > 0").select("pack", "_blocks")
    blocks = (
        lookup_join(chosen, needed, ["pack"], ["candidate_id"], "inner", total["packs"] or 0)
        .groupBy("pack", F.pmod(F.xxhash64("candidate_id"), F.col("_blocks")).alias("_block"))
        .agg(F.collect_list(F.struct("run_id", "candidate_id", "candidate_seq")).alias("_chosen"))
        .drop("_block")
    )
    paired = lookup_join(
        lists, blocks, ["pack"], ["_task", "_list"], "inner", total["chosen"] or 0, CANDIDATE_BYTES
    )
    # transform keeps this step out of the code of the join: candidates come out one by one.
    one = F.transform("_chosen", lambda c: F.struct(
        *[c[n].alias(n) for n in ("run_id", "candidate_id", "candidate_seq")]))
    return paired.select("pack", "_listed", F.inline(one)).select(
        "run_id", "candidate_id", "candidate_seq", "pack", F.inline("_listed"),
        F.lit("pending").alias("status"),
    )


def resolve_architecture(listing: DataFrame, headers: DataFrame) -> DataFrame:
    """Architecture of each model: listing metadata first, else header metadata.

    A source counts only as a whole record. Both hold ``(model_name, info)``.
    """
    first = listing.select("model_name", architecture_from_info(F.col("info")).alias("_a"))
    second = headers.select("model_name", architecture_from_info(F.col("info")).alias("_b"))
    return first.join(second, "model_name", "full").select(
        "model_name", F.coalesce("_a", "_b").alias("arch")
    )


def drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored against current fingerprints of each run, with what drifted.

    ``stored(run_id, pack_fingerprint, config_path, config_fingerprint)``,
    ``current(run_id, pack_fingerprint, config_fingerprint)``; a current null
    config fingerprint means the file cannot be read any more.
    """
    old = stored.withColumnsRenamed(
        {"pack_fingerprint": "stored_pack", "config_fingerprint": "stored_config"}
    ).withColumn("_stored", F.lit(True))
    new = current.withColumnsRenamed(
        {"pack_fingerprint": "current_pack", "config_fingerprint": "current_config"}
    )
    both = old.join(new, "run_id", "full")
    has_config = F.col("config_path").isNotNull()
    reason = (
        F.when(F.col("_stored").isNull(), "not planned")
        .when(~F.col("stored_pack").eqNullSafe(F.col("current_pack")), "pack changed")
        .when(has_config & F.col("current_config").isNull(), "config unreadable")
        .when(has_config & ~(F.col("current_config") == F.col("stored_config")), "config changed")
    )
    return both.withColumn("drift", reason).drop("_stored")


def predicted_vs_measured(candidates: DataFrame, peaks: DataFrame) -> DataFrame:
    """Predicted and measured peak of each candidate."""
    joined = candidates.join(peaks, ["run_id", "candidate_id"], "left")
    return joined.withColumn(
        "memory_delta_percent",
        memory_delta_percent(F.col("measured_peak_mib"), F.col("predicted_peak_mib")),
    )


def lookup_model(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed model for each wanted name, as is or with ``:latest``; first listed wins.

    ``wanted(wanted)``; ``listing(seq, name, ...)``.
    """
    names = wanted.select(
        "wanted", F.explode(F.array("wanted", F.concat("wanted", F.lit(":latest")))).alias("name")
    )
    details = [c for c in listing.columns if c not in ("seq", "name")]
    hits = names.join(listing, "name").groupBy("wanted").agg(
        F.min_by(F.struct("name", *details), "seq").alias("_m")
    )
    return wanted.join(hits, "wanted", "left").select("wanted", "_m.*")


def has_expected_type(v: Column, kind: str) -> Column:
    """Whether a VARIANT has the JSON type named by the first character of its text."""
    return json_kind(v) == kind
