"""Evaluation journal and exports."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradelake.functions.predicates import output_path
from gradelake.operators import scoring


def append_results(results: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append generation, score and status of each unit as one wide row.

    With a batch id the write replaces that batch's folder, so a repeated batch
    leaves one copy. Runs are folders, and large runs are spread over tasks. The schema is
    kept beside the rows, so that what stands in folder names is read back as it was.
    """
    _keep_schema(results, path)
    spread = F.pmod(F.xxhash64("unit_id"), F.lit(64))
    rows = results.repartition("run_id", spread).write.partitionBy("run_id")
    if batch_id is None:
        rows.mode("append").parquet(path)
    else:
        rows.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def unit_rows(spark: SparkSession, path: str) -> DataFrame:
    """Journal rows, one per unit of a run: of repeated deliveries the first batch counts.

    A filter on ``run_id`` prunes the folders that are read. Of a compacted journal the
    snapshot is read, and the batches that came after it.
    """
    schema, names = _stored_schema(spark, path), _names(spark, path)
    upto = _compacted(names)
    batches = [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) > upto]
    if upto < 0 and not batches:
        return _reader(spark, schema).parquet(path)
    parts = [_reader(spark, schema, "batch").option("basePath", path).parquet(*batches)] if batches else []
    if upto >= 0:
        parts.append(_reader(spark, schema, "batch").parquet(f"{path}/{_SNAPSHOT}{upto}"))
    rows = reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)
    rest = [c for c in rows.columns if c not in ("run_id", "unit_id")]
    first = F.min_by(F.struct(*rest), "batch").alias("_r")
    return rows.groupBy("run_id", "unit_id").agg(first).select("run_id", "unit_id", "_r.*").drop("batch")


def compact(spark: SparkSession, path: str) -> int:
    """Merge the batches of a journal into one snapshot, and return the last batch it holds, or -1.

    Readers go over to the snapshot when its mark appears, by one rename after all its rows
    are written; until then, and if this stops half-way, they read the batches. A batch
    that is repeated later has the rows the snapshot holds. ``drop_compacted`` removes what no
    reader needs any more.
    """
    names = _names(spark, path)
    upto = max((int(n[6:]) for n in names if n.startswith("batch=")), default=-1)
    if upto <= _compacted(names):
        return _compacted(names)
    rows = unit_rows(spark, path)
    spread = F.pmod(F.xxhash64("unit_id"), F.lit(64))
    rows.withColumn("batch", F.lit(upto).cast("bigint")).repartition("run_id", spread).write.mode(
        "overwrite").partitionBy("run_id").parquet(f"{path}/{_SNAPSHOT}{upto}")
    files, target = _files(spark, f"{path}/{_MARK}{upto}")
    files.create(target.suffix(".new")).close()
    files.rename(target.suffix(".new"), target)
    return upto


def drop_compacted(spark: SparkSession, path: str) -> None:
    """Delete the batches and older snapshots that the newest snapshot stands for."""
    names = _names(spark, path)
    upto = _compacted(names)
    for name in names:
        number = re.fullmatch(rf"(batch=|{_SNAPSHOT}|{_MARK})([0-9]+)", name)
        if number and (int(number[2]) < upto or (int(number[2]) == upto and number[1] == "batch=")):
            files, target = _files(spark, f"{path}/{name}")
            files.delete(target, True)


#: Folder of a snapshot, mark of one that is complete, and the schema of the rows. Spark's readers pass over names in _.
_SNAPSHOT, _MARK, _SCHEMA = "_snapshot-", "_compacted-", "_schema.json"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    files, target = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def _compacted(names: list[str]) -> int:
    """The last batch of the newest complete snapshot, or -1."""
    return max((int(n[len(_MARK):]) for n in names if re.fullmatch(rf"{_MARK}[0-9]+", n)), default=-1)


def _stored_schema(spark: SparkSession, path: str) -> StructType | None:
    files, target = _files(spark, f"{path}/{_SCHEMA}")
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _keep_schema(rows: DataFrame, path: str) -> None:
    """Write the schema with the first rows, and again when rows bring new columns."""
    spark = rows.sparkSession
    known = _stored_schema(spark, path) or StructType()
    fresh = [f for f in rows.schema.fields if f.name not in known.names]
    if not fresh:
        return
    whole = StructType([*known.fields, *fresh])
    files, target = _files(spark, f"{path}/{_SCHEMA}")
    out = files.create(target, True)
    out.write(bytearray(whole.json().encode()))
    out.close()


def _reader(spark: SparkSession, schema: StructType | None, *more: str):
    """A reader with the stored schema; journals without one are read as Spark infers them."""
    if schema is None:
        return spark.read.option("mergeSchema", "true")
    return spark.read.schema(StructType([*schema.fields, *(StructField(name, LongType()) for name in more)]))


def runs(journal_runs: DataFrame) -> DataFrame:
    """Runs, newest first."""
    return journal_runs.orderBy(F.desc("created_at_ms"), F.desc("run_seq"))


def candidates(journal_candidates: DataFrame, run_id: object) -> DataFrame:
    """Candidates of a run in insertion order."""
    return journal_candidates.filter(F.col("run_id") == run_id).orderBy("candidate_seq")


def unit_results(journal_units: DataFrame, run_id: object) -> DataFrame:
    """Units of a run by candidate, example and repetition."""
    return journal_units.filter(F.col("run_id") == run_id).orderBy(
        "candidate_id", "example_id", "repetition"
    )


def write_export(
    units: DataFrame, candidate_rows: DataFrame, path: str,
    examples: DataFrame | None = None, packs: DataFrame | None = None,
    run: DataFrame | None = None, report: Mapping[str, DataFrame] | None = None,
) -> None:
    """Reproducibility export as a folder of tables.

    ``units`` carry model name and pack. Raw outputs stand alone, in order of model and unit:
    files follow the amount of outputs, not the number of models, and their statistics tell
    which of them hold a model; scoring inputs are left out (pass None) when the pack drifted. ``run`` is the run's record and ``report`` the
    tables of its report. The manifest, with rows and digest of every table, is
    written last: an export without it was not finished.
    """
    named = units.withColumn(
        "output_path",
        F.when(
            F.col("output").isNotNull(),
            output_path(F.col("model_name"), F.col("example_id").cast("string"),
                        F.col("repetition")),
        ),
    )
    has_output = F.col("output").isNotNull()
    tables = {
        "units": named.drop("output"),
        "outputs": named.filter(has_output).select("unit_id", "model_name", "output_path", "output"),
        "scores": named.filter(has_output & F.col("score").isNotNull()).select(
            "run_id", "unit_id", "pack", "example_id", "output_path", "score", "pass", "details"),
        "candidates": candidate_rows,
    }
    if examples is not None and packs is not None:
        tables |= {"scoring/examples": examples, "scoring/packs": packs}
    if run is not None:
        tables["run"] = run
    tables |= {f"report/{name}": table for name, table in (report or {}).items()}
    manifest = []
    for name, table in tables.items():
        seen = Observation()
        if name == "outputs":  # sorted before it is observed: the ranges are found by reading the rows once more
            table = table.repartitionByRange("model_name", "unit_id").sortWithinPartitions("model_name", "unit_id")
        table.observe(seen, *_digest(table)).write.mode("errorifexists").parquet(f"{path}/{name}")
        manifest.append((name, seen.get["rows"], str(seen.get["digest"]), table.schema.json()))
    units.sparkSession.createDataFrame(
        manifest, "table_name string, rows bigint, digest string, columns string"
    ).coalesce(1).write.mode("errorifexists").json(f"{path}/{_MANIFEST}")


_MANIFEST = "manifest"


def _digest(table: DataFrame) -> list[Column]:
    """Rows of a table and a sum of hashes of them, which no order or partitioning changes."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(table.columns)))).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("digest")]


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export by name, once each is known to be whole.

    The manifest is read first. A table that lacks rows or holds others raises, as does an export
    that was not finished.
    """
    files, target = _files(spark, f"{path}/{_MANIFEST}/_SUCCESS")
    if not files.exists(target):
        raise ValueError(f"the export at {path} has no manifest, so it was not finished")
    listed = spark.read.schema("table_name string, rows bigint, digest string, columns string").json(
        f"{path}/{_MANIFEST}").collect()
    tables, broken = {}, []
    for entry in listed:
        schema = StructType.fromJson(json.loads(entry["columns"]))
        table = spark.read.schema(schema).parquet(f"{path}/{entry['table_name']}").select(*schema.names)
        found = table.agg(*_digest(table)).first()
        if (found["rows"], str(found["digest"])) != (entry["rows"], entry["digest"]):
            broken.append(f"{entry['table_name']} holds {found['rows']} rows of {entry['rows']}"
                          if found["rows"] != entry["rows"] else f"{entry['table_name']} holds other rows")
        tables[entry["table_name"]] = table
    if broken:
        raise ValueError(f"the export at {path} is broken: " + "; ".join(broken))
    return tables


def verify_export(spark: SparkSession, path: str) -> DataFrame:
    """Scores of an export that re-scoring its raw outputs does not reproduce."""
    tables = read_export(spark, path)
    if "scoring/packs" not in tables:
        raise ValueError(f"the export at {path} has no scoring inputs: the pack had drifted when it was written")
    return verify_scores(tables["scores"], tables["outputs"], tables["scoring/examples"], tables["scoring/packs"])


def verify_scores(
    scores: DataFrame, outputs: DataFrame, examples: DataFrame, packs: DataFrame
) -> DataFrame:
    """Every stored score with a mismatch text where it is not reproduced."""
    stored = scores.withColumnsRenamed(
        {"score": "stored_score", "pass": "stored_pass", "details": "stored_details"}
    )
    joined = stored.join(outputs.select("unit_id", "output"), "unit_id", "left")
    fresh = scoring.score(joined, examples, packs)
    details = F.to_json("details")
    same = (
        F.col("score").eqNullSafe(F.col("stored_score"))
        & F.col("pass").eqNullSafe(F.col("stored_pass"))
        & details.eqNullSafe(F.col("stored_details"))
    )
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("none"))

    where = F.concat(shown("output_path"), F.lit(": "))
    mismatch = (
        F.when(
            F.col("output").isNull(),
            F.concat(where, F.lit("the raw output is missing from the export")),
        )
        .when(
            F.col("failure_reason").isNotNull(),
            F.concat(
                where, F.lit("example "), shown("example_id"),
                F.lit(" is missing from the scoring inputs"),
            ),
        )
        .when(
            ~same,
            F.concat(
                where, F.lit("stored score "), shown("stored_score"),
                F.lit(" (pass "), shown("stored_pass"),
                F.lit(") but re-scoring produced "), shown("score"),
                F.lit(" (pass "), shown("pass"), F.lit(")"),
            ),
        )
    )
    return fresh.select(
        "run_id", "unit_id", "output_path", "stored_score", "score", mismatch.alias("mismatch")
    )


__all__ = [
    "append_results", "candidates", "compact", "drop_compacted", "read_export", "runs", "unit_results",
    "unit_rows", "verify_export", "verify_scores", "write_export",
]
