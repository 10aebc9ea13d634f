"""Example files, pack specs, drafted packs and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions.text import bind, is_blank, json_kind, json_string, strict_json
from gradelake.operators.scale import group_index


def parse_example(text: Column) -> Column:
    """``struct<input, expected, problems>`` of one example file.

    ``problems`` lists every broken rule; input and expected are null then.
    """
    def judged(doc: Column) -> Column:
        return bind(
            F.struct(
                json_string(F.try_variant_get(doc, "$.input", "variant")).alias("source"),
                F.try_variant_get(doc, "$.expected", "variant").alias("expected"),
                F.coalesce(json_kind(doc), F.lit("")).alias("kind"),
                F.try_variant_get(doc, "$.replace_me", "variant").isNotNull().alias("stub"),
            ),
            checked,
        )

    def checked(e: Column) -> Column:
        broken = (
            F.when(e["kind"] == "", F.array(F.lit("not valid JSON")))
            .when(e["kind"] != "{", F.array(F.lit("must be a JSON object")))
            .when(e["stub"], F.array(F.lit("placeholder example")))
            .otherwise(
                F.array_compact(
                    F.array(
                        F.when(
                            F.coalesce(is_blank(e["source"]), F.lit(True)),
                            "input must be a non-empty string",
                        ),
                        F.when(e["expected"].isNull(), "missing expected"),
                    )
                )
            )
        )
        return bind(
            broken,
            lambda problems: F.struct(
                F.when(F.size(problems) == 0, e["source"]).alias("input"),
                F.when(F.size(problems) == 0, e["expected"]).alias("expected"),
                problems.alias("problems"),
            ),
        )

    return bind(strict_json(text), judged)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file of a folder, id = file stem."""
    files = (
        spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("source_path"),
                F.col("_metadata.file_name").alias("_name"))
    )
    return files.select(
        F.regexp_replace("_name", r"\.json$", "").alias("example_id"), "source_path",
        parse_example(F.col("value")).alias("_e"),
    ).select("example_id", "source_path", "_e.*")


def read_packs(spark: SparkSession, path: str, schemas: DataFrame | None = None) -> DataFrame:
    """Pack specs, one JSON object per line, with schema references resolved.

    A ``schema`` parameter that is a string names a row of
    ``schemas(schema_path, schema_text)``. Adds the columns scoring needs and
    keeps the whole ``manifest``.
    """
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    specs = lines.select(F.try_parse_json("value").alias("manifest"))
    return pack_columns(specs, schemas)


def pack_columns(specs: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("manifest", path, kind)

    gates = F.transform(
        F.coalesce(get("$.gates", "array<variant>"), F.array()),
        lambda g: F.struct(
            F.try_variant_get(g, "$.scorer", "string").alias("scorer"),
            F.try_variant_get(g, "$.scorer_params", "variant").alias("scorer_params"),
        ),
    )
    packs = specs.select(
        get("$.name").alias("pack"), get("$.type").alias("task_type"),
        get("$.scorer").alias("scorer"), get("$.scorer_params", "variant").alias("scorer_params"),
        gates.alias("gates"),
        F.struct(
            get("$.generation.context", "int").alias("context"),
            get("$.generation.max_tokens", "int").alias("max_tokens"),
            get("$.generation.temperature", "double").alias("temperature"),
            get("$.generation.seed", "bigint").alias("seed"),
            get("$.generation.runs_per_example", "int").alias("runs_per_example"),
        ).alias("generation"),
        F.when(
            get("$.provenance", "variant").isNotNull(),
            F.struct(
                get("$.provenance.source").alias("source"),
                get("$.provenance.source_sha256").alias("source_sha256"),
                get("$.provenance.drafted_by").alias("drafted_by"),
                get("$.provenance.drafted_at").alias("drafted_at"),
                F.coalesce(get("$.provenance.reviewed", "boolean"), F.lit(False)).alias(
                    "reviewed"
                ),
            ),
        ).alias("provenance"),
        "manifest",
    )
    if schemas is None:
        return packs
    reference = F.when(
        json_kind(F.try_variant_get("scorer_params", "$.schema", "variant")) == '"',
        F.try_variant_get("scorer_params", "$.schema", "string"),
    )
    joined = packs.withColumn("schema_path", reference).join(schemas, "schema_path", "left")
    inlined = F.parse_json(
        F.concat(F.lit('{"schema":'), F.col("schema_text"), F.lit("}"))
    )
    return joined.withColumn(
        "scorer_params",
        F.when(F.col("schema_text").isNotNull(), inlined).otherwise(F.col("scorer_params")),
    ).drop("schema_path", "schema_text")


# Generation settings of drafted packs.
DRAFT_GENERATION = {
    "context": 4096, "max_tokens": 512, "temperature": 0, "seed": 42, "runs_per_example": 3,
}


def draft_ids(examples: DataFrame) -> DataFrame:
    """Zero-padded example ids, numbered per pack in ``seq`` order."""
    numbered = group_index(
        examples, ["pack"], [F.col("seq")], F.floor(F.col("seq") / 65536), "_i", "_n"
    )
    width = F.greatest(F.lit(3), F.length(F.col("_n").cast("string")))
    return numbered.withColumn(
        "example_id",
        F.lpad((F.col("_i") + 1).cast("string"), width, F.lit("0")),
    ).drop("_i", "_n")


def write_examples(examples: DataFrame, path: str) -> None:
    """Write drafted examples as JSON lines, one folder per pack."""
    rows = draft_ids(examples).select(
        "pack", "example_id", "input", F.to_json("expected").alias("expected")
    )
    # Spread a hot pack over several files.
    spread = F.pmod(F.xxhash64("example_id"), F.lit(32))
    rows.repartition("pack", spread).write.mode("errorifexists").partitionBy("pack").json(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder with its path relative to it and its content.

    Spark's file sources leave out empty files, so these do not count here.
    """
    root = F.lit(path.rstrip("/") + "/")
    full = F.regexp_replace(F.col("path"), "^file:(//)?", "")
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(
            F.when(full.startswith(root), F.substr(full, F.length(root) + 1)).otherwise(full)
            .alias("relpath"),
            "content",
        )
    )


def _digest_in_order(names: tuple[str, ...]):
    """A task that hashes sorted files pack by pack, holding one batch of them at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, sha, kinds = None, None, None
        for batch in batches:
            done = []
            kinds = [batch.schema.field(c).type for c in names]
            keys = zip(*(batch.column(c).to_pylist() for c in names)) if names else ((),) * batch.num_rows
            for key, path, content in zip(keys, batch.column("relpath"), batch.column("content")):
                if sha is None or key != pack:
                    if sha is not None:
                        done.append((*pack, sha.hexdigest()))
                    pack, sha = key, hashlib.sha256()
                sha.update(path.as_py().encode() + b"\0")
                if content.is_valid:
                    sha.update(content.as_buffer())
                sha.update(b"\0")
            if done:
                yield _digest_rows(done, kinds, names)
        if sha is not None:
            yield _digest_rows([(*pack, sha.hexdigest())], kinds, names)

    return run


def _digest_rows(done: list[tuple], kinds: list[pa.DataType], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*done), [*kinds, pa.string()])]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "fingerprint"])


def pack_fingerprint(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """sha256 over sorted ``relpath 0 content 0`` of each pack's files.

    Byte exact. Each folder level is sorted, hence the order by path parts. The files are
    sorted on their way to the pack's task, which hashes them as they come: however many
    files a pack has, a batch of them is held at a time. Empty contents count as such.
    """
    names = tuple(keys)
    wanted = files.select(*names, "relpath", "content")
    placed = wanted.repartition(*names) if names else wanted.coalesce(1)
    schema = ", ".join(
        [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names] + ["fingerprint string"])
    return placed.sortWithinPartitions(*names, F.split("relpath", "/")).mapInArrow(_digest_in_order(names), schema)


def set_fingerprint(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint of any number of files per key, for comparing with itself only.

    Each file's sha256 over path and content is cut into numbers that are summed,
    so no order and no collected list is needed.
    """
    zero = F.unhex(F.lit("00"))
    digest = F.sha2(F.concat(F.encode("relpath", "utf-8"), zero, F.col("content")), 256)
    parts = [
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)
    ]
    sums = [F.sum(p).cast("string") for p in parts]
    total = F.concat_ws("-", F.count(F.lit(1)).cast("string"), *sums)
    return files.groupBy(*keys).agg(F.sha2(total, 256).alias("fingerprint"))


def file_fingerprint(content: Column) -> Column:
    """sha256 of a file's content; null stays null."""
    return F.sha2(content, 256)
