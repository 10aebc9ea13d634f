"""Log and listing parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.text import (
    is_blank, js_trim, json_kind, json_number, json_string, strict_json,
)


def _field(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def parse_generation_log(lines: DataFrame) -> DataFrame:
    """Stream lines to token, done, error or bad events (S3).

    ``lines(..., line)``; blank lines vanish. A line that is no JSON object of a
    known shape becomes a ``bad`` event with the line in ``quarantine``.
    """
    kept = lines.filter(~is_blank(F.col("line"))).withColumn("_d", strict_json(F.col("line")))
    doc = F.col("_d")
    # Paths of a document that is no object lead nowhere, so they give null.
    fields = kept.withColumns({
        "_error": json_string(_field(doc, "$.error")),
        "_response": json_string(_field(doc, "$.response")),
        "_done": F.coalesce(json_kind(_field(doc, "$.done")) == "t", F.lit(False)),
    })
    kind = (
        F.when(F.col("_error").isNotNull(), "error").when(F.col("_done"), "done")
        .when(F.col("_response").isNotNull(), "token").otherwise("bad")
    )
    is_done = kind == "done"
    return fields.withColumns({
        "kind": kind,
        "text": F.when(kind == "token", F.col("_response")),
        "message": F.when(kind == "error", F.col("_error")),
        "done_reason": F.when(
            is_done, F.coalesce(json_string(_field(doc, "$.done_reason")), F.lit("unknown"))
        ),
        "prompt_token_count": F.when(is_done, json_number(_field(doc, "$.prompt_eval_count"), "bigint")),
        "output_token_count": F.when(is_done, json_number(_field(doc, "$.eval_count"), "bigint")),
        "quarantine": F.when(kind == "bad", F.col("line")),
    }).drop("_d", "_error", "_response", "_done")


def _sse_rows(lines: DataFrame) -> DataFrame:
    """Every line with its payload's values, and whether it is a payload before ``[DONE]``.

    Lines are parsed where they are read; the end of each generation's stream is found in the
    one shuffle that brings its lines together, so the log is read once.
    """
    trimmed = js_trim(F.col("line"))
    payload = F.when(trimmed.startswith("data: "), F.substring(trimmed, 7, 2147483647))
    read = lines.select("generation_id", "seq", payload.alias("_payload")).withColumn(
        "_done", F.coalesce(F.col("_payload") == "[DONE]", F.lit(False))
    ).withColumn("_d", F.when(~F.col("_done"), strict_json(F.col("_payload"))))
    doc = F.col("_d")
    parsed = read.select(
        "generation_id", "seq", "_done", F.col("_payload").isNotNull().alias("_is_payload"),
        F.nullif(json_string(_field(doc, "$.choices[0].delta.content")), F.lit("")).alias("text"),
        json_string(_field(doc, "$.choices[0].finish_reason")).alias("finish_reason"),
        json_number(_field(doc, "$.usage.prompt_tokens"), "bigint").alias("prompt_tokens"),
        json_number(_field(doc, "$.usage.completion_tokens"), "bigint").alias("completion_tokens"),
    )
    end = F.min(F.when(F.col("_done"), F.col("seq"))).over(Window.partitionBy("generation_id"))
    before = F.coalesce(F.col("seq") < F.col("_end"), F.lit(True))
    return parsed.withColumn("_end", end).withColumn("live", F.col("_is_payload") & before).drop(
        "_done", "_is_payload", "_end")


def parse_sse_log(lines: DataFrame) -> DataFrame:
    """Chat-completion stream lines to one row per payload.

    ``lines(generation_id, seq, line)``. What follows ``[DONE]`` is left out;
    payloads that are no JSON and empty deltas give rows without any value.
    """
    return _sse_rows(lines).filter("live").drop("live")


def sse_summary(events: DataFrame) -> DataFrame:
    """Last finish reason and usage of each generation, and its token count."""
    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    found = events.groupBy("generation_id").agg(
        last("finish_reason"), last("prompt_tokens"), last("completion_tokens"),
        F.count("text").alias("token_count"),
    )
    return found.withColumn(
        "failure_reason",
        F.when(F.col("finish_reason").isNull(), "stream ended without a finish_reason"),
    )


def sse_generations(lines: DataFrame) -> DataFrame:
    """The same from the lines themselves; generations without any live payload are there, and failed."""
    values = ("text", "finish_reason", "prompt_tokens", "completion_tokens")
    return sse_summary(_sse_rows(lines).withColumns({c: F.when(F.col("live"), F.col(c)) for c in values}))


def explode_models(listings: DataFrame) -> DataFrame:
    """Models of listing bodies.

    ``listings(listing_id, body)``. Entries without a name are left out, empty
    texts are null, a remote host makes a model remote.
    """
    models = F.try_variant_get(F.col("_d"), "$.models", "array<variant>")
    entries = (
        listings.withColumn("_d", strict_json(F.col("body")))
        .select("listing_id", F.posexplode(models).alias("seq", "m"))
        .filter(json_kind(F.col("m")) == "{")
    )
    m = F.col("m")
    return entries.select(
        "listing_id", "seq", json_string(_field(m, "$.name")).alias("name"),
        F.coalesce(json_string(_field(m, "$.digest")), F.lit("")).alias("digest"),
        F.coalesce(json_number(_field(m, "$.size"), "bigint"), F.lit(0)).alias("size_bytes"),
        F.nullif(json_string(_field(m, "$.details.quantization_level")), F.lit("")).alias(
            "quantization"
        ),
        F.nullif(json_string(_field(m, "$.details.parameter_size")), F.lit("")).alias(
            "parameter_size"
        ),
        F.coalesce(json_string(_field(m, "$.remote_host")) != "", F.lit(False)).alias("remote"),
    ).filter(F.col("name").isNotNull())


def leading_int(text: Column) -> Column:
    """Whole number a text starts with, or null."""
    digits = F.regexp_extract(js_trim(text), r"^([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def parse_gpu_samples(lines: DataFrame) -> DataFrame:
    """Memory samples, one whole MiB number per line; others are skipped."""
    return lines.withColumn("used_mib", leading_int(F.col("line"))).filter(
        F.col("used_mib").isNotNull()
    )


def gpu_snapshot(line: Column) -> Column:
    """``free, used`` of a CSV line as a struct, or null."""
    parts = F.split(line, ",")
    free = leading_int(F.try_element_at(parts, F.lit(1)))
    used = leading_int(F.try_element_at(parts, F.lit(2)))
    return F.when(
        free.isNotNull() & used.isNotNull(),
        F.struct(free.alias("free_mib"), used.alias("used_mib")),
    )


def gpu_identity(line: Column) -> Column:
    """``name, driver, total`` of a CSV line as a struct, or null."""
    parts = F.transform(F.split(line, ","), js_trim)
    name = F.nullif(F.try_element_at(parts, F.lit(1)), F.lit(""))
    total = leading_int(F.try_element_at(parts, F.lit(3)))
    return F.when(
        name.isNotNull() & total.isNotNull(),
        F.struct(
            name.alias("name"), F.try_element_at(parts, F.lit(2)).alias("driver_version"),
            total.alias("total_mib"),
        ),
    )


def parse_process_lines(lines: DataFrame, hints: list[str]) -> DataFrame:
    """Resident KiB of process lines whose command holds a hint, case folded.

    ``lines(tick, line)``; feed the result to ``process_memory``. Ticks without a
    matching process keep a zero row.
    """
    trimmed = js_trim(F.col("line"))
    space = F.instr(trimmed, " ")
    rss = F.when(space > 1, leading_int(F.left(trimmed, space - 1)))
    command = F.lower(F.substr(trimmed, space + 1))
    wanted = F.exists(
        F.array(*[F.lit(h.lower()) for h in hints]), lambda h: F.contains(command, h)
    )
    return lines.select(
        "tick", F.when(wanted, F.coalesce(rss, F.lit(0))).otherwise(0).alias("rss_kib")
    )


def rss_by_tick(lines: DataFrame, hints: list[str]) -> DataFrame:
    from gradelake.operators.aggregates import process_memory

    return process_memory(parse_process_lines(lines, hints))


def parse_meminfo(text: Column) -> Column:
    """``struct<total_mib, available_mib, used_mib>`` of a meminfo text."""
    def mib(key: str) -> Column:
        kib = F.nullif(
            F.regexp_extract(text, rf"(?m)^{key}:[ \t]+([0-9]+) kB", 1), F.lit("")
        ).try_cast("bigint")
        return F.floor(kib / 1024.0 + 0.5).cast("bigint")

    total, available = mib("MemTotal"), mib("MemAvailable")
    return F.struct(
        total.alias("total_mib"), available.alias("available_mib"),
        F.when(
            total.isNotNull() & available.isNotNull(), F.greatest(F.lit(0), total - available)
        ).alias("used_mib"),
    )


def parse_status(body: Column) -> Column:
    """Active memory of a server status body in whole MiB, or null."""
    active = _field(strict_json(body), "$.metal.active_memory_gb")
    return F.floor(json_number(active) * 1024 + 0.5).cast("bigint")
