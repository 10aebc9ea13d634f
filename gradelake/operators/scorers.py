"""Scorers as Column builders (C1-C6) and their registry.

A scorer turns an output, an expected value and parameters into
``struct<score, pass, details>``. Bad output scores 0 with a reason. Parameters
may be plain Python values or Columns, so packs with different parameters can
be scored in one pass over one table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.operators import schema_check

_FIELDS = "array<struct<field:string,status:string>>"
_PATTERNS = "array<struct<pattern:string,matched:boolean>>"
#: Every detail any scorer reports; what does not apply is null.
DETAILS = {
    "reason": "string",
    "resolved_label": "string",
    "actual": "double",
    "raw_token": "string",
    "difference": "double",
    "allowed_difference": "double",
    "extraction_needed": "boolean",
    "fields": _FIELDS,
    "precision": "double",
    "recall": "double",
    "f1": "double",
    "violations": "array<string>",
    "patterns": _PATTERNS,
    "matched_count": "int",
}


def record(score: Column, passed: Column, **details: Column) -> Column:
    """A score record; details are cast to their declared types."""
    filled = [
        (details[name] if name in details else F.lit(None)).cast(kind).alias(name)
        for name, kind in DETAILS.items()
    ]
    return F.struct(
        score.cast("double").alias("score"),
        passed.cast("boolean").alias("pass"),
        F.struct(*filled).alias("details"),
    )


def _strings(values: Sequence[str] | Column) -> Column:
    return values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])


@dataclass(frozen=True)
class Output:
    """An output with the forms scorers need; each form is computed once per row."""

    text: Column
    normalized: Column
    number: Column
    extracted: Column

    @classmethod
    def of(cls, text: Column) -> Output:
        return cls(text, T.normalize_text(text), T.parse_first_number(text), T.extract_json(text))


def label_table(labels: Sequence[str] | Column, aliases: Mapping[str, str] | Column | None):
    """``(keys, labels)``: normalised spellings and what they stand for.

    Ordered so that the first hit is the one that counts: aliases override
    labels, later entries override earlier ones.
    """
    if not isinstance(labels, Column):
        return _literal_label_table(labels, aliases or {})
    names = labels
    entries = F.coalesce(
        F.map_entries(aliases), F.array().cast("array<struct<key:string,value:string>>")
    )
    own_keys = F.transform(names, T.normalize_text)
    alias_keys = F.transform(entries, lambda e: T.normalize_text(e["key"]))
    targets = F.transform(
        entries,
        lambda e: F.try_element_at(
            F.reverse(names),
            F.nullif(
                F.array_position(F.reverse(own_keys), T.normalize_text(e["value"])), F.lit(0)
            ).cast("int"),
        ),
    )
    return (
        F.reverse(F.concat(own_keys, alias_keys)),
        F.reverse(F.concat(names, targets)),
    )


def _literal_label_table(labels: Sequence[str], aliases: Mapping[str, str]):
    table = {T.normalize_literal(label): label for label in labels}
    for alias, target in aliases.items():
        label = table.get(T.normalize_literal(target))
        if label is None:
            raise ValueError(f'alias "{alias}" points at "{target}", which is not a declared label')
        table[T.normalize_literal(alias)] = label
    return _strings(list(table)), _strings(list(table.values()))


def resolve_label(keys: Column, labels: Column, normalized: Column) -> Column:
    """Label a normalised text stands for, or null."""
    position = F.nullif(F.array_position(keys, normalized), F.lit(0)).cast("int")
    return F.try_element_at(labels, position)


def exact_label_with(keys: Column, labels: Column, output: Output, expected: Column) -> Column:
    """C1 over a prepared label table."""
    def judged(found: Column) -> Column:
        match = F.coalesce(
            found == resolve_label(keys, labels, T.normalize_text(expected)), F.lit(False)
        )
        reason = F.when(found.isNull(), "output is not a declared label or alias")
        return record(match.cast("double"), match, resolved_label=found, reason=reason)

    return T.bind(resolve_label(keys, labels, output.normalized), judged)


def exact_label(output, expected, labels, aliases=None) -> Column:
    """The whole normalised output has to be the expected label or an alias of it."""
    keys, names = label_table(labels, aliases)
    return exact_label_with(keys, names, _output(output), expected)


def field_f1(output, expected: Column, key_fields) -> Column:
    """F1 over the key fields of the extracted object (C2). ``expected`` is a VARIANT."""
    wanted = _strings(key_fields)

    def compared(ext: Column) -> Column:
        sides = F.struct(
            F.try_variant_get(ext["value"], "$", "map<string,variant>").alias("actual"),
            F.try_variant_get(expected, "$", "map<string,variant>").alias("truth"),
        )
        return T.bind(
            sides,
            lambda pair: T.bind(
                F.transform(wanted, lambda field: status(pair["actual"], pair["truth"], field)),
                lambda fields: counted(ext, pair["actual"], fields),
            ),
        )

    def status(actual: Column, truth: Column, field: Column) -> Column:
        present = F.coalesce(F.map_contains_key(actual, field), F.lit(False))
        known = F.coalesce(F.map_contains_key(truth, field), F.lit(False))
        equal = known & (
            _json_or_null(F.try_element_at(actual, field))
            == _json_or_null(F.try_element_at(truth, field))
        )
        verdict = F.when(~present, "missing").when(equal, "match").otherwise("mismatch")
        return F.struct(field.alias("field"), verdict.alias("status"))

    def counted(ext: Column, actual: Column, fields: Column) -> Column:
        def count(name: str) -> Column:
            return F.size(F.filter(fields, lambda f: f["status"] == name))

        tallies = F.struct(
            count("match").cast("double").alias("hits"),
            count("mismatch").alias("wrong"), F.size(fields).alias("n"),
        )
        return T.bind(tallies, lambda n: judged(ext, actual, fields, n))

    def judged(ext: Column, actual: Column, fields: Column, n: Column) -> Column:
        precision = F.coalesce(F.try_divide(n["hits"], n["hits"] + n["wrong"]), F.lit(0.0))
        recall = F.coalesce(F.try_divide(n["hits"], n["n"]), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
        reason = F.when(~ext["ok"], F.concat(F.lit("output is not JSON: "), ext["error"])).when(
            actual.isNull(), "output JSON is not an object, so there are no fields to compare"
        )
        return record(
            f1, n["hits"] == n["n"], reason=reason,
            extraction_needed=ext["extraction_needed"], fields=fields,
            precision=precision, recall=recall, f1=f1,
        )

    return T.bind(_output(output).extracted, compared)


def _json_or_null(v: Column) -> Column:
    """Comparison key of a field that is present; a JSON null is a value, not missing."""
    return F.coalesce(T.value_key(v), F.lit("null"))


def json_schema(output, schema: Mapping) -> Column:
    """The extracted JSON has to satisfy a schema; every violation is listed."""
    check = schema_check.compile_schema(schema)

    def judged(ext: Column) -> Column:
        found = F.when(ext["ok"], check(ext["value"])).otherwise(
            F.array(F.concat(F.lit("output is not JSON: "), ext["error"]))
        )
        return T.bind(
            found,
            lambda violations: record(
                (F.size(violations) == 0).cast("double"), F.size(violations) == 0,
                extraction_needed=ext["extraction_needed"], violations=violations,
            ),
        )

    return T.bind(_output(output).extracted, judged)


def pattern(output, patterns, mode="contains", match="all") -> Column:
    """Share of patterns found; all or any have to be found to pass (C4)."""
    text = output.text if isinstance(output, Output) else output
    mode_c = mode if isinstance(mode, Column) else F.lit(mode)
    match_c = match if isinstance(match, Column) else F.lit(match)

    def found(p: Column) -> Column:
        if isinstance(mode, Column):
            hit = F.when(mode_c == "contains", F.contains(text, p)).otherwise(F.regexp_like(text, p))
        else:
            hit = F.contains(text, p) if mode == "contains" else F.regexp_like(text, p)
        return F.struct(p.alias("pattern"), F.coalesce(hit, F.lit(False)).alias("matched"))

    def judged(results: Column) -> Column:
        n = F.size(F.filter(results, lambda r: r["matched"]))
        passed = F.when(match_c == "all", n == F.size(results)).otherwise(n > 0)
        return record(n / F.size(results), passed, patterns=results, matched_count=n)

    if isinstance(patterns, Column):
        return T.bind(F.transform(patterns, found), judged)
    # Known texts are literals, so that each pattern is compiled once and not per row.
    return T.bind(F.array(*[found(F.lit(p)) for p in patterns]), judged)


def numeric_tolerance(output, expected: Column, tolerance, mode="absolute") -> Column:
    """First number of the output within a tolerance of the expected one."""
    within = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    mode_c = mode if isinstance(mode, Column) else F.lit(mode)
    allowed = F.when(mode_c == "absolute", within).otherwise(within * F.abs(expected))

    def judged(found: Column) -> Column:
        difference = F.abs(found["value"] - expected)
        passed = F.coalesce(difference <= allowed, F.lit(False))
        reason = F.when(
            found.isNull(),
            "no numeric token found in output (numbers written as words do not count)",
        )
        return record(
            passed.cast("double"), passed, actual=found["value"], raw_token=found["raw"],
            difference=difference, allowed_difference=F.when(found.isNotNull(), allowed),
            reason=reason,
        )

    return T.bind(_output(output).number, judged)


def _output(output) -> Output:
    return output if isinstance(output, Output) else Output.of(output)


def with_gates(primary: tuple[str, Column], gates: Sequence[tuple[str, Column]]) -> Column:
    """Primary record zeroed by any failing gate; the first failing one is named."""
    name, main = primary
    named = [F.struct(F.lit(g).alias("name"), r.alias("record")) for g, r in gates]
    records = F.array(*named) if named else F.array()
    return compose(F.lit(name), main, records if named else None)


def compose(name: Column, primary: Column, gates: Column | None) -> Column:
    """C6 over an array of gate records in declared order."""
    def judged(main: Column, records: Column | None, failed: Column) -> Column:
        return F.struct(
            F.when(failed.isNull(), main["score"]).otherwise(0.0).alias("score"),
            (failed.isNull() & main["pass"]).alias("pass"),
            F.struct(
                failed.alias("failed_gate"),
                F.struct(name.alias("name"), main.alias("record")).alias("primary"),
                (records if records is not None else F.lit(None)).alias("gates"),
            ).alias("details"),
        )

    if gates is None:
        return T.bind(primary, lambda main: judged(main, None, F.lit(None).cast("string")))
    return T.bind(
        F.struct(primary.alias("main"), gates.alias("gates")),
        lambda both: T.bind(
            first_failed_gate(both["gates"]),
            lambda failed: judged(both["main"], both["gates"], failed),
        ),
    )


def first_failed_gate(gates: Column) -> Column:
    """Name of the first gate that did not pass, in declared order."""
    failing = F.filter(gates, lambda g: ~g["record"]["pass"])
    return F.try_element_at(failing, F.lit(1))["name"]


@dataclass(frozen=True)
class Params:
    """Parameters of one scorer of one pack, as Columns; ``own`` has all of them as a VARIANT."""

    label_keys: Column
    label_names: Column
    key_fields: Column
    patterns: Column
    mode: Column
    match: Column
    tolerance: Column
    schema_text: Column
    own: Column


Builder = Callable[[Output, Column, Params], Column]
_REGISTRY: dict[str, Builder] = {}


def register_scorer(name: str, builder: Builder) -> None:
    """Add a scorer that packs can name; names are unique."""
    if name in _REGISTRY:
        raise ValueError(f'scorer "{name}" is already registered')
    _REGISTRY[name] = builder


def scorer_names() -> list[str]:
    return sorted(_REGISTRY)


def get_scorer(name: str) -> Builder:
    if name not in _REGISTRY:
        raise ValueError(f'unknown scorer "{name}"; use one of: {", ".join(scorer_names())}')
    return _REGISTRY[name]


def _as_text(expected: Column) -> Column:
    return F.try_variant_get(expected, "$", "string")


register_scorer(
    "exact-label",
    lambda o, e, p: exact_label_with(p.label_keys, p.label_names, o, _as_text(e)),
)
register_scorer("field-f1", lambda o, e, p: field_f1(o, e, p.key_fields))
register_scorer(
    "pattern",
    lambda o, e, p: pattern(
        o, p.patterns, F.coalesce(p.mode, F.lit("contains")), F.coalesce(p.match, F.lit("all"))
    ),
)
register_scorer(
    "numeric-tolerance",
    lambda o, e, p: numeric_tolerance(
        o, F.try_variant_get(e, "$", "double"), p.tolerance,
        F.coalesce(p.mode, F.lit("absolute")),
    ),
)
# The schema scorer compiles each distinct schema, so scoring binds it by text.
register_scorer("json-schema", lambda o, e, p: F.lit(None))


def json_schema_by_text(output: Output, schema_text: Column, schemas: Sequence[str]) -> Column:
    """C3 where rows name different schemas: one branch per distinct schema text."""
    chosen: Column | None = None
    for text in schemas:
        scored = json_schema(output, json.loads(text))
        here = schema_text == text
        chosen = F.when(here, scored) if chosen is None else chosen.when(here, scored)
    return chosen
