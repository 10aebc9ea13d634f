"""Dataset validation: every problem in one pass (V1-V7).

A rule is an expression that gives a message or null. All rules of a row are
one array, so each job is map-side apart from counts and first-seen lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import (
    bind, extract_json, is_blank, js_trim, json_kind, json_number, json_string, kebab, normalize_text,
)
from gradelake.operators.scale import group_index, keep_first, lookup_join
from gradelake.operators.schema_check import schema_problem
from gradelake.operators.scorers import label_table, resolve_label, scorer_names
from gradelake.operators.sets import is_off_label, missing_labels
from gradelake.sources.packs import parse_example

#: Fixed value: fewest distinct examples of a drafted pack.
MIN_DRAFT_EXAMPLES = 10
_NO_PROBLEMS = "array<string>"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(json_kind(v) == kind, F.lit(False))


def _rules(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _nonblank(v: Column, name: str) -> Column:
    blank = F.coalesce(is_blank(json_string(v)), F.lit(True))
    return F.when(blank, f'"{name}" must be a non-empty string')


def _known_scorer(v: Column, name: str) -> Column:
    known = scorer_names()
    text = json_string(v)
    bad = text.isNotNull() & ~is_blank(text) & ~text.isin(*known)
    return F.when(
        bad,
        F.concat(
            F.lit(f'"{name}" is "'), text,
            F.lit(f'", which is not a known scorer; use one of: {", ".join(known)}'),
        ),
    )


def _string_array(v: Column) -> Column:
    """True for a non-empty JSON array of strings."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return _is(v, "[") & F.coalesce(
        (F.size(items) > 0) & F.forall(items, lambda i: json_kind(i) == '"'), F.lit(False)
    )


def explode_problems(df: DataFrame, keys: list[str], problems: Column) -> DataFrame:
    """One row per problem, numbered within its row."""
    return df.select(*keys, F.posexplode(problems).alias("place", "message"))


# V1 -------------------------------------------------------------------------

def validate_examples(files: DataFrame, text: str = "value") -> DataFrame:
    """Problems of example texts (V1). Keeps all other columns as keys."""
    keys = [c for c in files.columns if c != text]
    return explode_problems(files, keys, parse_example(F.col(text))["problems"])


# V2 -------------------------------------------------------------------------

def manifest_problems(m: Column) -> Column:
    """Every broken rule of a manifest VARIANT, in order."""
    def numeric(key: str, whole: bool, least: float | None) -> Column:
        value = json_number(_at(m, f"$.generation.{key}"))
        name = f'"generation.{key}"'
        rule = F.when(value.isNull(), f"{name} must be a number")
        if whole:
            rule = rule.when(value != F.floor(value), f"{name} must be an integer")
        if least is not None:
            rule = rule.when(value < least, f"{name} must be at least {least:g}")
        return rule

    generation = _at(m, "$.generation")
    has_generation = _is(generation, "{")
    params, gates = _at(m, "$.scorer_params"), _at(m, "$.gates")
    provenance = _at(m, "$.provenance")
    is_provenance = _is(provenance, "{")
    reviewed = _at(m, "$.provenance.reviewed")

    def gate(entry: Column, i: Column) -> Column:
        where = F.concat(F.lit('"gates['), i.cast("string"), F.lit("]"))
        scorer = _at(entry, "$.scorer")
        text = json_string(scorer)
        own = _at(entry, "$.scorer_params")
        return (
            F.when(~_is(entry, "{"), F.concat(where, F.lit('" must be a mapping')))
            .when(
                F.coalesce(is_blank(text), F.lit(True)),
                F.concat(where, F.lit('.scorer" must be a non-empty string')),
            )
            .when(
                ~text.isin(*scorer_names()),
                F.concat(where, F.lit('.scorer" is not a known scorer')),
            )
            .when(
                own.isNotNull() & ~_is(own, "{"),
                F.concat(where, F.lit('.scorer_params" must be a mapping')),
            )
        )

    gate_rules = F.array_compact(
        F.transform(
            F.coalesce(F.try_variant_get(gates, "$", "array<variant>"), F.array()), gate
        )
    )
    numbers = F.when(
        has_generation,
        _rules(
            numeric("context", True, 1), numeric("max_tokens", True, 1),
            numeric("temperature", False, 0), numeric("seed", True, None),
            numeric("runs_per_example", True, 1),
        ),
    ).otherwise(F.array(F.lit('"generation" must be a mapping')))
    head = _rules(
        _nonblank(_at(m, "$.name"), "name"), _nonblank(_at(m, "$.type"), "type"),
        _nonblank(_at(m, "$.scorer"), "scorer"), _known_scorer(_at(m, "$.scorer"), "scorer"),
        F.when(params.isNotNull() & ~_is(params, "{"), '"scorer_params" must be a mapping'),
    )
    paths = _rules(
        _nonblank(_at(m, "$.prompt_template"), "prompt_template"),
        _nonblank(_at(m, "$.examples_dir"), "examples_dir"),
        F.when(gates.isNotNull() & ~_is(gates, "["), '"gates" must be a list'),
    )
    origin = (
        F.when(provenance.isNull(), F.array().cast(_NO_PROBLEMS))
        .when(~is_provenance, F.array(F.lit('"provenance" must be a mapping')))
        .otherwise(
            _rules(
                *[
                    _nonblank(_at(m, f"$.provenance.{k}"), k)
                    for k in ("source", "source_sha256", "drafted_by", "drafted_at")
                ],
                F.when(
                    reviewed.isNotNull() & ~json_kind(reviewed).isin("t", "f", "n"),
                    '"provenance.reviewed" must be true or false',
                ),
            )
        )
    )
    every = F.concat(
        head, numbers, paths, F.when(_is(gates, "["), gate_rules).otherwise(F.array()), origin
    )
    return F.when(_is(m, "{"), every).otherwise(
        F.array(F.lit("the manifest must be a mapping at the top level"))
    )


def validate_packs(packs: DataFrame) -> DataFrame:
    """Problems of ``packs(pack, manifest VARIANT)`` (V2)."""
    return explode_problems(packs, ["pack"], manifest_problems(F.col("manifest")))


# V3 -------------------------------------------------------------------------

def validate_templates(templates: DataFrame) -> DataFrame:
    """Templates without the input placeholder (V3): ``templates(pack, template)``."""
    return templates.filter(~F.contains(F.col("template"), F.lit("{{input}}"))).select(
        "pack", F.lit("the prompt template has no {{input}} placeholder").alias("message")
    )


# V5 -------------------------------------------------------------------------

def param_problems(scorer: Column, params: Column, bad_schemas: Mapping[str, str] | None = None) -> Column:
    """Every broken parameter rule of a scorer's VARIANT parameters (V5).

    ``bad_schemas`` tells what is wrong with schemas that do not compile, by their text.
    """
    def need(name: str, key: str, what: str, bad: Column) -> Column:
        return F.when(
            (scorer == name) & bad, f'scorer "{name}" param "{key}" {what}'
        )

    def strings(name: str, key: str) -> Column:
        return need(
            name, key, "must be a non-empty array of strings",
            ~_string_array(_at(params, f"$.{key}")),
        )

    def choice(name: str, key: str, choices: tuple[str, ...]) -> Column:
        given = _at(params, f"$.{key}")
        bad = given.isNotNull() & ~F.coalesce(json_string(given).isin(*choices), F.lit(False))
        return need(name, key, f"must be one of: {', '.join(choices)}", bad)

    aliases = _at(params, "$.aliases")
    entries = F.map_entries(F.try_variant_get(aliases, "$", "map<string,variant>"))
    labels = F.transform(
        F.coalesce(F.try_variant_get(params, "$.labels", "array<string>"), F.array()),
        normalize_text,
    )
    is_map = _is(aliases, "{")
    bad_values = F.filter(entries, lambda e: json_kind(e["value"]) != '"')
    astray = F.filter(
        entries,
        lambda e: ~F.array_contains(
            labels, normalize_text(F.try_variant_get(e["value"], "$", "string"))
        ),
    )
    tolerance = json_number(_at(params, "$.tolerance"))
    found = _rules(
        strings("exact-label", "labels"),
        need(
            "exact-label", "aliases", "must be an object mapping strings to strings",
            aliases.isNotNull() & (~is_map | (F.size(bad_values) > 0)),
        ),
        need(
            "exact-label", "aliases", "points at a label that is not declared",
            is_map & (F.size(bad_values) == 0) & (F.size(astray) > 0),
        ),
        strings("field-f1", "key_fields"),
        strings("pattern", "patterns"),
        choice("pattern", "mode", ("contains", "regex")),
        choice("pattern", "match", ("all", "any")),
        need("numeric-tolerance", "tolerance", "must be a finite number", tolerance.isNull()),
        need("numeric-tolerance", "tolerance", "must be zero or positive", tolerance < 0),
        choice("numeric-tolerance", "mode", ("absolute", "relative")),
        need("json-schema", "schema", "must be an object", ~_is(_at(params, "$.schema"), "{")),
        *[F.when((scorer == "json-schema") & (schema_text(params) == text), F.lit(said))
          for text, said in (bad_schemas or {}).items()],
    )
    return F.concat(found, _unreadable_patterns(scorer, params))


def schema_text(params: Column) -> Column:
    """The schema among a scorer's parameters as JSON text."""
    return F.to_json(_at(params, "$.schema"))


def _unreadable_patterns(scorer: Column, params: Column) -> Column:
    """A problem for each pattern that does not compile, told by Java's own compiler."""
    patterns = F.when(
        (scorer == "pattern") & (json_string(_at(params, "$.mode")) == "regex")
        & _string_array(_at(params, "$.patterns")),
        F.try_variant_get(params, "$.patterns", "array<string>"))
    bad = F.filter(
        patterns, lambda p: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNull())
    told = F.transform(bad, lambda p: F.concat(
        F.lit('scorer "pattern" param "patterns" has "'), p, F.lit('", which does not compile')))
    return F.coalesce(told, F.array().cast(_NO_PROBLEMS))


def pack_problems(bad_schemas: Mapping[str, str] | None = None) -> Column:
    """Problems of the primary and gate parameters of a pack's row."""
    gates = F.flatten(
        F.transform(
            F.coalesce("gates", F.array()),
            lambda g: param_problems(g["scorer"], g["scorer_params"], bad_schemas),
        )
    )
    return F.concat(param_problems(F.col("scorer"), F.col("scorer_params"), bad_schemas), gates)


def bad_schemas_of(packs: DataFrame) -> dict[str, str]:
    """What is wrong with the packs' schemas that do not compile, by their text.

    Schemas are written by hand, so the distinct ones come to the driver, which has the compiler.
    """
    of_gates = F.transform(
        F.coalesce("gates", F.array()),
        lambda g: F.when(g["scorer"] == "json-schema", schema_text(g["scorer_params"])))
    own = F.when(F.col("scorer") == "json-schema", schema_text(F.col("scorer_params")))
    texts = packs.select(F.explode(F.concat(F.array(own), of_gates)).alias("text")).filter(
        F.col("text").startswith("{")).distinct().collect()
    found = {r["text"]: schema_problem(packs.sparkSession, r["text"]) for r in texts}
    return {text: said for text, said in sorted(found.items()) if said is not None}


def validate_params(packs: DataFrame) -> DataFrame:
    """Problems of every pack's primary and gate parameters (V5)."""
    return explode_problems(packs, ["pack"], pack_problems(bad_schemas_of(packs)))


# V4 -------------------------------------------------------------------------

def expected_problem(scorer: Column, params: Column, expected: Column) -> Column:
    """What is wrong with an expected value for a scorer, or null."""
    shown = F.to_json(expected)
    keys, names = label_table(
        F.try_variant_get(params, "$.labels", "array<string>"),
        F.try_variant_get(params, "$.aliases", "map<string,string>"),
    )
    known = resolve_label(keys, names, normalize_text(json_string(expected))).isNotNull()

    def wrong(name: str, bad: Column, what: str) -> Column:
        return F.when(
            (scorer == name) & bad,
            F.concat(F.lit(f"{name} example has expected value "), shown, F.lit(what)),
        )

    return F.coalesce(
        wrong("exact-label", ~known, ", which is not in labels"),
        wrong("field-f1", ~_is(expected, "{"), ", but this scorer needs an object"),
        wrong(
            "numeric-tolerance", json_number(expected).isNull(), ", which is not a finite number"
        ),
    )


def judge_expected(examples: DataFrame, packs: DataFrame) -> DataFrame:
    """Examples with ``problem``: what is wrong with their expected value, or null.

    ``examples(pack, example_id, expected, ...)``. A bad parameter shows as the problem of
    the pack's examples. Examples of packs that are not there have no problem.
    """
    specs = packs.select("pack", "scorer", "scorer_params", "gates")
    joined = lookup_join(examples, specs, ["pack"], ["example_id"], "left")
    scorer, params, expected = F.col("scorer"), F.col("scorer_params"), F.col("expected")

    def first_problem(name: Column, own: Column) -> Column:
        return F.coalesce(
            F.try_element_at(param_problems(name, own), F.lit(1)),
            expected_problem(name, own, expected),
        )

    gate = F.try_element_at(
        F.array_compact(
            F.transform(
                F.coalesce("gates", F.array()),
                lambda g: first_problem(g["scorer"], g["scorer_params"]),
            )
        ),
        F.lit(1),
    )
    return joined.select(
        *examples.columns, F.coalesce(gate, first_problem(scorer, params)).alias("problem"))


def check_expected(examples: DataFrame, packs: DataFrame) -> DataFrame:
    """Dry check of every expected value; same messages collapse to the first (V4).

    ``examples(pack, example_id, source_path, expected)``. A bad parameter shows
    as the message of the first example.
    """
    found = judge_expected(examples, packs).filter(F.col("problem").isNotNull()).select(
        "pack", "example_id", "source_path", F.col("problem").alias("message"))
    return keep_first(found, ["pack", "message"], ["example_id"])


# V6, V7 ---------------------------------------------------------------------

def parse_drafts(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts and their example entries from raw texts ``(draft_id, output)``.

    Entries carry what the checks need to know of their draft, so no join has to
    bring it back.
    """
    found = outputs.withColumn("_x", extract_json(F.col("output")))
    doc = F.when(_is(F.col("_x.value"), "{"), F.col("_x.value"))
    drafts = found.select(
        "draft_id", F.col("_x.ok").alias("ok"), F.col("_x.error").alias("error"),
        doc.alias("draft"),
    )
    described = drafts.select("draft_id", "draft", *draft_facts(F.col("draft")))
    entries = described.select(
        "draft_id", "labels", "key_fields",
        F.posexplode(F.try_variant_get("draft", "$.examples", "array<variant>")).alias(
            "seq", "entry"
        ),
    )
    return drafts, entries


def draft_facts(doc: Column) -> list[Column]:
    """Scorer of a draft, and its labels or key fields where they are usable."""
    scorer, params = json_string(_at(doc, "$.scorer")), _at(doc, "$.scorer_params")

    def list_of(name: str, key: str) -> Column:
        value = _at(params, f"$.{key}")
        usable = (scorer == name) & _string_array(value)
        return F.when(usable, F.try_variant_get(value, "$", "array<string>"))

    return [
        scorer.alias("scorer"),
        list_of("exact-label", "labels").alias("labels"),
        list_of("field-f1", "key_fields").alias("key_fields"),
    ]


def entry_problem(entry: Column) -> Column:
    """What is wrong with one proposed example, or null."""
    source = json_string(_at(entry, "$.input"))
    return (
        F.when(~_is(entry, "{"), "must be an object with input and expected")
        .when(F.coalesce(is_blank(source), F.lit(True)), "input must be a non-empty string")
        .when(_at(entry, "$.expected").isNull(), "is missing expected")
    )


def distinct_examples(entries: DataFrame) -> DataFrame:
    """Valid entries, the first of each distinct input."""
    valid = entries.filter(entry_problem(F.col("entry")).isNull()).select(
        "draft_id", "seq", "labels", "key_fields",
        F.try_variant_get("entry", "$.input", "string").alias("input"),
        F.to_json(_at(F.col("entry"), "$.expected")).alias("expected_json"),
    )
    return keep_first(valid, ["draft_id", "input"], ["seq"]).select(
        "draft_id", "seq", "labels", "key_fields", "input",
        F.parse_json("expected_json").alias("expected"),
    )


def _draft_examples(doc: Column, labels: Column, key_fields: Column) -> Column:
    """What the examples of a draft amount to: broken entries, and counts over the distinct valid ones.

    A draft is one output of a model, so its examples stay an array in its row and nothing is
    shuffled.
    """
    def described(entry: Column, i: Column) -> Column:
        return F.struct(
            i.alias("seq"), entry_problem(entry).alias("problem"),
            json_string(_at(entry, "$.input")).alias("input"), _at(entry, "$.expected").alias("expected"))

    def lacks(e: Column) -> Column:
        own = F.map_keys(F.try_variant_get(e["expected"], "$", "map<string,variant>"))
        return F.coalesce(
            ~_is(e["expected"], "{") | F.exists(key_fields, lambda f: ~F.array_contains(own, f)), F.lit(True))

    def counted(each: Column, kept: Column) -> Column:
        astray = F.filter(kept, lambda e: is_off_label(e["expected"], labels))
        return F.struct(
            F.filter(each, lambda e: e["problem"].isNotNull()).alias("broken"), F.size(kept).alias("n"),
            F.when(key_fields.isNotNull(), F.size(F.filter(kept, lacks))).alias("n_lacking"),
            F.size(F.filter(kept, lambda e: json_number(e["expected"]).isNull())).alias("n_not_number"),
            F.slice(F.array_distinct(F.transform(astray, lambda e: F.to_json(e["expected"]))), 1, 5).alias("off_label"))

    def first_of_each(each: Column) -> Column:
        valid = F.filter(each, lambda e: e["problem"].isNull())
        inputs = F.transform(valid, lambda e: e["input"])
        return bind(F.struct(valid.alias("valid"), inputs.alias("inputs")), lambda v: bind(
            F.filter(v["valid"], lambda e, i: F.array_position(v["inputs"], e["input"]) == i + 1),
            lambda kept: counted(each, kept)))

    entries = F.try_variant_get(doc, "$.examples", "array<variant>")
    return bind(F.transform(entries, described), first_of_each)


def validate_drafts(drafts: DataFrame) -> DataFrame:
    """Problems of drafted packs (V6): ``(draft_id, place, message)``; one pass, no shuffle."""
    doc = F.col("draft")
    scorer, params = json_string(_at(doc, "$.scorer")), _at(doc, "$.scorer_params")
    prompt, listed = json_string(_at(doc, "$.prompt")), _at(doc, "$.examples")
    facts = drafts.select("draft_id", "ok", "error", "draft", *draft_facts(doc))
    told = facts.withColumn("_e", _draft_examples(doc, F.col("labels"), F.col("key_fields")))
    joined = told.select(*facts.columns, "_e.*")
    n = F.coalesce("n", F.lit(0))
    unnamed = missing_labels(F.col("labels"), prompt)
    known = F.coalesce(scorer.isin(*scorer_names()), F.lit(False))
    tolerance = json_number(_at(params, "$.tolerance"))

    def fit(name: str, bad: Column, message) -> Column:
        return F.when(known & (scorer == name) & bad, message)

    rules = _rules(
        F.when(F.coalesce(kebab(json_string(_at(doc, "$.name"))) == "", F.lit(True)),
               '"name" must be a non-empty string'),
        _nonblank(_at(doc, "$.type"), "type"),
        F.when(~known, f'"scorer" must be one of: {", ".join(scorer_names())}'),
        F.when(~F.coalesce(F.contains(prompt, F.lit("{{input}}")), F.lit(False)),
               '"prompt" must be a string containing the placeholder {{input}}'),
        F.when(~_is(listed, "["), '"examples" must be an array'),
        F.when(
            _is(listed, "[") & (n < MIN_DRAFT_EXAMPLES),
            F.concat(
                F.lit("only "), n.cast("string"),
                F.lit(f" distinct valid examples; propose at least {MIN_DRAFT_EXAMPLES}"),
            ),
        ),
        fit("exact-label", F.col("labels").isNull(),
            F.lit("scorer_params.labels must be a non-empty array of strings")),
        fit("exact-label", F.size("off_label") > 0,
            F.concat(F.lit("expected values not in the set of labels: "),
                     F.array_join("off_label", ", "))),
        fit("exact-label", F.size(unnamed) > 0,
            F.concat(F.lit("labels missing from the prompt: "), F.array_join(unnamed, ", "))),
        fit("field-f1", F.col("key_fields").isNull(),
            F.lit("scorer_params.key_fields must be a non-empty array of strings")),
        fit("field-f1", F.col("n_lacking") > 0,
            F.concat(F.col("n_lacking").cast("string"),
                     F.lit(" example(s) have an expected object missing a key field"))),
        fit("pattern", ~_string_array(_at(params, "$.patterns")),
            F.lit("scorer_params.patterns must be a non-empty array of strings")),
        fit("json-schema", ~_is(_at(params, "$.schema"), "{"),
            F.lit("scorer_params.schema must be an inline JSON Schema object")),
        fit("numeric-tolerance", tolerance.isNull() | (tolerance < 0),
            F.lit("scorer_params.tolerance must be a non-negative number")),
        fit("numeric-tolerance", F.col("n_not_number") > 0,
            F.lit("every expected value must be a number for numeric-tolerance")),
    )
    whole = (
        F.when(~F.coalesce("ok", F.lit(False)),
               F.array(F.concat(F.lit("the response must be a single JSON object; "),
                                F.coalesce("error", F.lit("no JSON value found")))))
        .when(doc.isNull(), F.array(F.lit("the response must be a JSON object")))
        .otherwise(rules)
    )
    of_draft = F.transform(whole, lambda m, i: F.struct(i.alias("place"), m.alias("message")))
    of_entries = F.transform("broken", lambda e: F.struct(
        (e["seq"] + 1000).alias("place"),
        F.concat(F.lit("examples["), e["seq"].cast("string"), F.lit("] "), e["problem"]).alias("message")))
    nothing = F.array().cast("array<struct<place:int,message:string>>")
    return joined.select("draft_id", F.inline(F.concat(of_draft, F.coalesce(of_entries, nothing))))


# Fixed value: what stands in for a prompt that cannot be used.
FALLBACK_PROMPT = "Replace this drafted prompt; it must contain {{input}}.\n\nInput:\n{{input}}"


def salvage_drafts(drafts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What can be kept of drafts (V7): pack rows with placeholders, distinct valid examples."""
    doc = F.col("draft")
    known = scorer_names()

    def text(path: str) -> Column:
        return json_string(_at(doc, path))

    def usable(value: Column, test: Callable[[Column], Column], fallback: str) -> Column:
        return F.when(F.coalesce(test(value), F.lit(False)), value).otherwise(fallback)

    params = _at(doc, "$.scorer_params")
    packs = drafts.filter(doc.isNotNull()).select(
        "draft_id",
        usable(kebab(text("$.name")), lambda v: v != "", "drafted-task").alias("name"),
        usable(js_trim(text("$.type")), lambda v: v != "", "unknown").alias("type"),
        usable(text("$.scorer"), lambda v: v.isin(*known), known[0]).alias("scorer"),
        F.when(_is(params, "{"), params).otherwise(F.parse_json(F.lit("{}"))).alias(
            "scorer_params"
        ),
        usable(
            text("$.prompt"), lambda v: F.contains(v, F.lit("{{input}}")), FALLBACK_PROMPT
        ).alias("prompt"),
    )
    return packs, distinct_examples(entries)


__all__ = [
    "check_expected", "distinct_examples", "group_index", "is_off_label", "parse_drafts",
    "salvage_drafts", "validate_drafts", "validate_examples", "validate_packs",
    "validate_params", "validate_templates",
]
