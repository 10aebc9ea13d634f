"""Scorers, gates, schema keywords and mixed-pack scoring."""

import json

import pytest
from pyspark.sql import functions as F

from gradelake.operators import schema_check, scorers, scoring
from gradelake.sources.packs import pack_columns


def scored(spark, outputs, build, expected=None):
    df = spark.createDataFrame(
        [(i, o, expected[i] if expected else None) for i, o in enumerate(outputs)],
        "i int, o string, e string",
    )
    return [r["r"] for r in df.select("i", build(F.col("o"), F.col("e")).alias("r")).orderBy("i").collect()]


def test_exact_label(spark):
    outputs = ["billing", " BILLING ", "The answer is billing", "bug report", "Feature  request", ""]
    expected = ["billing", "billing", "billing", "bug", "feature-request", "bug"]
    got = scored(spark, outputs, lambda o, e: scorers.exact_label(
        o, e, ["billing", "bug", "feature-request"],
        {"Bug Report": "bug", "feature request": "feature-request"}), expected)
    assert [g["score"] for g in got] == [1, 1, 0, 1, 1, 0]
    assert got[2]["details"]["resolved_label"] is None and got[2]["details"]["reason"]


def test_exact_label_rejects_bad_alias():
    with pytest.raises(ValueError, match="not a declared label"):
        scorers.label_table(["a"], {"x": "b"})


@pytest.mark.parametrize("output,expected,tolerance,mode,passed", [
    ("100", 100.0, 0, "absolute", True), ("$1,234.50", 1234.5, 0.01, "absolute", True),
    ("about 98", 100.0, 2, "absolute", True), ("97.9", 100.0, 2, "absolute", False),
    ("98", 100.0, 0.02, "relative", True), ("97", 100.0, 0.02, "relative", False),
    ("-98", -100.0, 0.02, "relative", True), ("none", 0.0, 5, "absolute", False),
])
def test_numeric_tolerance(spark, output, expected, tolerance, mode, passed):
    got = scored(spark, [output], lambda o, e: scorers.numeric_tolerance(o, F.lit(expected), tolerance, mode))
    assert got[0]["pass"] is passed


def test_pattern_modes(spark):
    text = ["listen 80;\nserver_name x;", "listen 80;", "nothing"]
    every = scored(spark, text, lambda o, e: scorers.pattern(o, ["listen 80", "server_name"]))
    some = scored(spark, text, lambda o, e: scorers.pattern(o, [r"^listen \d+;", "zzz"], "regex", "any"))
    assert [(g["score"], g["pass"]) for g in every] == [(1.0, True), (0.5, False), (0.0, False)]
    assert [g["pass"] for g in some] == [True, True, False]


def test_field_f1(spark):
    expected = json.dumps({"vendor": "Acme Corp", "total": 1234.5, "tags": ["A", "b"]})
    outputs = [
        'Sure: {"vendor": " acme  corp", "total": "$1,234.50", "tags": ["a", "B"]}',
        '{"vendor": "Acme Corp", "total": 1, "tags": ["a", "b"]}',
        '{"vendor": "Acme Corp", "tags": ["a", "b"]}',
        "[1]", "no", '{"vendor": null, "total": null, "tags": null}',
    ]
    got = scored(spark, outputs, lambda o, e: scorers.field_f1(
        o, F.parse_json(e), ["vendor", "total", "tags"]), [expected] * 6)
    assert [round(g["score"], 4) for g in got] == [1.0, 0.6667, 0.8, 0.0, 0.0, 0.0]
    assert [g["pass"] for g in got] == [True] + [False] * 5
    assert [f["status"] for f in got[2]["details"]["fields"]] == ["match", "missing", "match"]


def test_json_schema(spark):
    schema = {
        "type": "object", "required": ["name", "port"], "additionalProperties": False,
        "properties": {
            "name": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"},
            "port": {"type": "integer", "minimum": 1, "maximum": 65535},
            "level": {"enum": ["info", 1]},
            "nested": {"type": ["object", "null"], "properties": {"x/y": {"type": "boolean"}}},
        },
    }
    outputs = [
        '{"name": "ab", "port": 80, "level": 1.0, "nested": null}', '{"name": "A", "port": 80.5}',
        '{"port": 0, "level": "debug", "extra": 1, "more": 2}', '"x"', "text",
        '{"name": "ab", "port": 1, "nested": {"x/y": 3}}',
    ]
    got = scored(spark, outputs, lambda o, e: scorers.json_schema(o, schema))
    lists = [g["details"]["violations"] for g in got]
    assert lists[0] == [] and got[0]["pass"]
    assert lists[1] == ["/name must NOT have fewer than 2 characters",
                        '/name must match pattern "^[a-z]+$"', "/port must be integer"]
    assert lists[2] == ["(root) must have required property 'name'",
                        "(root) must NOT have additional properties",
                        "(root) must NOT have additional properties", "/port must be >= 1",
                        "/level must be equal to one of the allowed values"]
    assert lists[3] == ["(root) must be object"]
    assert lists[4] == ["output is not JSON: output contains no JSON object or array"]
    assert lists[5] == ["/nested/x~1y must be boolean"]


@pytest.mark.parametrize("schema, message", [
    ({"oneOf": []}, "oneOf must be a non-empty array"),
    ({"type": "text"}, "not a JSON type"),
    ({"properties": {"a": {"minLength": "two"}}}, "minLength at #/properties/a must be a whole number"),
    ({"items": [3]}, "the schema at #/items/0"),
    ({"$ref": "#/definitions/x"}, "points at nothing"),
    ({"$ref": "other.json"}, "does not point into the schema"),
    ({"properties": {"a": {"$ref": "#"}}}, "goes round in circles"),
])
def test_json_schema_that_makes_no_sense_fails_early(schema, message):
    with pytest.raises(ValueError, match=message):
        schema_check.compile_schema(schema)


LINES = {
    "type": "object",
    "definitions": {"line": {
        "type": "object", "required": ["sku"],
        "properties": {"qty": {"type": "integer", "exclusiveMinimum": 0, "maximum": 9}, "sku": {"maxLength": 2}},
    }},
    "properties": {
        "lines": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/definitions/line"}},
        "grid": {"items": {"items": {"type": "number"}}},
        "tags": {"uniqueItems": True, "items": {"type": "string"}},
        "things": {"uniqueItems": True, "contains": {"const": {"a": [1, "x"]}}},
        "pair": {"items": [{"type": "string"}, {"multipleOf": 0.5}], "additionalItems": False},
        "mode": {"anyOf": [{"const": "open"}, {"type": "integer", "multipleOf": 2}]},
        "one": {"oneOf": [{"minimum": 5}, {"maximum": 7}, {"type": "string"}]},
        "no": {"not": {"enum": [None, False]}},
        "both": {"allOf": [{"minLength": 2}, {"pattern": "^a"}]},
        "when": {"if": {"minimum": 10}, "then": {"multipleOf": 10}, "else": {"exclusiveMaximum": 5}},
        "named": {
            "propertyNames": {"maxLength": 3}, "patternProperties": {"^n": {"type": "number"}},
            "additionalProperties": {"type": "boolean"}, "minProperties": 1, "maxProperties": 3,
            "dependencies": {"a": ["b"], "b": {"required": ["nb"]}},
        },
    },
}


LINES_CASES = [
    ({"lines": [{"sku": "a", "qty": 3}]}, []),
    ({"lines": []}, ["/lines must NOT have fewer than 1 items"]),
    ({"lines": [{"sku": "a", "qty": 0}, {"qty": 2.5}, {"sku": "long", "qty": 10}, 7]}, [
        "/lines must NOT have more than 3 items", "/lines/0/qty must be > 0",
        "/lines/1 must have required property 'sku'", "/lines/1/qty must be integer",
        "/lines/2/qty must be <= 9", "/lines/2/sku must NOT have more than 2 characters", "/lines/3 must be object"]),
    ({"lines": {}}, ["/lines must be array"]),
    ({"grid": [[1, "x"], [2], ["y", [3]], "no array"]},
     ["/grid/0/1 must be number", "/grid/2/0 must be number", "/grid/2/1 must be number"]),
    ({"tags": ["x", "y", "x", "y"]}, ["/tags must NOT have duplicate items (items ## 3 and 1 are identical)"]),
    ({"things": [1, {"a": [1.0, "x"]}, 1.0, 2, 1]}, ["/things must NOT have duplicate items (items ## 2 and 4 are identical)"]),
    ({"things": [1, 2]}, ["/things/0 must be equal to constant", "/things/1 must be equal to constant",
                          "/things must contain at least 1 valid item(s)"]),
    ({"pair": [1, 0.75, 2]}, ["/pair must NOT have more than 2 items", "/pair/0 must be string",
                              "/pair/1 must be multiple of 0.5"]),
    ({"mode": "open"}, []), ({"mode": 4}, []),
    ({"mode": 3}, ["/mode must be equal to constant", "/mode must be multiple of 2", "/mode must match a schema in anyOf"]),
    ({"mode": "shut"}, ["/mode must be equal to constant", "/mode must be integer", "/mode must match a schema in anyOf"]),
    ({"one": 4}, []), ({"one": 8}, []),
    ({"one": 6}, ["/one must match exactly one schema in oneOf"]),
    ({"no": False}, ["/no must NOT be valid"]), ({"no": 0}, []),
    ({"both": "b"}, ["/both must NOT have fewer than 2 characters", '/both must match pattern "^a"']),
    ({"when": 15}, ["/when must be multiple of 10", '/when must match "then" schema']),
    ({"when": 6}, ["/when must be < 5", '/when must match "else" schema']), ({"when": 20}, []), ({"when": 2}, []),
    ({"named": {}}, ["/named must NOT have fewer than 1 properties"]),
    ({"named": {"n~/x": "t", "long": 1, "c": True, "d": False}}, [
        "/named must NOT have more than 3 properties", "/named must NOT have more than 3 characters",
        "/named property name must be valid", "/named must NOT have more than 3 characters",
        "/named property name must be valid", "/named/long must be boolean", "/named/n~0~1x must be number"]),
    ({"named": {"a": True}}, ["/named must have property b when property a is present"]),
    ({"named": {"b": True}}, ["/named must have required property 'nb'"]),
]


def test_json_schema_of_arrays_and_combinations(spark):
    texts = [json.dumps(value) for value, _ in LINES_CASES]
    got = scored(spark, texts, lambda o, e: scorers.json_schema(o, LINES))
    for (value, violations), found in zip(LINES_CASES, got):
        assert found["details"]["violations"] == violations, value
        assert found["pass"] == (not violations)


def test_registry():
    assert scorers.scorer_names() == [
        "exact-label", "field-f1", "json-schema", "numeric-tolerance", "pattern"]
    with pytest.raises(ValueError, match="already registered"):
        scorers.register_scorer("pattern", lambda o, e, p: o)
    with pytest.raises(ValueError, match="unknown scorer"):
        scorers.get_scorer("nope")


SPECS = [
    {"name": "p1", "scorer": "exact-label", "scorer_params": {"labels": ["yes", "no"], "aliases": {"y": "yes"}}},
    {"name": "p2", "scorer": "field-f1", "scorer_params": {"key_fields": ["a"]},
     "gates": [{"scorer": "pattern", "scorer_params": {"patterns": ["a"]}},
               {"scorer": "json-schema", "scorer_params": {"schema": {"type": "object", "required": ["b"]}}}]},
]


def packs_of(spark, specs):
    df = spark.createDataFrame([(json.dumps(s),) for s in specs], "s string")
    return pack_columns(df.select(F.parse_json("s").alias("manifest")))


def test_a_registered_scorer_reads_its_own_parameters(spark, monkeypatch):
    monkeypatch.setattr(scorers, "_REGISTRY", dict(scorers._REGISTRY))

    def word_count(output, expected, params):
        least = F.try_variant_get(params.own, "$.limits.least", "int")
        enough = F.size(F.split(output.text, " ")) >= least
        return scorers.record(enough.cast("double"), enough, reason=F.when(~enough, "too short"))

    scorers.register_scorer("word-count", word_count)
    specs = packs_of(spark, [{
        "name": f"p{n}", "type": "t", "scorer": "word-count", "scorer_params": {"limits": {"least": n}},
        "gates": [{"scorer": "word-count", "scorer_params": {"limits": {"least": 2}}}]} for n in (1, 4)])
    outputs = spark.createDataFrame(
        [(f"{p}{i}", p, 1, text) for p in ("p1", "p4") for i, text in enumerate(("one", "one two three", "a b c d"))],
        "unit_id string, pack string, example_id int, output string")
    examples = specs.select("pack", F.lit(1).alias("example_id"), F.parse_json(F.lit("null")).alias("expected"))
    got = {r["unit_id"]: (r["pass"], r["failed_gate"]) for r in scoring.score(outputs, examples, specs).collect()}
    assert got == {"p10": (False, "word-count"), "p11": (True, None), "p12": (True, None),
                   "p40": (False, "word-count"), "p41": (False, None), "p42": (True, None)}


def test_mixed_packs_with_gates(spark):
    outputs = spark.createDataFrame([
        (1, "p1", "1", "Y"), (2, "p1", "1", "no"), (3, "p2", "1", '{"a": 1, "b": 2}'),
        (4, "p2", "1", '{"a": 1}'), (5, "p2", "9", '{"a": 1}'), (6, "p2", "1", "{}"),
    ], "unit_id int, pack string, example_id string, output string")
    examples = spark.createDataFrame(
        [("p1", "1", '"yes"'), ("p2", "1", '{"a": "1"}')], "pack string, example_id string, e string"
    ).select("pack", "example_id", F.parse_json("e").alias("expected"))
    got = {r["unit_id"]: r for r in scoring.score(outputs, examples, packs_of(spark, SPECS)).collect()}
    assert [got[i]["score"] for i in range(1, 7)] == [1.0, 0.0, 1.0, 0.0, None, 0.0]
    assert [got[i]["failed_gate"] for i in range(1, 7)] == [None, None, None, "json-schema", None, "pattern"]
    assert "missing from the pack" in got[5]["failure_reason"]
    assert got[4]["details"]["primary"]["record"]["score"] == 1.0
    assert [g["name"] for g in got[6]["details"]["gates"]] == ["pattern", "json-schema"]


def test_unknown_scorer_fails_before_the_job(spark):
    with pytest.raises(ValueError, match="unknown scorer"):
        scoring.bind(packs_of(spark, [{"name": "x", "scorer": "vibes"}]))


def test_scores_do_not_depend_on_partitions(spark):
    outputs = spark.range(300).select(
        F.col("id").alias("unit_id"), F.lit("p2").alias("pack"), F.lit("1").alias("example_id"),
        F.format_string('x {"a": %d, "b": 1} y', F.col("id") % 3).alias("output"))
    examples = spark.createDataFrame([("p2", "1", '{"a": 1}')], "pack string, example_id string, e string"
        ).select("pack", "example_id", F.parse_json("e").alias("expected"))
    packs = packs_of(spark, SPECS)
    one, many = (
        sorted((r["unit_id"], r["score"], r["d"]) for r in scoring.score(outputs.repartition(n), examples, packs)
               .select("unit_id", "score", F.to_json("details").alias("d")).collect()) for n in (1, 8))
    assert one == many and sum(s for _, s, _ in one) == 100


@pytest.mark.parametrize("scorer, params, message", [
    ("numeric-tolerance", {"tolerance": -1}, "zero or positive"),
    ("pattern", {}, "non-empty array"),
    ("pattern", {"patterns": ["a"], "mode": "fuzzy"}, "must be one of"),
    ("pattern", {"patterns": ["("], "mode": "regex"}, "does not compile"),
    ("exact-label", {"labels": ["a"], "aliases": {"b": "c"}}, "not declared"),
])
def test_bad_packs_are_refused(spark, scorer, params, message):
    spec = {"name": "x", "scorer": scorer, "scorer_params": params}
    gate = {"name": "y", "scorer": "pattern", "scorer_params": {"patterns": ["a"]}, "gates": [spec]}
    for bad in (spec, gate):
        with pytest.raises(ValueError, match=message):
            scoring.bind(packs_of(spark, [*SPECS, bad]))


def test_any_number_of_schemas(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BRANCH_SCHEMAS", 2)
    specs = [{"name": f"s{i}", "scorer": "json-schema",
              "scorer_params": {"schema": {"type": "object", "required": [f"k\u00e9/{i}"]}}} for i in range(5)]
    rows = [(f"s{i}", "1", json.dumps({f"k\u00e9/{j}": 1})) for i in range(5) for j in range(5)] + [("none", "1", "x")]
    outputs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)],
                                    "unit_id int, pack string, example_id string, output string")
    examples = spark.createDataFrame([(f"s{i}", "1", "null") for i in range(5)],
                                     "pack string, example_id string, e string").select(
        "pack", "example_id", F.parse_json("e").alias("expected"))
    got = scoring.score(outputs, examples, packs_of(spark, [*specs, *SPECS])).collect()
    assert len(got) == 26
    scores = {(r["unit_id"] // 5, r["unit_id"] % 5): r["score"] for r in got if r["unit_id"] < 25}
    assert scores == {(i, j): float(i == j) for i in range(5) for j in range(5)}


@pytest.mark.parametrize("scorer, params, expected, message", [
    ("exact-label", {"labels": ["low", "12"]}, "12", "exact-label example has expected value 12, which is not in labels"),
    ("exact-label", {"labels": ["low"]}, '"high"', 'expected value "high", which is not in labels'),
    ("numeric-tolerance", {"tolerance": 1}, '"five"', 'expected value "five", which is not a finite number'),
    ("field-f1", {"key_fields": ["a"]}, "[1]", "but this scorer needs an object"),
])
def test_expected_values_that_do_not_fit_are_refused(spark, scorer, params, expected, message):
    spec = json.dumps({"name": "p", "type": "t", "scorer": scorer, "scorer_params": params})
    packs = pack_columns(spark.createDataFrame([(spec,)], "s string").select(F.parse_json("s").alias("manifest")))
    examples = spark.createDataFrame(
        [("p", 1, expected), ("p", 2, expected), ("other", 3, "5")], "pack string, example_id int, e string"
    ).select("pack", "example_id", F.parse_json("e").alias("expected"))
    outputs = spark.createDataFrame([("u", "other", 3, "5")], "unit_id string, pack string, example_id int, output string")
    with pytest.raises(ValueError) as found:
        scoring.score(outputs, examples, packs)
    assert message in str(found.value) and "more" not in str(found.value)
    # without the bad ones the rest is scored; a pack that is not there judges nothing
    assert scoring.score(outputs, examples.filter("example_id = 3"), packs).count() == 1


def test_keys_of_known_values_are_worked_out_once(spark):
    values = ["open", 'a"b', "é", "a\\b", "", None, True, False, 0, -0.0, 1.0, 1e-7, 2.5, -3, 12345678901234567890,
              {"a": [1, 2.0]}, [1, "x"]]
    got = spark.range(1).select(F.array(*map(schema_check._literal_key, values)), F.array(
        *[schema_check._key(schema_check._literal(v)) for v in values])).first()
    assert got[0] == got[1]
    plan = spark.range(1).select(F.col("id").cast("string").alias("o")).select(scorers.json_schema(
        F.col("o"), {"enum": ["open", 4, None, True]}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") == 1  # the output itself
