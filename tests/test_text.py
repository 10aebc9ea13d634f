"""Scalar functions: hand-made case tables."""

import pytest
from pyspark.sql import functions as F

from gradelake.functions import display, fit, predicates
from gradelake.functions import text as T


def rows(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def test_normalize_text(spark):
    cases = {
        "  Acme   Corp ": "acme corp",
        "A B　c\t\nd": "a b c d",
        "ＡＣＭＥ": "acme",
        "ﬁle": "file",
        "": "",
        "﻿x ": "x",
    }
    assert rows(spark, list(cases), T.normalize_text) == list(cases.values())
    assert [T.normalize_literal(c) for c in ("  Acme   Corp ", "ﬁle")] == ["acme corp", "file"]


@pytest.mark.parametrize("text,value", [
    ("$1,234.56", 1234.56), ("42%", 42.0), ("-$5", -5.0), ("$-5", -5.0), ("- 5", -5.0),
    ("gpt-4", -4.0), ("forty-two", None), ("Total: 7 of 9", 7.0), ("1,23", 1.0), ("3.", 3.0),
    ("１２３", 123.0), ("€ 1,000,000", 1000000.0), ("1234,567", 1234.0),
    ("abc - 12.50%", -12.5),
])
def test_parse_first_number(spark, text, value):
    found = rows(spark, [text], T.parse_first_number)[0]
    assert (found["value"] if found else None) == value


def test_scalar_key_compares_numbers_by_value(spark):
    keys = rows(spark, ["$1,234.50", "1234.5", " 1234.50 ", "1234.5 USD", "-0", "0"], T.scalar_key)
    assert keys[0] == keys[1] == keys[2] != keys[3]
    assert keys[4] == keys[5]


EXTRACT = [
    ('{"a":1}', '{"a":1}', False),
    ('```json\n{"a": {"b": "}"}}\n```', '{"a":{"b":"}"}}', True),
    ('list: [1, [2]] end', "[1,[2]]", True),
    ('{"a": "q\\"}"} tail', '{"a":"q\\"}"}', True),
    ('{"a":1} tail', '{"a":1}', True),
    ('"a {b}"', '"a {b}"', False),
    ("42", "42", False),
    ("null", "null", False),
    ("{'a': 1}", None, True),
    ('{bad} {"a":1}', None, True),
    ("[}]", None, True),
    ('{"a": [1', None, True),
    ("01", None, False),
    ("nothing", None, False),
    ('{"a":1,"a":2}', '{"a":2}', False),
    (' {"a":1}﻿', '{"a":1}', False),
]


def test_extract_json(spark):
    found = rows(
        spark, [c[0] for c in EXTRACT],
        lambda c: F.struct(
            F.to_json(T.extract_json(c)["value"]).alias("v"),
            T.extract_json(c)["extraction_needed"].alias("n"),
        ),
    )
    assert [(f["v"], f["n"]) for f in found] == [(v, n) for _, v, n in EXTRACT]


def test_extract_json_messages(spark):
    texts = ["see {1", "see [x]", "plain"]
    assert rows(spark, texts, lambda c: T.extract_json(c)["error"]) == [
        "output contains an unclosed object starting at character 4",
        "balanced candidate at character 4 is not valid JSON",
        "output contains no JSON object or array",
    ]


def test_extract_json_of_a_long_output(spark):
    text = "x" * 300_000 + '{"a":"' + "y\\\"" * 300_000 + '","b":[' + "1," * 50_000 + "1]} z"
    found = rows(spark, [text], lambda c: F.size(
        F.try_variant_get(T.extract_json(c)["value"], "$.b", "array<int>")))
    assert found == [50_001]


@pytest.mark.parametrize("left,right,equal", [
    ('"Acme  Corp"', '"acme corp"', True), ('"$5"', "5", True), ("1", "1.0", True),
    ("true", '"true"', False), ("null", "null", True), ("null", '""', False),
    ('[1,"A"]', '["1","a"]', True), ("[1,2]", "[2,1]", False), ("[1]", "1", False),
    ('{"a":1,"b":{"c":"X"}}', '{"b":{"c":"x "},"a":"1"}', True),
    ('{"a":1}', '{"A":1}', False), ('{"a":[]}', '{"a":{}}', False),
    ('{"a":"b:c"}', '{"a":"B:C"}', True), ('["[1]"]', "[[1]]", False), ('[",",1]', '[",","1"]', True),
])
def test_fields_equal(spark, left, right, equal):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    got = df.select(T.fields_equal(F.parse_json("l"), F.parse_json("r")).alias("x")).first()["x"]
    assert got is equal


def test_missing_expected_never_matches(spark):
    df = spark.createDataFrame([("1", None)], "l string, r string")
    assert df.select(T.fields_equal(F.parse_json("l"), F.parse_json("r"))).first()[0] is False


def test_error_message(spark):
    cases = {'{"error": "no"}': "no", '{"error": 5}': '{"error": 5}', "  ": "empty error response",
             " bad gateway ": "bad gateway", '{"error": "a"} x': '{"error": "a"} x'}
    assert rows(spark, list(cases), T.error_message) == list(cases.values())


def test_kebab_and_paths(spark):
    assert rows(spark, ["My Task!", "--", "A_b  c"], T.kebab) == ["my-task", "", "a-b-c"]
    path = rows(spark, ["gem:1b/x"], lambda c: predicates.output_path(c, F.lit("00 1"), F.lit(2)))
    assert path == ["outputs/gem-1b-x/00-1-rep2.txt"]


def test_oom_and_backend(spark):
    texts = ["CUDA error", "ran Out Of Memory", "bloom", "requires more memory", "timeout"]
    assert rows(spark, texts, predicates.is_oom_suspect) == [True, True, False, True, False]
    kinds = rows(spark, ["ollama 1", "rapid-mlx 2", "anthropic x"], predicates.backend_kind)
    assert kinds == ["ollama", "rapid-mlx", "anthropic"]


def test_prompt_is_literal(spark):
    out = rows(spark, ["$& {{input}}"], lambda c: predicates.render_prompt(F.lit("a {{input}} b {{input}}"), c))
    assert out == ["a $& {{input}} b $& {{input}}"]


def info(**kw):
    return {"general.architecture": "m", **{f"m.{k.replace('__', '.')}": v for k, v in kw.items()}}


def test_architecture_and_fit(spark):
    full = info(block_count="26", attention__head_count_kv="1", attention__head_count="4",
                attention__key_length="256", attention__value_length="256", context_length="32768")
    derived = info(block_count="26", attention__head_count="4", embedding_length="1024",
                   context_length="10")
    broken = info(block_count="-1", attention__head_count="4", embedding_length="8", context_length="1")
    found = rows(spark, [full, derived, broken, {}], fit.architecture_from_info, "map<string,string>")
    assert found[0]["kv_head_count"] == 1 and found[0]["key_length"] == 256
    assert found[1]["kv_head_count"] == 4 and found[1]["value_length"] == 256
    assert found[2] is None and found[3] is None
    kv = rows(spark, [full], lambda c: fit.kv_cache_mib(fit.architecture_from_info(c), F.lit(2048)),
              "map<string,string>")
    assert kv == [52.0]

    def verdict(free):
        return lambda c: fit.predict_fit(
            F.lit(1048576 * 1000), fit.architecture_from_info(c), F.lit(2048), F.lit(free))

    fits, tight = (rows(spark, [full], verdict(f), "map<string,string>")[0] for f in (4000.0, 2000.0))
    assert (fits["verdict"], tight["verdict"]) == ("fits", "does-not-fit")
    assert fits["predicted_peak_mib"] == 2076.0
    assert rows(spark, [{}], verdict(4000.0), "map<string,string>")[0]["verdict"] == "unknown"
    assert rows(spark, [full], verdict(None), "map<string,string>")[0]["verdict"] == "unknown"


def test_display(spark):
    df = spark.createDataFrame([(0.8333, 0.75, 1.0), (1.0, 1.0, 1.0), (None, None, None)],
                               "v double, l double, h double")
    got = df.select(display.with_spread(F.col("v"), F.col("l"), F.col("h"), display.score)).collect()
    assert [r[0] for r in got] == ["0.833 (0.750..1.000)", "1.000", "-"]
