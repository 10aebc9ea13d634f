"""Scorers and scalar functions over documents, events, orders and conversations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions import predicates
from gradelake.functions import text as T
from gradelake.operators import scorers as S
from gradelake.operators import scoring
from gradelake.operators.joins import scoring_input
from gradelake.plans.report import rescored_units
from gradelake.sources.journal import verify_scores
from workload.registry import Tables, cte, query, view

# Scalar functions --------------------------------------------------------------


@query("f1_normalize_text", r"""
SELECT doc_id, md5(n) AS digest, CAST(length(n) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x{0B}\x{A0}]+', ' ', 'g')) AS n
  FROM documents)""")
def f1(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", T.normalize_text(F.col("text")).alias("n")).select(
        "doc_id", F.md5("n").alias("digest"), F.length("n").cast("bigint").alias("n_chars")
    )


@query("f2_js_trim", r"""
SELECT doc_id, md5(regexp_replace(chr(160) || chr(9) || text || chr(10) || chr(8195),
  '^[\s\x{A0}\x{2003}]+|[\s\x{A0}\x{2003}]+$', '', 'g')) AS digest FROM documents""")
def f2(t: Tables) -> DataFrame:
    padded = F.concat(
        F.char(F.lit(160)), F.lit("\t"), F.col("text"), F.lit("\n"), F.lit(chr(8195))
    )
    return t.spread("documents").select("doc_id", F.md5(T.js_trim(padded)).alias("digest"))


NUMBER_SQL = (
    r"-?[$€£¥]?[\s\x{A0}]?-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?%?"
    r"|-?[$€£¥]?[\s\x{A0}]?-?[0-9]+(?:\.[0-9]+)?%?"
)


@query("f3_parse_first_number", rf"""
SELECT doc_id, nullif(raw, '') AS raw, CASE WHEN raw <> '' THEN
  CASE WHEN contains(raw, '-') THEN -v ELSE v END END AS value
FROM (SELECT doc_id, raw, TRY_CAST(regexp_replace(raw, '[^0-9.]', '', 'g') AS DOUBLE) AS v
  FROM (SELECT doc_id, regexp_extract(text, '{NUMBER_SQL}') AS raw FROM documents))""")
def f3(t: Tables) -> DataFrame:
    found = T.parse_first_number(F.col("text"))
    return t.spread("documents").select("doc_id", found.alias("n")).select("doc_id", "n.raw", "n.value")


AMOUNTS = """CASE o_orderkey % 4 WHEN 0 THEN concat('$', CAST(o_totalprice AS STRING))
 WHEN 1 THEN concat(' ', CAST(o_totalprice AS STRING), '% ')
 WHEN 2 THEN concat('about ', CAST(o_totalprice AS STRING))
 ELSE upper(o_orderpriority) END"""
view("amounts", "orders", "o_orderkey", "o_totalprice", f"{AMOUNTS} AS amount")


@query("f4_normalize_scalar", f"""WITH {cte('amounts')}
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'number' ELSE 'text' END AS kind,
  CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice END AS number,
  CASE WHEN o_orderkey % 4 >= 2 THEN lower(amount) END AS text FROM amounts""")
def f4(t: Tables) -> DataFrame:
    key = t.spread("amounts").select("o_orderkey", T.scalar_key(F.col("amount")).alias("k"))
    is_number, rest = F.col("k").startswith("n:"), F.substring("k", 3, 1 << 30)
    return key.select(
        "o_orderkey", F.when(is_number, "number").otherwise("text").alias("kind"),
        F.when(is_number, rest.cast("double")).alias("number"),
        F.when(~is_number, rest).alias("text"),
    )


view(
    "answers", "events", "event_id", "event_type", "user_id", "value", "props",
    """CASE event_type
 WHEN 'click' THEN concat('Here is the result: ', props, ' done.')
 WHEN 'view' THEN props
 WHEN 'purchase' THEN concat('```json', chr(10), '{"a": ', props, ', "s": "}{"}', chr(10), '```')
 WHEN 'signup' THEN concat('broken {', props, ' tail')
 ELSE 'no answer' END AS output""",
)


@query("f5_extract_json", f"""WITH {cte('answers')}
SELECT event_id, event_type IN ('click', 'view', 'purchase') AS ok,
  event_type NOT IN ('view', 'error') AS extraction_needed,
  CASE WHEN event_type IN ('click', 'view', 'purchase')
    THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE event_type WHEN 'signup' THEN 'output contains an unclosed object starting at character 7'
    WHEN 'error' THEN 'output contains no JSON object or array' END AS error
FROM answers""")
def f5(t: Tables) -> DataFrame:
    found = t.spread("answers").select("event_id", T.extract_json(F.col("output")).alias("x"))
    k = F.coalesce(
        F.try_variant_get("x.value", "$.k", "bigint"),
        F.try_variant_get("x.value", "$.a.k", "bigint"),
    )
    return found.select(
        "event_id", "x.ok", "x.extraction_needed", k.alias("k"), "x.error"
    )


view(
    "pairs", "events", "event_id", "user_id", "event_type",
    """concat('{"l": [', CAST(user_id AS STRING), ', "', upper(event_type), '", {"z": null, "a": 1}]}')
 AS left_json""",
    """concat('{"l": ["', CAST(user_id + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS STRING),
 '", " ', event_type, '", {"a": "1.0", "z": ',
 CASE WHEN event_type = 'click' THEN 'false' ELSE 'null' END, '}]}') AS right_json""",
)


@query("f6_fields_equal", f"""WITH {cte('pairs')}
SELECT event_id, event_type NOT IN ('view', 'click') AS equal FROM pairs""")
def f6(t: Tables) -> DataFrame:
    return t.spread("pairs").select(
        "event_id",
        T.fields_equal(F.try_parse_json("left_json"), F.try_parse_json("right_json")).alias(
            "equal"
        ),
    )


@query("f12_kebab", r"""
SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'),
  '^-+|-+$', '', 'g') AS name FROM pages""")
def f12(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", T.kebab(F.col("url")).alias("name"))


@query("f14_utc_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def f14(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return t["orders"].select("o_orderkey", T.utc_date(ms).alias("day"))


@query("f15_error_message", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'model ' || user_id || ' not found'
  WHEN 'click' THEN 'empty error response' WHEN 'view' THEN 'bad gateway ' || user_id
  ELSE props END AS message FROM events""")
def f15(t: Tables) -> DataFrame:
    body = F.expr("""CASE event_type
      WHEN 'error' THEN concat('{"error": "model ', user_id, ' not found"}')
      WHEN 'click' THEN '  ' WHEN 'view' THEN concat(' bad gateway ', user_id, '\\n')
      ELSE props END""")
    return t.spread("events").select("event_id", T.error_message(body).alias("message"))


@query("p1_render_prompt", """
SELECT doc_id, md5('Classify: ' || text || chr(10) || 'Again: ' || text) AS digest
FROM documents""")
def p1(t: Tables) -> DataFrame:
    template = F.lit("Classify: {{input}}\nAgain: {{input}}")
    prompt = predicates.render_prompt(template, F.col("text"))
    return t["documents"].select("doc_id", F.md5(prompt).alias("digest"))


@query("p4_oom_suspect", r"""
SELECT doc_id, regexp_matches(text, '(?i)out of memory|\boom\b|cuda|vram|unable to allocate|requires more (system )?memory|resource limitations|failed to load|crashed mid-generation|ended without a done line')
  AS suspect FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN text || ' Failed to LOAD model'
  WHEN lang = 'de' THEN text || ' bloom' ELSE text END AS text FROM documents)""")
def p4(t: Tables) -> DataFrame:
    text = F.expr(
        "CASE WHEN lang = 'en' THEN concat(text, ' Failed to LOAD model') "
        "WHEN lang = 'de' THEN concat(text, ' bloom') ELSE text END"
    )
    return t["documents"].select("doc_id", predicates.is_oom_suspect(text).alias("suspect"))


@query("p5_transport_error", """
SELECT page_id, contains(CASE WHEN page_id % 3 = 0 THEN 'cannot reach Ollama at ' || url ELSE url
  END, 'cannot reach Ollama') AS transport FROM pages""")
def p5(t: Tables) -> DataFrame:
    message = F.expr(
        "CASE WHEN page_id % 3 = 0 THEN concat('cannot reach Ollama at ', url) ELSE url END"
    )
    return t["pages"].select("page_id", predicates.is_transport_error(message).alias("transport"))


@query("p12_backend_kind", f"""WITH {cte('runs')}
SELECT run_id, CASE n_nationkey % 3 WHEN 0 THEN 'ollama' WHEN 1 THEN 'rapid-mlx'
  ELSE 'anthropic' END AS backend FROM runs""")
def p12(t: Tables) -> DataFrame:
    return t["runs"].select(
        "run_id", predicates.backend_kind(F.col("backend_version")).alias("backend")
    )


@query("p13_provenance_label", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 4 <> 1 THEN 'pack drafted by ' || lang
  || ' from ' || source || ' on 2026-01-01; expected values are model-authored and unreviewed, so quality measures '
  || 'agreement with the drafter (set provenance.reviewed in task.yaml after checking)' END AS label FROM documents""")
def p13(t: Tables) -> DataFrame:
    origin = F.when(
        F.col("doc_id") % 4 != 0,
        F.struct(
            F.col("lang").alias("drafted_by"), F.col("source").alias("source"),
            F.lit("2026-01-01").alias("drafted_at"),
            (F.col("doc_id") % 4 == 1).alias("reviewed"),
        ),
    )
    return t["documents"].select("doc_id", predicates.provenance_label(origin).alias("label"))


@query("p17_output_path", r"""
SELECT page_id, 'outputs/' || regexp_replace(url, '[^a-zA-Z0-9._-]', '-', 'g') || '/'
  || page_id || '-rep1.txt' AS path FROM pages""")
def p17(t: Tables) -> DataFrame:
    path = predicates.output_path(F.col("url"), F.col("page_id").cast("string"), F.lit(1))
    return t["pages"].select("page_id", path.alias("path"))


# Scorers -------------------------------------------------------------------------

LABELS = ["en", "de", "fr", "es"]
ALIASES = {"english": "en", "Deutsch": "de", "es": "fr"}
view(
    "labelled", "documents", "doc_id", "lang",
    """CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN concat('  ', lang, chr(9))
 WHEN 2 THEN CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'DEUTSCH' ELSE lang END
 WHEN 3 THEN concat('lang: ', lang) ELSE 'en' END AS output""",
)


@query("c1_exact_label", f"""WITH {cte('labelled')},
r AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'fr' ELSE lang END AS truth,
  CASE trim(replace(lower(output), chr(9), ' ')) WHEN 'en' THEN 'en' WHEN 'english' THEN 'en'
    WHEN 'de' THEN 'de' WHEN 'deutsch' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'fr' END
  AS resolved_label FROM labelled)
SELECT doc_id, resolved_label, CASE WHEN resolved_label = truth THEN 1.0 ELSE 0.0 END::DOUBLE
  AS score, coalesce(resolved_label = truth, false) AS pass FROM r""")
def c1(t: Tables) -> DataFrame:
    scored = S.exact_label(F.col("output"), F.col("lang"), LABELS, ALIASES)
    return t["labelled"].select("doc_id", scored.alias("r")).select(
        "doc_id", "r.details.resolved_label", "r.score", "r.pass"
    )


view(
    "extractions", "events", "event_id", "event_type",
    """CASE event_type WHEN 'error' THEN 'I cannot tell' WHEN 'view' THEN
 concat('Result: {"k": ', CAST(user_id AS STRING), ', "type": "VIEW"} ok')
 ELSE concat('{"k": "', CAST(user_id + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS STRING),
 '", "type": " ', event_type, '", "amount": "$', CAST(value AS STRING), '"}') END AS output""",
    """concat('{"k": ', CAST(user_id AS STRING), ', "type": "', upper(event_type),
 '", "amount": ', CAST(value AS STRING), '}') AS expected""",
)


@query("c2_field_f1", f"""WITH {cte('extractions')},
n AS (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 2 WHEN 'click' THEN 2
    ELSE 3 END AS tp,
  CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS fp FROM extractions),
m AS (SELECT event_id, tp, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p,
  tp::DOUBLE / 3 AS r FROM n)
SELECT event_id, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS score, tp = 3 AS pass
FROM m""")
def c2(t: Tables) -> DataFrame:
    scored = S.field_f1(F.col("output"), F.try_parse_json("expected"), ["k", "type", "amount"])
    return t.spread("extractions").select("event_id", scored.alias("r")).select(
        "event_id", F.round("r.details.precision", 6).alias("precision"),
        F.round("r.details.recall", 6).alias("recall"), F.round("r.score", 6).alias("score"),
        "r.pass",
    )


SCHEMA = {
    "type": "object", "required": ["k"], "additionalProperties": False,
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}},
}


@query("c3_json_schema", f"""WITH {cte('answers')},
k AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM answers)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND k BETWEEN 10 AND 90 THEN 1.0
  ELSE 0.0 END::DOUBLE AS score, event_type IN ('click', 'view') AND k BETWEEN 10 AND 90 AS pass,
  CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k > 90 THEN '/k must be <= 90'
      WHEN k < 10 THEN '/k must be >= 10' ELSE '' END
    WHEN event_type = 'purchase' THEN '(root) must have required property ''k'';' ||
      '(root) must NOT have additional properties;(root) must NOT have additional properties'
    WHEN event_type = 'signup' THEN
      'output is not JSON: output contains an unclosed object starting at character 7'
    ELSE 'output is not JSON: output contains no JSON object or array' END AS violations FROM k""")
def c3(t: Tables) -> DataFrame:
    scored = S.json_schema(F.col("output"), SCHEMA)
    return t.spread("answers").select("event_id", scored.alias("r")).select(
        "event_id", "r.score", "r.pass",
        F.array_join("r.details.violations", ";").alias("violations"),
    )


LINES_SCHEMA = {
    "type": "object", "required": ["lines"],
    "properties": {
        "lines": {
            "type": "array", "minItems": 1, "maxItems": 3,
            "items": {
                "type": "object", "required": ["sku"],
                "properties": {
                    "qty": {"type": "integer", "exclusiveMinimum": 0, "maximum": 30},
                    "sku": {"type": "string", "maxLength": 2},
                },
            },
        },
        "tags": {"items": {"type": "string"}, "uniqueItems": True},
        "mode": {"anyOf": [{"const": "open"}, {"type": "integer", "multipleOf": 2}]},
    },
}

# Orders of up to four lines, made of the number in the properties.
view("line_texts", "events", "event_id",
     "CAST(replace(replace(props, '{\"k\": ', ''), '}', '') AS BIGINT) AS k")


@query("c3_array_schema", f"""WITH {cte('line_texts')},
lines AS (SELECT event_id, k, event_id % 5 AS n FROM line_texts),
told AS (SELECT event_id, list_concat(
  CASE n WHEN 0 THEN ['/lines must NOT have fewer than 1 items']
    WHEN 4 THEN ['/lines must NOT have more than 3 items'] ELSE [] END,
  flatten([list_concat(
    CASE WHEN (k + i) % 4 = 0 THEN ['/lines/' || i || ' must have required property ''sku'''] ELSE [] END,
    CASE WHEN (k + 7 * i) % 40 - 5 > 30 THEN ['/lines/' || i || '/qty must be <= 30']
      WHEN (k + 7 * i) % 40 - 5 <= 0 THEN ['/lines/' || i || '/qty must be > 0'] ELSE [] END,
    CASE WHEN (k + i) % 4 = 3 THEN ['/lines/' || i || '/sku must NOT have more than 2 characters'] ELSE [] END)
    for i in range(0, n)]),
  CASE WHEN k % 3 = 0 THEN ['/tags must NOT have duplicate items (items ## 2 and 0 are identical)'] ELSE [] END,
  CASE k % 4 WHEN 1 THEN ['/mode must be equal to constant', '/mode must be multiple of 2',
    '/mode must match a schema in anyOf'] WHEN 3 THEN ['/mode must be equal to constant',
    '/mode must be integer', '/mode must match a schema in anyOf'] ELSE [] END) AS violations FROM lines)
SELECT event_id, array_to_string(violations, ';') AS violations, len(violations) = 0 AS pass,
  CASE WHEN len(violations) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM told""")
def c3_arrays(t: Tables) -> DataFrame:
    text = F.expr("""concat('{"lines": [', array_join(transform(
      filter(sequence(0, 4), i -> i < event_id % 5),
      i -> concat('{"qty": ', (k + 7 * i) % 40 - 5, CASE (k + i) % 4 WHEN 0 THEN '' WHEN 3 THEN ', "sku": "abc"'
        ELSE ', "sku": "ab"' END, '}')), ', '), '], "tags": ["x", "y", "', CASE WHEN k % 3 = 0 THEN 'x' ELSE 'z' END,
      '"], "mode": ', CASE k % 4 WHEN 0 THEN '"open"' WHEN 1 THEN '3' WHEN 2 THEN '4' ELSE '"shut"' END, '}')""")
    scored = S.json_schema(text, LINES_SCHEMA)
    return t.spread("line_texts").select("event_id", scored.alias("r")).select(
        "event_id", F.array_join("r.details.violations", ";").alias("violations"), "r.pass", "r.score"
    )


PATTERNS = ["the", "http", "License", "ing "]


@query("c4_pattern_contains", """
SELECT doc_id, n AS matched_count, n / 4.0::DOUBLE AS score, n > 0 AS pass FROM (
  SELECT doc_id, contains(text, 'the')::INT + contains(text, 'http')::INT
    + contains(text, 'License')::INT + contains(text, 'ing ')::INT AS n FROM documents)""")
def c4(t: Tables) -> DataFrame:
    scored = S.pattern(F.col("text"), PATTERNS, "contains", "any")
    return t["documents"].select("doc_id", scored.alias("r")).select(
        "doc_id", "r.details.matched_count", "r.score", "r.pass"
    )


@query("c4_pattern_regex", r"""
SELECT doc_id, n AS matched_count, n / 2.0::DOUBLE AS score, n = 2 AS pass FROM (
  SELECT doc_id, regexp_matches(text, '[0-9]{3}')::INT
    + regexp_matches(text, '[A-Z][a-z]+ing\b')::INT AS n FROM documents)""")
def c4_regex(t: Tables) -> DataFrame:
    scored = S.pattern(F.col("text"), ["[0-9]{3}", r"[A-Z][a-z]+ing\b"], "regex", "all")
    return t["documents"].select("doc_id", scored.alias("r")).select(
        "doc_id", "r.details.matched_count", "r.score", "r.pass"
    )


@query("c5_numeric_tolerance", """
SELECT o_orderkey, o_totalprice AS actual, abs(o_totalprice - e) <= 0.02::DOUBLE * abs(e) AS pass
FROM (SELECT o_orderkey, o_totalprice,
  o_totalprice * (1 + (o_orderkey % 9) / 200.0::DOUBLE) AS e FROM orders)""")
def c5(t: Tables) -> DataFrame:
    shown = F.concat(
        F.lit("The total is $"), F.format_number("o_totalprice", 2), F.lit(" (2 items)")
    )
    expected = F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 9) / F.lit(200.0))
    scored = S.numeric_tolerance(shown, expected, 0.02, "relative")
    return t.spread("orders").select("o_orderkey", scored.alias("r")).select(
        "o_orderkey", "r.details.actual", "r.pass"
    )


@query("c6_with_gates", """
SELECT doc_id, CASE WHEN gate IS NULL THEN n / 2.0::DOUBLE ELSE 0.0 END::DOUBLE AS score,
  gate IS NULL AND n = 2 AS pass, gate AS failed_gate, n / 2.0::DOUBLE AS primary_score
FROM (SELECT doc_id, contains(text, 'the')::INT + contains(text, 'ing')::INT AS n,
  CASE WHEN NOT contains(text, 'e') THEN 'pattern' WHEN lang <> 'en' THEN 'exact-label' END
  AS gate FROM documents)""")
def c6(t: Tables) -> DataFrame:
    text = F.col("text")
    scored = S.with_gates(
        ("pattern", S.pattern(text, ["the", "ing"])),
        [
            ("pattern", S.pattern(text, ["e"])),
            ("exact-label", S.exact_label(F.col("lang"), F.lit("en"), LABELS)),
        ],
    )
    return t["documents"].select("doc_id", scored.alias("r")).select(
        "doc_id", "r.score", "r.pass", "r.details.failed_gate",
        F.col("r.details.primary.record.score").alias("primary_score"),
    )


def _spec(pack: str, scorer: str, params: dict, gates: list | None = None) -> str:
    return json.dumps({
        "name": pack, "type": "demo", "scorer": scorer, "scorer_params": params,
        "gates": gates or [],
    })


SPECS = [
    _spec("click", "exact-label", {"labels": ["low", "high"], "aliases": {"small": "low"}}),
    _spec("view", "field-f1", {"key_fields": ["k", "type"]}),
    _spec("purchase", "numeric-tolerance", {"tolerance": 5}),
    _spec("signup", "pattern", {"patterns": ["k", "7"], "match": "any"}),
    _spec(
        "error", "json-schema", {"schema": SCHEMA},
        [{"scorer": "pattern", "scorer_params": {"patterns": ["5", "1"], "match": "any"}}],
    ),
]


def specs(t: Tables) -> DataFrame:
    """The five pack specs, one per event type."""
    from gradelake.sources.packs import pack_columns

    return pack_columns(t.spark.createDataFrame([(s,) for s in SPECS], "spec string").select(
        F.parse_json("spec").alias("manifest")
    ))


view(
    "event_outputs", "events", "event_id AS unit_id", "event_type AS pack",
    "user_id % 40 AS example_id", "props", "user_id",
    """CASE event_type
 WHEN 'click' THEN CASE WHEN value > 100 THEN ' HIGH ' WHEN value > 20 THEN 'small' ELSE 'Low' END
 WHEN 'view' THEN concat('{"k": ', CAST(user_id % 40 AS STRING), ', "type": "x"}')
 WHEN 'purchase' THEN concat('about ', CAST(user_id % 50 AS STRING), ' units')
 ELSE props END AS output""",
)
view("example_keys", "events", "event_type AS pack", "user_id % 40 AS example_id")


def example_rows(t: Tables) -> DataFrame:
    """Examples of the packs; example 39 of each is left out on purpose."""
    keys = t["example_keys"].filter("example_id < 39").distinct()
    expected = F.expr("""CASE pack WHEN 'click' THEN '"low"'
      WHEN 'view' THEN concat('{"k": "', example_id, '", "type": "y"}')
      WHEN 'purchase' THEN CAST(example_id AS STRING) ELSE 'null' END""")
    return keys.select("pack", "example_id", F.parse_json(expected).alias("expected"))


SCORED = f"""{cte('event_outputs')},
k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM event_outputs),
raw AS (SELECT unit_id, pack, example_id, CASE pack
  WHEN 'click' THEN CASE WHEN trim(lower(output)) IN ('low', 'small') THEN 1.0 ELSE 0.0 END
  WHEN 'view' THEN 0.5
  WHEN 'purchase' THEN CASE WHEN abs(user_id % 50 - example_id) <= 5 THEN 1.0 ELSE 0.0 END
  WHEN 'signup' THEN (1 + contains(props, '7')::INT) / 2.0
  ELSE CASE WHEN k BETWEEN 10 AND 90 THEN 1.0 ELSE 0.0 END END::DOUBLE AS base,
  CASE WHEN pack = 'error' AND NOT (contains(props, '5') OR contains(props, '1'))
    THEN 'pattern' END AS failed_gate FROM k),
scored AS (SELECT unit_id, pack, example_id, CASE WHEN example_id < 39 THEN
  CASE WHEN failed_gate IS NULL THEN base ELSE 0.0 END END AS score,
  CASE WHEN example_id < 39 THEN failed_gate IS NULL AND CASE pack WHEN 'signup' THEN base > 0
    ELSE base = 1 END END AS pass,
  CASE WHEN example_id < 39 THEN failed_gate END AS failed_gate,
  CASE WHEN example_id = 39 THEN 'missing' END AS failure FROM raw)"""


@query("c7_score", f"WITH {SCORED} SELECT unit_id, round(score, 6) AS score, pass, failed_gate, "
       "failure FROM scored")
def c7(t: Tables) -> DataFrame:
    scored = scoring.score(
        t["event_outputs"].drop("props", "user_id"), example_rows(t), specs(t)
    )
    return scored.select(
        "unit_id", F.round("score", 6).alias("score"), "pass", "failed_gate",
        F.when(F.col("failure_reason").contains("is missing from the pack"), "missing").alias(
            "failure"
        ),
    )


# Joins on text tables ----------------------------------------------------------------

@query("j2_scoring_input", """
SELECT o.conv_id, o.turn, length(o.text) AS n_output, length(e.text) AS n_input,
  e.text IS NULL AS missing
FROM (SELECT * FROM conversations WHERE role = 'assistant') o
LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') e
  ON o.conv_id = e.conv_id AND o.turn - 1 = e.turn""")
def j2(t: Tables) -> DataFrame:
    turns = t["conversations"]
    outputs = turns.filter("role = 'assistant'").selectExpr(
        "conv_id AS pack", "turn - 1 AS example_id", "text AS output", "turn",
        "concat(conv_id, '-', turn) AS unit_id",
    )
    examples = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("pack"), F.col("turn").alias("example_id"),
        F.col("text").alias("expected"),
    )
    packs = turns.select(F.col("conv_id").alias("pack")).distinct()
    joined = scoring_input(outputs, examples, packs)
    return joined.select(
        F.col("pack").alias("conv_id"), "turn",
        F.length("output").cast("bigint").alias("n_output"),
        F.length("expected").cast("bigint").alias("n_input"),
        F.col("failure_reason").isNotNull().alias("missing"),
    )


def stored_scores(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the event outputs, some of them tampered with."""
    outputs = t["event_outputs"].drop("props", "user_id")
    fresh = scoring.score(outputs, example_rows(t), specs(t))
    tampered = F.when(F.col("unit_id") % 10 == 3, 0.25).otherwise(
        F.coalesce("score", F.lit(0.0))
    )
    stored = fresh.select(
        F.lit("r").alias("run_id"), "unit_id", "pack", "example_id",
        F.concat(F.lit("outputs/"), F.col("unit_id").cast("string")).alias("output_path"),
        tampered.alias("score"), F.coalesce("pass", F.lit(False)).alias("pass"), "failed_gate",
        F.to_json("details").alias("details"),
    )
    return stored, outputs, fresh


@query("j7_verify_export", f"""WITH {SCORED}
SELECT unit_id, CASE WHEN failure IS NOT NULL THEN 'missing example'
  WHEN unit_id % 10 = 3 AND score <> 0.25 THEN 'changed' ELSE '' END AS verdict FROM scored""")
def j7(t: Tables) -> DataFrame:
    stored, outputs, _ = stored_scores(t)
    checked = verify_scores(
        stored.drop("failed_gate"), outputs.select("unit_id", "output"), example_rows(t), specs(t)
    )
    text = F.col("mismatch")
    return checked.select(
        "unit_id",
        F.when(text.isNull(), "").when(text.contains("is missing from"), "missing example")
        .otherwise("changed").alias("verdict"),
    )


@query("r7_rescored_report", f"""WITH {SCORED}
SELECT r AS run_id, count(*) FILTER (WHERE ready) AS checked,
  count(*) FILTER (WHERE ready AND t AND score <> 0.25) AS changed,
  CASE WHEN r = 1 THEN 'drifted' WHEN count(*) FILTER (WHERE ready AND t AND score <> 0.25) > 0
    THEN 'changed' END AS note
FROM (SELECT *, unit_id % 3 AS r, failure IS NULL AND unit_id % 3 <> 1 AS ready,
  unit_id % 10 = 3 AS t FROM scored) GROUP BY r""")
def r7(t: Tables) -> DataFrame:
    stored, outputs, _ = stored_scores(t)
    units = stored.join(outputs.select("unit_id", "output"), "unit_id").withColumns({
        "run_id": F.col("unit_id") % 3, "status": F.lit("completed"),
    })
    matching = t["nation"].filter("n_nationkey < 3").select(
        F.col("n_nationkey").cast("bigint").alias("run_id"),
        (F.col("n_nationkey") != 1).alias("matches"),
    )
    _, notes = rescored_units(units, example_rows(t), specs(t), matching)
    kind = F.when(F.col("note").startswith("stored scores"), "drifted").when(
        F.col("note").isNotNull(), "changed"
    )
    return notes.select("run_id", "checked", "changed", kind.alias("note"))
