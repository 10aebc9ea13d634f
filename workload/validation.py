"""Validation jobs over events, documents, part and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.operators import aggregates as A
from gradelake.operators import sets as U
from gradelake.plans import validate as V
from gradelake.sources.packs import pack_columns, parse_example
from workload.registry import Tables, cte, query, view

view(
    "example_files", "events", "event_id", "event_type", "user_id",
    """CASE event_type
 WHEN 'click' THEN concat('{"input": "n', user_id, '", "expected": ', props, '}')
 WHEN 'view' THEN concat('{"input": "  ", "other": ', props, '}')
 WHEN 'purchase' THEN concat('[', props, ']')
 WHEN 'signup' THEN concat('{"replace_me": true, "input": ', props, '}')
 ELSE concat(props, '}') END AS value""",
)


@query("s1_examples", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'n' || user_id END AS input,
  CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 2 ELSE 1 END AS n_problems FROM events""")
def s1(t: Tables) -> DataFrame:
    return t.spread("example_files").select(
        "event_id", parse_example(F.col("value")).alias("e")
    ).select(
        "event_id", "e.input", F.try_variant_get("e.expected", "$.k", "bigint").alias("k"),
        F.size("e.problems").alias("n_problems"),
    )


V1_SQL = """
SELECT event_id, message FROM (SELECT event_id, unnest(CASE event_type WHEN 'click' THEN []
  WHEN 'view' THEN ['input must be a non-empty string', 'missing expected']
  WHEN 'purchase' THEN ['must be a JSON object'] WHEN 'signup' THEN ['placeholder example']
  ELSE ['not valid JSON'] END) AS message FROM events)"""


@query("v1_validate_examples", V1_SQL)
def v1(t: Tables) -> DataFrame:
    return V.validate_examples(t.spread("example_files")).select("event_id", "message")


@query("a18_problem_rollup", f"""
SELECT pack, CAST(i // 1000 AS BIGINT) AS page, any_value(n) AS problem_count,
  md5(string_agg(message, '|' ORDER BY i)) AS digest FROM (
  SELECT event_type AS pack, message, count(*) OVER (PARTITION BY event_type) AS n,
    row_number() OVER (PARTITION BY event_type ORDER BY v.event_id, message) - 1 AS i
  FROM ({V1_SQL}) v JOIN events e ON v.event_id = e.event_id) GROUP BY pack, i // 1000""")
def a18(t: Tables) -> DataFrame:
    problems = V.validate_examples(t.spread("example_files")).select(
        F.col("event_type").alias("pack"), F.col("event_id").alias("seq"), "message"
    )
    return A.problem_rollup(problems).select(
        "pack", F.col("page").cast("bigint").alias("page"), "problem_count",
        F.md5(F.array_join("problems", "|")).alias("digest"),
    )


view(
    "manifests", "part", "p_partkey", "p_size",
    """concat('{"key": ', p_partkey, ', "name": "', CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END,
 '", "type": "demo", "scorer": "', CASE WHEN p_size % 7 = 0 THEN 'guess' ELSE 'pattern' END,
 '", "scorer_params": ', CASE WHEN p_size % 11 = 0 THEN '3' ELSE '{}' END,
 CASE WHEN p_size % 13 = 0 THEN '' ELSE concat(', "generation": {"context": ',
  CAST(p_size - 3 AS STRING), ', "max_tokens": ', CAST(p_retailprice AS STRING),
  ', "temperature": -0.5, "seed": "x", "runs_per_example": 3}') END,
 ', "prompt_template": "./p.md", "examples_dir": "./e", "gates": [{"scorer": "',
 CASE WHEN p_size % 3 = 0 THEN 'nope' ELSE 'field-f1' END, '"}]}') AS manifest_text""",
)


@query("v2_validate_packs", f"""WITH {cte('manifests')},
p AS (SELECT m.p_partkey, m.p_size, p_retailprice FROM manifests m
  JOIN part ON part.p_partkey = m.p_partkey)
SELECT p_partkey, (p_size % 5 = 0)::INT + (p_size % 7 = 0)::INT + (p_size % 11 = 0)::INT
  + CASE WHEN p_size % 13 = 0 THEN 1 ELSE (p_size - 3 < 1)::INT
    + (p_retailprice <> floor(p_retailprice))::INT + 2 END
  + (p_size % 3 = 0)::INT AS n_problems FROM p
WHERE (p_size % 5 = 0)::INT + (p_size % 7 = 0)::INT + (p_size % 11 = 0)::INT
  + CASE WHEN p_size % 13 = 0 THEN 1 ELSE 2 END + (p_size % 3 = 0)::INT > 0""")
def v2(t: Tables) -> DataFrame:
    packs = t.spread("manifests").select(
        F.col("p_partkey").alias("pack"), F.parse_json("manifest_text").alias("manifest")
    )
    return V.validate_packs(packs).groupBy(F.col("pack").alias("p_partkey")).agg(
        F.count(F.lit(1)).cast("int").alias("n_problems")
    )


@query("s2_pack_columns", f"""WITH {cte('manifests')}
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'guess' ELSE 'pattern' END AS scorer,
  CASE WHEN p_size % 13 <> 0 THEN p_size - 3 END AS context,
  CASE WHEN p_size % 3 = 0 THEN 'nope' ELSE 'field-f1' END AS gate FROM manifests""")
def s2(t: Tables) -> DataFrame:
    packs = pack_columns(t.spread("manifests").select(F.parse_json("manifest_text").alias("manifest")))
    return packs.select(
        F.try_variant_get("manifest", "$.key", "bigint").alias("p_partkey"),
        "scorer", "generation.context", F.col("gates")[0]["scorer"].alias("gate"),
    )


@query("v3_validate_templates", """
SELECT doc_id FROM documents WHERE doc_id % 3 = 0""")
def v3(t: Tables) -> DataFrame:
    template = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit(" {{input}}"))
    )
    templates = t["documents"].select(F.col("doc_id").alias("pack"), template.alias("template"))
    return V.validate_templates(templates).select(F.col("pack").alias("doc_id"))


view(
    "param_specs", "part", "p_partkey",
    """CASE p_size % 5 WHEN 0 THEN 'exact-label' WHEN 1 THEN 'field-f1' WHEN 2 THEN 'pattern'
 WHEN 3 THEN 'numeric-tolerance' ELSE 'json-schema' END AS scorer""",
    """CASE p_size % 5
 WHEN 0 THEN concat('{"labels": ["a", "b"], "aliases": {"x": "', CASE WHEN p_partkey % 2 = 0
  THEN 'A ' ELSE 'c' END, '"}}')
 WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN '{"key_fields": []}' ELSE '{"key_fields": ["k"]}' END
 WHEN 2 THEN '{"patterns": ["x", 3], "mode": "fuzzy", "match": "any"}'
 WHEN 3 THEN concat('{"tolerance": ', CAST(p_retailprice - 1000 AS STRING), '}')
 ELSE CASE WHEN p_partkey % 2 = 0 THEN '{"schema": "s.json"}' ELSE '{"schema": {}}' END END
 AS params""",
)


@query("v5_validate_params", """
SELECT p_partkey, n FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_partkey % 2
  WHEN 1 THEN 1 - p_partkey % 2 WHEN 2 THEN 2 WHEN 3 THEN (p_retailprice < 1000)::INT
  ELSE 1 - p_partkey % 2 END::BIGINT AS n FROM part) WHERE n > 0""")
def v5(t: Tables) -> DataFrame:
    packs = t.spread("param_specs").select(
        F.col("p_partkey").alias("pack"), "scorer", F.parse_json("params").alias("scorer_params"),
        F.array().cast("array<struct<scorer:string,scorer_params:variant>>").alias("gates"),
    )
    return V.validate_params(packs).groupBy(F.col("pack").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n")
    )


view(
    "text_params", "part", "p_partkey",
    """CASE p_partkey % 4 WHEN 0 THEN 'json-schema' ELSE 'pattern' END AS scorer""",
    """CASE p_partkey % 4
 WHEN 0 THEN concat('{"schema": {"type": "', CASE p_size % 3 WHEN 0 THEN 'text' ELSE 'object' END,
  '", "maxItems": ', CASE WHEN p_size % 2 = 0 THEN '-1' ELSE '3' END, '}}')
 WHEN 1 THEN concat('{"patterns": ["a(b", "c+", "[', CAST(p_size AS STRING), '"], "mode": "regex"}')
 WHEN 2 THEN '{"patterns": ["a(b", "[1"], "mode": "contains"}'
 ELSE '{"patterns": ["(a|b)+"], "mode": "regex"}' END AS params""",
)


@query("v5_patterns_and_schemas", """
SELECT p_partkey, place, message FROM (SELECT p_partkey, unnest(CASE p_partkey % 4
  WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN [{'place': 0, 'message':
      'scorer "json-schema" param "schema" is not a valid JSON Schema: "text" at # is not a JSON type'}]
    WHEN p_size % 2 = 0 THEN [{'place': 0, 'message': 'scorer "json-schema" param "schema" is not a valid '
      || 'JSON Schema: maxItems at # must be a whole number from 0 on'}] ELSE [] END
  WHEN 1 THEN [{'place': 0, 'message': 'scorer "pattern" param "patterns" has "a(b", which does not compile'},
    {'place': 1, 'message': 'scorer "pattern" param "patterns" has "[' || p_size || '", which does not compile'}]
  ELSE [] END, recursive := true) FROM part)""")
def v5_texts(t: Tables) -> DataFrame:
    packs = t.spread("text_params").select(
        F.col("p_partkey").alias("pack"), "scorer", F.parse_json("params").alias("scorer_params"),
        F.array().cast("array<struct<scorer:string,scorer_params:variant>>").alias("gates"),
    )
    return V.validate_params(packs).select(F.col("pack").alias("p_partkey"), "place", "message")


@query("v4_check_expected", """
SELECT o_orderpriority AS pack, bad AS value, min(o_orderkey) AS example_id FROM (
  SELECT o_orderpriority, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '"P"'
    WHEN o_orderkey % 9 = 0 THEN '12' END AS bad FROM orders) WHERE bad IS NOT NULL
GROUP BY o_orderpriority, bad""")
def v4(t: Tables) -> DataFrame:
    examples = t.spread("orders").select(
        F.col("o_orderpriority").alias("pack"), F.col("o_orderkey").alias("example_id"),
        F.lit("orders").alias("source_path"),
        F.parse_json(
            F.expr(
                "CASE WHEN o_orderstatus = 'P' THEN '\"P\"' WHEN o_orderkey % 9 = 0 THEN '12' "
                "ELSE concat('\"', lower(o_orderstatus), ' \"') END"
            )
        ).alias("expected"),
    )
    packs = t["orders"].select(F.col("o_orderpriority").alias("pack")).distinct().select(
        "pack", F.lit("exact-label").alias("scorer"),
        F.parse_json(F.lit('{"labels": ["F", "O"]}')).alias("scorer_params"),
        F.array().cast("array<struct<scorer:string,scorer_params:variant>>").alias("gates"),
    )
    found = V.check_expected(examples, packs)
    value = F.regexp_extract("message", "expected value (.*), which", 1)
    return found.select("pack", value.alias("value"), "example_id")


view(
    "typed_examples", "orders", "o_orderpriority AS pack", "o_orderkey AS example_id",
    """CASE o_orderkey % 5 WHEN 0 THEN '"F"' WHEN 1 THEN '12' WHEN 2 THEN '"five"' WHEN 3 THEN '{"a": 1}'
 ELSE 'null' END AS expected_text""",
)


@query("v4_problem_counts", f"""WITH {cte('typed_examples')}
SELECT pack, count(*) AS examples, count(*) FILTER (CASE substr(pack, 1, 1) WHEN '1' THEN expected_text <> '"F"'
  WHEN '2' THEN expected_text <> '12' WHEN '3' THEN expected_text <> '{{"a": 1}}' WHEN '4' THEN false
  ELSE expected_text <> '"F"' END) AS problems FROM typed_examples GROUP BY pack""")
def v4_counts(t: Tables) -> DataFrame:
    """Expected values that do not fit, per pack; the last pack's gate decides, not its scorer."""
    label, gates = '{"labels": ["F", "O"]}', "array<struct<scorer:string,scorer_params:variant>>"
    kind = F.left("pack", F.lit(1))
    packs = t["typed_examples"].select("pack").distinct().select(
        "pack",
        F.when(kind == "1", "exact-label").when(kind == "2", "numeric-tolerance").when(kind == "3", "field-f1")
        .otherwise("pattern").alias("scorer"),
        F.parse_json(F.when(kind == "1", label).when(kind == "2", '{"tolerance": 1}')
                     .when(kind == "3", '{"key_fields": ["a"]}').otherwise('{"patterns": ["x"]}'))
        .alias("scorer_params"),
        F.when(kind == "5", F.array(F.struct(
            F.lit("exact-label").alias("scorer"), F.parse_json(F.lit(label)).alias("scorer_params"))))
        .otherwise(F.array().cast(gates)).alias("gates"),
    )
    examples = t.spread("typed_examples").select("pack", "example_id", F.parse_json("expected_text").alias("expected"))
    return V.judge_expected(examples, packs).groupBy("pack").agg(
        F.count(F.lit(1)).alias("examples"), F.count("problem").alias("problems"))


@query("u3_missing_labels", """
SELECT doc_id, concat_ws(',', CASE WHEN NOT contains(lower(text), 'the') THEN 'The' END,
  CASE WHEN NOT contains(lower(text), 'http') THEN 'HTTP' END,
  CASE WHEN NOT contains(lower(text), 'und') THEN 'und' END) AS missing FROM documents""")
def u3(t: Tables) -> DataFrame:
    labels = F.array(F.lit("The"), F.lit("HTTP"), F.lit("und"))
    return t["documents"].select(
        "doc_id", F.array_join(U.missing_labels(labels, F.col("text")), ",").alias("missing")
    )


NAMES = ["small ring", "red widget", "small widget", "blue bolt"]
NAMES_SQL = ", ".join(f"'{n}'" for n in NAMES)


@query("u4_off_label", f"""
SELECT pack, string_agg(value, ',' ORDER BY s) AS off_label FROM (
  SELECT pack, value, s, row_number() OVER (PARTITION BY pack ORDER BY s, value) AS r FROM (
    SELECT p_brand AS pack, '"' || p_name || '"' AS value, min(p_partkey) AS s FROM part
    WHERE p_name NOT IN ({NAMES_SQL}) GROUP BY p_brand, p_name)) WHERE r <= 5 GROUP BY pack""")
def u4(t: Tables) -> DataFrame:
    examples = t["part"].select(
        F.col("p_brand").alias("pack"), F.col("p_partkey").alias("seq"),
        F.parse_json(F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))).alias("expected"),
        F.array(*[F.lit(n) for n in NAMES]).alias("labels"),
    )
    return U.off_label(examples).select("pack", F.array_join("off_label", ",").alias("off_label"))


view(
    "draft_texts", "conversations", "conv_id * 100 + turn AS draft_id",
    """CASE WHEN (conv_id * 100 + turn) % 7 = 0 THEN 'no json here'
 WHEN (conv_id * 100 + turn) % 7 = 1 THEN '[1, 2]'
 ELSE concat('Draft: {"name": "', CASE WHEN (conv_id * 100 + turn) % 7 = 2 THEN '--' ELSE concat('My Task ', conv_id * 100 + turn)
   END, '", "type": "t", "scorer": "exact-label", "scorer_params": {"labels": ["yes", "No"]},',
   ' "prompt": "', CASE WHEN (conv_id * 100 + turn) % 7 = 3 THEN 'answer yes' ELSE 'yes or no: {{input}}' END,
   '", "examples": [{"input": "a", "expected": "yes"}, {"input": "a", "expected": "No"},',
   ' {"input": " ", "expected": "yes"}, {"input": "b", "expected": "',
   CASE WHEN (conv_id * 100 + turn) % 7 = 4 THEN 'maybe' ELSE 'No' END, '"}, {"input": "c"}]} end') END AS output""",
)
DRAFTED = f"""{cte('draft_texts')},
d AS (SELECT draft_id, draft_id % 7 AS c FROM draft_texts)"""


@query("v6_validate_drafts", f"""WITH {DRAFTED}
SELECT draft_id, CASE WHEN c < 2 THEN 1 ELSE 1 + 2 + (c = 2)::INT + (c = 3)::INT * 2
  + (c = 4)::INT END::BIGINT AS n_problems FROM d""")
def v6(t: Tables) -> DataFrame:
    drafts, _ = V.parse_drafts(t.spread("draft_texts"))
    return V.validate_drafts(drafts).groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("n_problems")
    )


@query("v7_salvage_drafts", f"""WITH {DRAFTED}
SELECT draft_id, CASE WHEN c = 2 THEN 'drafted-task' ELSE 'my-task-' || draft_id END AS name,
  CASE WHEN c = 3 THEN 'placeholder' ELSE 'own' END AS prompt, 2::BIGINT AS n_examples
FROM d WHERE c >= 2""")
def v7(t: Tables) -> DataFrame:
    packs, examples = V.salvage_drafts(*V.parse_drafts(t.spread("draft_texts")))
    counts = examples.groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_examples"))
    own = F.col("prompt").startswith("yes or no")
    return packs.join(counts, "draft_id", "left").select(
        "draft_id", "name", F.when(own, "own").otherwise("placeholder").alias("prompt"),
        "n_examples",
    )
