"""Scoring jobs over tables of outputs."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gradelake.operators import scorers as S
from gradelake.operators.joins import scoring_input
from gradelake.operators.scale import spread_small
from gradelake.operators.schema_check import schema_problem
from gradelake.session import cut_lineage

#: Distinct schemas compiled into one branch; packs that use more are scored in several.
BRANCH_SCHEMAS = 100
#: Problems of packs named in an error.
SHOWN_PROBLEMS = 20


def _typed(scorer: Column, params: Column) -> Column:
    """Typed parameter struct of a scorer name and its VARIANT parameters."""
    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(params, path, kind)

    labels = get("$.labels", "array<string>")
    keys, names = S.label_table(labels, get("$.aliases", "map<string,string>"))
    return F.struct(
        scorer.alias("scorer"), keys.alias("label_keys"), names.alias("label_names"),
        get("$.key_fields", "array<string>").alias("key_fields"),
        get("$.patterns", "array<string>").alias("patterns"),
        get("$.mode", "string").alias("mode"), get("$.match", "string").alias("match"),
        get("$.tolerance", "double").alias("tolerance"),
        F.to_json(get("$.schema", "variant")).alias("schema_text"), params.alias("own"),
    )


def prepare_packs(packs: DataFrame) -> DataFrame:
    """Pack specs with typed parameters, one row per pack, read once per row scored.

    ``packs(pack, scorer STRING, scorer_params VARIANT,
    gates ARRAY<STRUCT<scorer, scorer_params VARIANT>>)``.
    """
    return _prepared(packs)


def _prepared(packs: DataFrame, *more: Column) -> DataFrame:
    return packs.select(
        "pack", "scorer",
        _typed(F.col("scorer"), F.col("scorer_params")).alias("primary_params"),
        F.transform("gates", lambda g: _typed(g["scorer"], g["scorer_params"])).alias(
            "gate_params"
        ),
        *more,
    )


def _specs() -> Column:
    """The primary scorer's parameters, then its gates'."""
    return F.concat(F.array("primary_params"), F.coalesce("gate_params", F.array()))


def _schema_set() -> Column:
    """Sorted distinct schema texts of a row's scorers."""
    used = F.transform(
        _specs(), lambda p: F.when(p["scorer"] == "json-schema", p["schema_text"])
    )
    return F.array_sort(F.array_distinct(F.array_compact(used)))


def _schema_groups(sets: list[tuple[str, ...]]) -> list[list[tuple[str, ...]]]:
    """Schema sets in groups that use ``BRANCH_SCHEMAS`` texts together, or are one set alone."""
    groups: list[list[tuple[str, ...]]] = [[()]]
    texts: set[str] = set()
    for own in sorted(set(sets) - {()}):
        if texts and len(texts.union(own)) > BRANCH_SCHEMAS:
            groups.append([])
            texts = set()
        groups[-1].append(own)
        texts.update(own)
    return groups


def _refuse(what: str, problems: list[str], total: int) -> None:
    more = total - SHOWN_PROBLEMS
    raise ValueError(
        f"{what} cannot be scored: " + "; ".join(problems[:SHOWN_PROBLEMS])
        + (f"; and {more} more" if more > 0 else "")
    )


def _plan_facts(prepared: DataFrame) -> tuple[list[str], list[list[tuple[str, ...]]]]:
    """Scorer names and groups of schema sets the packs use; bad packs raise here.

    Pack specs are written by hand; the distinct names, schemas and problems come to the
    driver, as the job is built from them.
    """
    facts = prepared.select(
        F.array_distinct(F.transform(_specs(), lambda p: p["scorer"])).alias("names"),
        _schema_set().alias("schemas"), "_problems",
    ).distinct().collect()
    names = sorted({name for r in facts for name in r["names"]})
    for name in names:
        S.get_scorer(name)
    problems = sorted({p for r in facts for p in r["_problems"] or []})
    schemas = sorted({text for r in facts for text in r["schemas"]})
    problems += filter(None, (schema_problem(prepared.sparkSession, text) for text in schemas))
    if problems:
        _refuse("the packs", problems, len(problems))
    return names, _schema_groups([tuple(r["schemas"]) for r in facts])


def record_for(
    params: Column, output: S.Output, expected: Column, names: list[str], schemas: list[str]
) -> Column:
    """Record of whichever scorer a row's parameters name."""
    typed = S.Params(**{
        name: params[name]
        for name in (
            "label_keys", "label_names", "key_fields", "patterns", "mode", "match", "tolerance",
            "schema_text", "own",
        )
    })
    chosen: Column | None = None
    for name in names:
        if name == "json-schema":
            built = S.json_schema_by_text(output, typed.schema_text, schemas)
        else:
            built = S.get_scorer(name)(output, expected, typed)
        here = params["scorer"] == name
        chosen = F.when(here, built) if chosen is None else chosen.when(here, built)
    return chosen


_BUILT_IN = frozenset(("exact-label", "field-f1", "json-schema", "numeric-tolerance", "pattern"))
#: Forms of an output, their types, and the scorers that do without them; others may use any.
_FORMS = {
    "_normalized": (S.T.normalize_text, "string", _BUILT_IN - {"exact-label"}),
    "_number": (S.T.parse_first_number, "struct<value:double,raw:string>", _BUILT_IN - {"numeric-tolerance"}),
    "_extracted": (
        S.T.extract_json, "struct<value:variant,ok:boolean,extraction_needed:boolean,error:string>",
        _BUILT_IN - {"field-f1", "json-schema"},
    ),
}


def _needs(done_without: frozenset[str]) -> Column:
    """Whether a row's scorer or one of its gates may use a form."""
    names = sorted(done_without)
    return ~F.col("primary_params.scorer").isin(names) | F.coalesce(
        F.exists("gate_params", lambda g: ~g["scorer"].isin(names)), F.lit(False))


@lru_cache(maxsize=32)
def _expressions(
    app: str, names: tuple[str, ...], schemas: tuple[str, ...]
) -> tuple[dict[str, Column], Column, Column]:
    """Scoring expressions over the columns of a scoring input.

    They depend on names only, so jobs of one application (``app``) that use the
    same scorers share them; building them takes thousands of calls to the JVM.
    """
    text = F.col("output")
    forms = {
        name: F.when(_needs(done_without), form(text))
        if set(names) - done_without else F.lit(None).cast(kind)
        for name, (form, kind, done_without) in _FORMS.items()
    }
    output = S.Output(text, F.col("_normalized"), F.col("_number"), F.col("_extracted"))
    # The primary scorer goes first, its gates follow; one lambda serves them all.
    every = F.transform(
        _specs(),
        lambda p: F.struct(
            p["scorer"].alias("name"),
            record_for(p, output, F.col("expected"), list(names), list(schemas)).alias("record"),
        ),
    )
    ready = F.col("failure_reason").isNull() & text.isNotNull()
    records = F.col("_records")
    composed = S.compose(
        F.col("primary_params.scorer"), records[0]["record"],
        F.slice(records, F.lit(2), F.size(records)),
    )
    return forms, F.when(ready, every), F.when(records.isNotNull(), composed)


def score_rows(
    joined: DataFrame, names: list[str], schemas: list[list[tuple[str, ...]]]
) -> DataFrame:
    """Score rows that already carry ``output, expected, primary_params, gate_params``.

    One branch per group of schema sets; a row is in the branch that knows all its schemas.
    """
    if len(schemas) == 1:
        return _scored(joined, names, schemas[0])
    # Rows without a pack have no schemas and are in the first branch.
    # JSON texts have no raw line feeds, so joined texts stand for their set.
    key = F.coalesce(F.array_join(_schema_set(), "\n"), F.lit(""))
    made = [
        _scored(joined.filter(key.isin(["\n".join(own) for own in sets])), names, sets)
        for sets in schemas
    ]
    return reduce(DataFrame.unionByName, made)


def _scored(joined: DataFrame, names: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    app = joined.sparkSession.sparkContext.applicationId
    texts = sorted({text for own in sets for text in own})
    forms, every, result = _expressions(app, tuple(names), tuple(texts))
    scored = (
        joined.withColumns(forms).withColumn("_records", every).withColumn("_result", result)
    )
    return scored.select(
        *[c for c in joined.columns if c not in ("primary_params", "gate_params", "expected")],
        F.col("_result.score").alias("score"), F.col("_result.pass").alias("pass"),
        F.col("_result.details.failed_gate").alias("failed_gate"),
        F.col("_result.details").alias("details"),
    )


def bind(packs: DataFrame) -> tuple[DataFrame, list[str], list[list[tuple[str, ...]]]]:
    """Prepared packs with the scorer names and schemas they use.

    Unknown scorers, bad parameters and patterns that do not compile raise here, before any
    row is scored.
    """
    from gradelake.plans.validate import pack_problems

    checked = _prepared(packs, pack_problems().alias("_problems"))
    return (checked.drop("_problems"), *_plan_facts(checked))


def sound_examples(examples: DataFrame, packs: DataFrame) -> DataFrame:
    """The examples, once every expected value is known to fit its scorer (V4).

    The examples are read once: they are judged while they are written to the shared
    checkpoint folder, from where the scoring joins them, and what was found is observed on
    the way. Values that do not fit raise with their distinct messages.
    """
    from gradelake.plans.validate import judge_expected

    seen = Observation()
    judged = judge_expected(examples.select("pack", "example_id", "expected"), packs).observe(
        seen, F.count("problem").alias("problems"))
    kept = cut_lineage(judged)
    if seen.get["problems"]:
        told = kept.filter("problem IS NOT NULL").groupBy("problem").agg(
            F.min(F.struct("pack", "example_id")).alias("first"))
        first = told.orderBy("first", "problem").limit(SHOWN_PROBLEMS).collect()
        _refuse("the expected values", [r["problem"] for r in first], told.count())
    return kept.drop("problem")


def score(outputs: DataFrame, examples: DataFrame, packs: DataFrame) -> DataFrame:
    """Score every output by its pack's scorer and gates.

    Map-side apart from the lookups of example and pack. Bad packs and expected values that
    do not fit their scorer raise before a row is scored.
    """
    prepared, names, schemas = bind(packs)
    if not outputs.isStreaming:
        outputs = spread_small(outputs)
    return score_rows(scoring_input(outputs, sound_examples(examples, packs), prepared), names, schemas)


__all__ = ["bind", "prepare_packs", "score", "score_rows", "sound_examples"]
