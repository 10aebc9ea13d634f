"""Aggregates, decisions and reports over units (lineitem) and candidates (supplier)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import display, predicates
from gradelake.operators import aggregates as A
from gradelake.operators import joins as J
from gradelake.operators.frontier import frontier
from gradelake.operators.scorers import first_failed_gate
from gradelake.plans import decide, planning
from gradelake.plans import report as R
from gradelake.plans.summary import candidate_summary
from gradelake.session import cut_lineage
from workload.registry import Tables, cte, query

K = "run_id, candidate_id"
DONE = "status = 'completed' AND score IS NOT NULL"
TRUNCATED = "done_reason = 'length' AND trim(coalesce(output, '')) = ''"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums of doubles depend on their order."""
    return df.select(*[
        F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])


def over_units(body: str) -> str:
    return f"WITH {cte('units')} {body}"


# Aggregates ------------------------------------------------------------------

COUNTS = (
    f"count(*) FILTER (WHERE {DONE}) AS completed, "
    "count(*) FILTER (WHERE status = 'failed') AS failed, "
    "count(*) FILTER (WHERE status = 'pending') AS pending, "
    "count(*) FILTER (WHERE status = 'skipped') AS skipped"
)


@query("a1_status_counts", over_units(f"SELECT {K}, {COUNTS} FROM units GROUP BY {K}"))
def a1(t: Tables) -> DataFrame:
    return A.status_counts(t["units"])


@query("a2_quality", over_units(
    f"SELECT {K}, round(avg(score) FILTER (WHERE {DONE}), 6) AS mean_score, "
    f"round(avg(CASE WHEN pass THEN 1.0 ELSE 0.0 END) FILTER (WHERE {DONE}), 6) AS pass_rate "
    f"FROM units GROUP BY {K}"))
def a2(t: Tables) -> DataFrame:
    return rounded(A.quality(t["units"]))


@query("a3_repetition_spread", over_units(
    f"SELECT {K}, round(min(m), 9) AS score_min, round(max(m), 9) AS score_max FROM ("
    f"SELECT {K}, repetition, avg(score) AS m FROM units WHERE {DONE} GROUP BY {K}, repetition) "
    f"GROUP BY {K}"))
def a3(t: Tables) -> DataFrame:
    return rounded(A.repetition_spread(t["units"]), 9)


@query("a4_latency_stats", over_units(
    f"SELECT {K}, min(ttft_ms) AS ttft_min, max(ttft_ms) AS ttft_max, "
    "min(tokens_per_second) AS rate_min, max(tokens_per_second) AS rate_max, "
    "round(median(ttft_ms), 6) AS ttft_median, "
    "round(median(tokens_per_second), 6) AS rate_median "
    f"FROM units WHERE {DONE} GROUP BY {K}"))
def a4(t: Tables) -> DataFrame:
    found = A.latency_stats(t["units"])
    return found.withColumns({
        c: F.round(c, 6) for c in ("ttft_median", "rate_median")
    })


@query("a5_wall_total", over_units(
    f"SELECT {K}, round(sum(CASE WHEN {DONE} THEN coalesce(wall_ms, 0) ELSE 0 END), 3) "
    f"AS wall_ms_total FROM units GROUP BY {K}"))
def a5(t: Tables) -> DataFrame:
    return rounded(A.wall_total(t["units"]), 3)


DETERMINISM = (
    f"SELECT {K}, bool_and(CASE WHEN n > 1 THEN same END) AS outputs_deterministic FROM ("
    f"SELECT {K}, example_id, count(*) AS n, count(DISTINCT output) = 1 AS same "
    f"FROM units WHERE {DONE} GROUP BY {K}, example_id) GROUP BY {K}"
)


@query("a6_determinism", over_units(DETERMINISM))
def a6(t: Tables) -> DataFrame:
    return A.determinism(t["units"])


@query("a7_truncated_empty", over_units(
    f"SELECT {K}, count(*) FILTER (WHERE {DONE} AND {TRUNCATED}) AS truncated_empty_count "
    f"FROM units GROUP BY {K}"))
def a7(t: Tables) -> DataFrame:
    return A.truncated_empty(t["units"])


GATES = (
    f"SELECT {K}, failed_gate AS gate, count(*) AS n_units, "
    "min(struct_pack(e := example_id, r := repetition, u := unit_id)) AS first_unit FROM units "
    f"WHERE {DONE} AND failed_gate IS NOT NULL GROUP BY {K}, failed_gate"
)


@query("a8_gate_failure_counts", over_units(
    f"SELECT {K}, e.gate AS gate, e.n_units AS n_units FROM ({GATES}) e"))
def a8(t: Tables) -> DataFrame:
    counts = A.gate_failure_counts(t["units"])
    return counts.select(
        "run_id", "candidate_id", F.explode("gate_failure_counts").alias("gate", "n_units")
    )


@query("a9_gates_passed", over_units(
    f"SELECT {K}, bool_and(failed_gate IS NULL) FILTER (WHERE {DONE}) AS gates_passed "
    f"FROM units GROUP BY {K}"))
def a9(t: Tables) -> DataFrame:
    return A.gates_passed(t["units"])


DELTA = (
    "(measured_peak_mib - predicted_peak_mib) / nullif(predicted_peak_mib, 0) * 100"
)


@query("a10_memory_delta", f"""WITH {cte('candidates')}
SELECT run_id, candidate_id, round({DELTA}, 6) AS memory_delta_percent FROM candidates""")
def a10(t: Tables) -> DataFrame:
    return rounded(t["candidates"].select(
        "run_id", "candidate_id",
        A.memory_delta_percent(F.col("measured_peak_mib"), F.col("predicted_peak_mib")).alias(
            "memory_delta_percent"
        ),
    ))


@query("a11_token_spend", over_units(
    "SELECT run_id, CAST(sum(coalesce(prompt_token_count, 0)) AS BIGINT) AS prompt_tokens, "
    "CAST(sum(coalesce(output_token_count, 0)) AS BIGINT) AS output_tokens, "
    "count(*) AS generations FROM units WHERE output IS NOT NULL GROUP BY run_id"))
def a11(t: Tables) -> DataFrame:
    return A.token_spend(t["units"])


# Joins -----------------------------------------------------------------------

@query("j1_unit_results", over_units("""
SELECT u.unit_id, u.run_id, u.candidate_id, u.status, g.output, g.ttft_ms, s.score, s.pass
FROM units u
LEFT JOIN (SELECT unit_id, output, ttft_ms FROM units WHERE output IS NOT NULL) g
  ON u.unit_id = g.unit_id
LEFT JOIN (SELECT unit_id, score, pass FROM units WHERE score IS NOT NULL) s
  ON u.unit_id = s.unit_id"""))
def j1(t: Tables) -> DataFrame:
    units = t["units"]
    return J.unit_results(
        units.select("unit_id", "run_id", "candidate_id", "status"),
        units.filter("output IS NOT NULL").select("unit_id", "output", "ttft_ms"),
        units.filter("score IS NOT NULL").select("unit_id", "score", "pass"),
    )


@query("j3_pending_work", f"""WITH {cte('units', 'candidates')}
SELECT u.run_id, u.candidate_id, u.unit_id, u.example_id, u.repetition FROM units u
JOIN candidates c ON u.run_id = c.run_id AND u.candidate_id = c.candidate_id
WHERE u.status = 'pending' AND c.status <> 'oom'""")
def j3(t: Tables) -> DataFrame:
    return J.pending_work(t["candidates"], t["units"]).select(
        "run_id", "candidate_id", "unit_id", "example_id", "repetition"
    )


RATED = "CASE WHEN candidate_id % 12 <> 0 THEN measured_peak_mib / 10 END"


def rated(t: Tables) -> DataFrame:
    return t["candidates"].withColumn("tokens_per_second", F.expr(RATED))


@query("j4_size_peers", f"""WITH {cte('candidates')},
c AS (SELECT *, {RATED} AS tokens_per_second FROM candidates)
SELECT a.run_id, a.candidate_id,
  count(*) FILTER (WHERE b.candidate_id <> a.candidate_id AND b.tokens_per_second IS NOT NULL)
    AS peer_count,
  max(b.tokens_per_second) AS band_best_rate
FROM c a JOIN c b ON a.run_id = b.run_id
  AND b.size_bytes >= a.size_bytes * 0.5 AND b.size_bytes <= a.size_bytes * 2.0
GROUP BY a.run_id, a.candidate_id""")
def j4(t: Tables) -> DataFrame:
    return J.size_peers(rated(t)).select(
        "run_id", "candidate_id", "peer_count", "band_best_rate"
    )


FRESH = "CASE WHEN l_tax > 0.07 THEN score * 0.5 ELSE score END"


@query("j6_rescore_diff", f"""WITH {cte('units')}
SELECT run_id, unit_id, round(score, 6) AS stored_score, round(fresh, 6) AS fresh_score,
  NOT (score IS NOT DISTINCT FROM fresh AND pass IS NOT DISTINCT FROM fresh_pass
       AND failed_gate IS NOT DISTINCT FROM fresh_gate) AS changed
FROM (SELECT *, CASE WHEN failed_gate IS NULL THEN score ELSE 0.0 END AS fresh,
  (failed_gate IS NULL AND pass) AS fresh_pass,
  CASE WHEN repetition = 1 THEN NULL ELSE failed_gate END AS fresh_gate
  FROM units WHERE score IS NOT NULL)""")
def j6(t: Tables) -> DataFrame:
    return rounded(stored_and_fresh(t).select(
        "run_id", "unit_id", "stored_score", "fresh_score", "changed"
    ))


def stored_and_fresh(t: Tables) -> DataFrame:
    units = t["units"].filter("score IS NOT NULL")
    stored = units.select(
        "run_id", "unit_id", "score", "pass", F.struct("failed_gate").alias("details")
    )
    fresh = units.select(
        "run_id", "unit_id",
        F.expr("CASE WHEN failed_gate IS NULL THEN score ELSE 0.0D END").alias("score"),
        F.expr("failed_gate IS NULL AND pass").alias("pass"),
        F.struct(
            F.expr("CASE WHEN repetition = 1 THEN NULL ELSE failed_gate END").alias("failed_gate")
        ).alias("details"),
    )
    return J.rescore_diff(stored, fresh)


@query("a19_rescore_counts", f"""WITH {cte('units')}
SELECT run_id, count(*) AS checked,
  count(*) FILTER (WHERE NOT (score IS NOT DISTINCT FROM fresh
    AND pass IS NOT DISTINCT FROM fresh_pass
    AND failed_gate IS NOT DISTINCT FROM fresh_gate)) AS changed
FROM (SELECT *, CASE WHEN failed_gate IS NULL THEN score ELSE 0.0 END AS fresh,
  (failed_gate IS NULL AND pass) AS fresh_pass,
  CASE WHEN repetition = 1 THEN NULL ELSE failed_gate END AS fresh_gate
  FROM units WHERE score IS NOT NULL) GROUP BY run_id""")
def a19(t: Tables) -> DataFrame:
    return A.rescore_counts(stored_and_fresh(t))


@query("j12_predicted_vs_measured", f"""WITH {cte('candidates')}
SELECT c.run_id, c.candidate_id, c.predicted_peak_mib, p.peak AS measured_peak_mib,
  round((p.peak - c.predicted_peak_mib) / nullif(c.predicted_peak_mib, 0) * 100, 6)
    AS memory_delta_percent
FROM candidates c LEFT JOIN (
  SELECT l_suppkey, max(l_extendedprice) / 10 AS peak FROM lineitem GROUP BY l_suppkey) p
ON p.l_suppkey = c.candidate_id""")
def j12(t: Tables) -> DataFrame:
    peaks = t["lineitem"].groupBy(
        (F.col("l_suppkey") % 7).alias("run_id"), F.col("l_suppkey").alias("candidate_id")
    ).agg((F.max("l_extendedprice") / 10).alias("measured_peak_mib"))
    found = J.predicted_vs_measured(t["candidates"].drop("measured_peak_mib"), peaks)
    return found.select(
        "run_id", "candidate_id", "predicted_peak_mib", "measured_peak_mib",
        F.round("memory_delta_percent", 6).alias("memory_delta_percent"),
    )


# Row labels ------------------------------------------------------------------

@query("p8_truncated_empty", over_units(
    f"SELECT unit_id, coalesce({TRUNCATED}, false) AS truncated_empty FROM units"))
def p8(t: Tables) -> DataFrame:
    flag = predicates.is_truncated_empty(F.col("done_reason"), F.col("output"))
    return t["units"].select(
        "unit_id", F.coalesce(flag, F.lit(False)).alias("truncated_empty")
    )


@query("w7_first_failed_gate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_tax > 0.05 THEN 'json-schema' WHEN l_discount > 0.05 THEN 'pattern'
       WHEN l_quantity > 40 THEN 'numeric-tolerance' END AS failed_gate
FROM lineitem""")
def w7(t: Tables) -> DataFrame:
    def gate(name: str, passed: str):
        return F.struct(
            F.lit(name).alias("name"), F.struct(F.expr(passed).alias("pass")).alias("record")
        )

    gates = F.array(
        gate("json-schema", "l_tax <= 0.05"), gate("pattern", "l_discount <= 0.05"),
        gate("numeric-tolerance", "l_quantity <= 40"),
    )
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        first_failed_gate(gates).alias("failed_gate"),
    )


# Summary and decisions ---------------------------------------------------------

SUMMARY = f"""{cte('units', 'candidates')},
done AS (SELECT * FROM units WHERE {DONE}),
counted AS (SELECT {K}, {COUNTS} FROM units GROUP BY {K}),
measured AS (SELECT {K}, avg(score) AS mean_score,
  avg(CASE WHEN pass THEN 1.0 ELSE 0.0 END) AS pass_rate,
  median(ttft_ms) AS ttft_median, min(ttft_ms) AS ttft_min, max(ttft_ms) AS ttft_max,
  median(tokens_per_second) AS rate_median, min(tokens_per_second) AS rate_min,
  max(tokens_per_second) AS rate_max, sum(coalesce(wall_ms, 0)) AS wall_ms_total,
  bool_and(failed_gate IS NULL) AS gates_passed,
  count(*) FILTER (WHERE {TRUNCATED}) AS truncated_empty_count
  FROM done GROUP BY {K}),
spread AS (SELECT {K}, min(m) AS score_min, max(m) AS score_max FROM (
  SELECT {K}, repetition, avg(score) AS m FROM done GROUP BY {K}, repetition) GROUP BY {K}),
repeated AS ({DETERMINISM}),
gated AS (SELECT {K}, string_agg(gate || ' (' || n_units ||
  CASE WHEN n_units = 1 THEN ' unit)' ELSE ' units)' END, ', ' ORDER BY first_unit) AS gates
  FROM ({GATES}) GROUP BY {K}),
summary AS (SELECT c.*, coalesce(n.completed, 0) AS completed, coalesce(n.failed, 0) AS failed,
  coalesce(n.pending, 0) AS pending, coalesce(n.skipped, 0) AS skipped,
  m.mean_score, m.pass_rate, m.ttft_median, m.ttft_min, m.ttft_max, m.rate_median, m.rate_min,
  m.rate_max, coalesce(m.wall_ms_total, 0) AS wall_ms_total, m.gates_passed,
  coalesce(m.truncated_empty_count, 0) AS truncated_empty_count, s.score_min, s.score_max,
  r.outputs_deterministic, coalesce(g.gates, '') AS gates,
  {DELTA} AS memory_delta_percent
  FROM candidates c
  LEFT JOIN counted n ON c.run_id = n.run_id AND c.candidate_id = n.candidate_id
  LEFT JOIN measured m ON c.run_id = m.run_id AND c.candidate_id = m.candidate_id
  LEFT JOIN spread s ON c.run_id = s.run_id AND c.candidate_id = s.candidate_id
  LEFT JOIN repeated r ON c.run_id = r.run_id AND c.candidate_id = r.candidate_id
  LEFT JOIN gated g ON c.run_id = g.run_id AND c.candidate_id = g.candidate_id)"""

SUMMARY_COLUMNS = (
    "run_id", "candidate_id", "model_name", "completed", "failed", "pending", "skipped",
    "outputs_deterministic", "gates_passed", "truncated_empty_count",
)
SUMMARY_DOUBLES = (
    "mean_score", "pass_rate", "score_min", "score_max", "ttft_median", "ttft_min", "ttft_max",
    "rate_median", "rate_min", "rate_max", "memory_delta_percent",
)


def summary_of(t: Tables) -> DataFrame:
    return candidate_summary(t["units"], t["candidates"])


def settled(t: Tables) -> DataFrame:
    """The summary, computed once, for queries that read it several times."""
    return cut_lineage(summary_of(t))


@query("r1_candidate_summary", f"WITH {SUMMARY} SELECT {', '.join(SUMMARY_COLUMNS)}, "
       + ", ".join(f"round({c}, 9) AS {c}" for c in SUMMARY_DOUBLES)
       + ", round(wall_ms_total, 3) AS wall_ms_total, gates FROM summary")
def r1(t: Tables) -> DataFrame:
    gates = F.coalesce(predicates.gate_list(F.col("gate_failure_counts")), F.lit(""))
    return summary_of(t).select(
        *SUMMARY_COLUMNS, *[F.round(c, 9).alias(c) for c in SUMMARY_DOUBLES],
        F.round("wall_ms_total", 3).alias("wall_ms_total"), gates.alias("gates"),
    )


BLOCKED = f"""CASE
  WHEN status = 'oom' THEN 'did not run: ' || coalesce(status_reason, 'out of memory')
  WHEN status = 'running' THEN '{predicates.INTERRUPTED}'
  WHEN status <> 'completed' THEN
    'did not complete: ' || coalesce(status_reason, 'no reason recorded')
  WHEN mean_score IS NULL THEN 'no completed generations to score'
  WHEN NOT coalesce(gates_passed, false) THEN 'failed gate scorers: ' ||
    CASE WHEN gates = '' THEN 'gate outcomes unavailable' ELSE gates END END"""
JUDGED = f"""{SUMMARY},
judged AS (SELECT *, {BLOCKED} AS blocked,
  status = 'completed' AND coalesce(gates_passed, false) AND mean_score IS NOT NULL AS eligible
  FROM summary)"""


@query("p9_ineligibility_reason",
       f"WITH {JUDGED} SELECT run_id, candidate_id, blocked FROM judged")
def p9(t: Tables) -> DataFrame:
    return decide.with_reasons(summary_of(t)).select("run_id", "candidate_id", "blocked")


@query("p10_is_gate_passing",
       f"WITH {JUDGED} SELECT run_id, candidate_id, eligible FROM judged")
def p10(t: Tables) -> DataFrame:
    return decide.with_reasons(summary_of(t)).select("run_id", "candidate_id", "eligible")


FLAG_SQL = """concat_ws(',', CASE WHEN status = 'oom' THEN 'oom' END,
  CASE WHEN status = 'failed' THEN 'failed' END,
  CASE WHEN status = 'running' THEN 'incomplete' END,
  CASE WHEN NOT gates_passed THEN 'gates!' END,
  CASE WHEN truncated_empty_count > 0 THEN 'trunc!' END,
  CASE WHEN offload_suspect_reason IS NOT NULL THEN 'offload?' END,
  CASE WHEN NOT outputs_deterministic THEN 'nondet' END)"""


@query("p11_flags",
       f"WITH {SUMMARY} SELECT run_id, candidate_id, {FLAG_SQL} AS flags FROM summary")
def p11(t: Tables) -> DataFrame:
    tokens = F.array_join(F.transform("flags", lambda f: f["token"]), ",")
    return R.flagged(summary_of(t)).select("run_id", "candidate_id", tokens.alias("flags"))


DOMINATED = """EXISTS (SELECT 1 FROM points o WHERE o.run_id = p.run_id
  AND o.quality >= p.quality
  AND coalesce(o.vram_mib <= p.vram_mib, true)
  AND coalesce(o.tokens_per_second >= p.tokens_per_second, true)
  AND (o.quality > p.quality OR coalesce(o.vram_mib < p.vram_mib, false)
    OR coalesce(o.tokens_per_second > p.tokens_per_second, false)))"""
POINTS = f"""{JUDGED},
points AS (SELECT run_id, candidate_id, mean_score AS quality, measured_peak_mib AS vram_mib,
  rate_median AS tokens_per_second FROM judged WHERE eligible)"""


@query("j5_frontier", f"WITH {POINTS} SELECT run_id, candidate_id, round(quality, 6) AS quality, "
       f"round(vram_mib, 6) AS vram_mib, round(tokens_per_second, 6) AS tokens_per_second "
       f"FROM points p WHERE NOT {DOMINATED}")
def j5(t: Tables) -> DataFrame:
    return rounded(frontier(decide.points(decide.with_reasons(settled(t)))))


CLASSED = f"""{POINTS},
beaten AS (SELECT run_id, candidate_id FROM points p WHERE {DOMINATED}),
classed AS (SELECT j.*, CASE WHEN NOT eligible THEN 'excluded'
  WHEN b.candidate_id IS NULL THEN 'frontier' ELSE 'dominated' END AS class,
  CASE WHEN NOT eligible THEN coalesce(blocked, 'not eligible') END AS reason
  FROM judged j LEFT JOIN beaten b ON j.run_id = b.run_id AND j.candidate_id = b.candidate_id)"""


@query("r2_frontier_table",
       f"WITH {CLASSED} SELECT run_id, candidate_id, class, reason FROM classed")
def r2(t: Tables) -> DataFrame:
    return decide.frontier_table(settled(t)).select("run_id", "candidate_id", "class", "reason")


@query("u2_classify",
       f"WITH {CLASSED} SELECT run_id, class, count(*) AS n FROM classed GROUP BY run_id, class")
def u2(t: Tables) -> DataFrame:
    return decide.frontier_table(settled(t)).groupBy("run_id", "class").agg(
        F.count(F.lit(1)).alias("n")
    )


TOLERANCE = 0.05
MIB = "1048576.0"
DECIDED = f"""{JUDGED},
best AS (SELECT run_id, candidate_id AS best_id, model_name AS best_name,
  mean_score AS best_quality, mean_score * (1.0::DOUBLE - {TOLERANCE}::DOUBLE) AS threshold
  FROM judged WHERE eligible
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY mean_score DESC, candidate_seq) = 1),
within AS (SELECT j.*, b.threshold FROM judged j JOIN best b ON j.run_id = b.run_id
  WHERE j.eligible AND j.mean_score >= b.threshold),
kinds AS (SELECT run_id, CASE WHEN bool_and(measured_peak_mib IS NOT NULL) THEN 'vram'
  WHEN bool_and(size_bytes = 0) THEN 'none' ELSE 'weights' END AS kind
  FROM within GROUP BY run_id),
sized AS (SELECT w.*, k.kind, CASE k.kind WHEN 'vram' THEN measured_peak_mib
  WHEN 'none' THEN 0.0 ELSE size_bytes / {MIB} END AS mib
  FROM within w JOIN kinds k ON w.run_id = k.run_id),
picks AS (SELECT run_id, kind, candidate_id AS pick_id, model_name AS pick_name, mib AS pick_mib
  FROM sized QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY mib, mean_score DESC,
    coalesce(rate_median, 0) DESC, model_name, candidate_seq) = 1)"""


@query("w1_quality_threshold", f"WITH {DECIDED} SELECT run_id, best_id, "
       "round(best_quality, 6) AS best_quality, round(threshold, 6) AS threshold FROM best")
def w1(t: Tables) -> DataFrame:
    found = decide.quality_threshold(decide.with_reasons(summary_of(t)), TOLERANCE)
    return rounded(found.select(
        "run_id", F.col("best.candidate_id").alias("best_id"),
        F.col("best.mean_score").alias("best_quality"), "threshold",
    ))


def within_of(t: Tables) -> DataFrame:
    judged = decide.with_reasons(settled(t))
    return decide.within_tolerance(judged, decide.quality_threshold(judged, TOLERANCE))


@query("w2_footprint_kind", f"WITH {DECIDED} SELECT run_id, kind FROM kinds")
def w2(t: Tables) -> DataFrame:
    return decide.footprint_kind(within_of(t))


@query("w3_pick", f"WITH {DECIDED} SELECT run_id, kind, pick_id, round(pick_mib, 6) AS pick_mib "
       "FROM picks")
def w3(t: Tables) -> DataFrame:
    within = within_of(t)
    found = decide.pick(within, decide.footprint_kind(within))
    return rounded(found.select(
        "run_id", "kind", F.col("pick.candidate_id").alias("pick_id"),
        F.col("pick.mib").alias("pick_mib"),
    ))


RECOMMENDED = f"""{DECIDED},
placed AS (SELECT j.*, b.best_quality, b.threshold, p.kind, p.pick_id, p.pick_name, p.pick_mib,
  CASE p.kind WHEN 'vram' THEN coalesce(j.measured_peak_mib, 'infinity'::DOUBLE)
    WHEN 'none' THEN 0.0 WHEN 'weights' THEN j.size_bytes / {MIB} END AS mib
  FROM judged j LEFT JOIN best b ON j.run_id = b.run_id LEFT JOIN picks p ON j.run_id = p.run_id),
roles AS (SELECT *, CASE WHEN pick_id IS NULL THEN 'nearest-miss'
  WHEN pick_id = candidate_id THEN 'pick' ELSE 'runner-up' END AS role,
  CASE WHEN blocked IS NOT NULL THEN 'blocked' WHEN mean_score < threshold THEN 'below-tolerance'
  WHEN kind = 'none' THEN 'slower' WHEN mib - pick_mib = 0 THEN 'tie-break'
  ELSE 'larger' END AS outcome FROM placed)"""


@query("w12_runner_up_reason", f"WITH {RECOMMENDED} SELECT run_id, candidate_id, "
       "outcome AS runner_up_case FROM roles WHERE role = 'runner-up'")
def w12(t: Tables) -> DataFrame:
    return decide.recommend(settled(t), TOLERANCE).filter("role = 'runner-up'").select(
        "run_id", "candidate_id", "runner_up_case"
    )


RECOMMEND_SQL = f"""WITH {RECOMMENDED}
SELECT run_id, candidate_id, role, CASE WHEN pick_id IS NULL THEN 'none' ELSE 'recommended' END
  AS kind, kind AS footprint_kind, round(mean_score, 6) AS quality,
  round(threshold, 6) AS threshold,
  round(CASE WHEN mib < 'infinity'::DOUBLE THEN mib END, 3) AS footprint_mib FROM roles"""


def recommendation(t: Tables) -> DataFrame:
    finite = F.when(F.col("footprint_mib") < float("inf"), F.col("footprint_mib"))
    return rounded(decide.recommend(settled(t), TOLERANCE).select(
        "run_id", "candidate_id", "role", "kind", "footprint_kind", "quality", "threshold",
        F.round(finite, 3).alias("footprint_mib"),
    ))


@query("r3_recommend", RECOMMEND_SQL)
def r3(t: Tables) -> DataFrame:
    return recommendation(t)


def masked(reason) -> Column:
    """A reason with # for its numbers, which r3_recommend compares by value."""
    return F.regexp_replace(reason, r"-?[0-9]+(\.[0-9]+)?", "#")


REASONED = f"""{RECOMMENDED},
told AS (SELECT r.*, CASE WHEN pick_id IS NULL THEN coalesce(blocked, 'not eligible')
  WHEN role = 'pick' AND kind = 'none' THEN pick_name || ' has the best measured quality (0) at 0 tok/s among '
    || 'gate-passing candidates; this is an API backend run, so the ranking uses quality and latency only '
    || '(no local footprint applies).'
  WHEN role = 'pick' AND pick_id = best_id THEN pick_name || ' has the best measured quality (0) and the smallest '
    || 'footprint (0' || size || ') among the candidates within the quality tolerance.'
  WHEN role = 'pick' THEN pick_name || ' holds quality 0, within 0% of the best (0 from ' || best_name || '), at 0'
    || size || ' versus 0 MiB.'
  WHEN outcome = 'blocked' THEN blocked
  WHEN outcome = 'below-tolerance' THEN 'quality 0 is 0% below the best 0, outside the tolerance'
  WHEN outcome = 'slower' THEN 'same quality band but 0 tok/s median versus 0 for ' || pick_name
  WHEN outcome = 'tie-break' THEN 'identical footprint to ' || pick_name
    || '; lost the tie-break on quality, then throughput'
  ELSE 'same quality band but ' || CASE WHEN mib = 'infinity'::DOUBLE THEN 'Infinity' ELSE '0' END
    || CASE kind WHEN 'vram' THEN ' MiB more peak memory than ' ELSE ' MiB more weights than ' END || pick_name END AS reason
  FROM (SELECT roles.*, b.best_id, b.best_name, CASE kind WHEN 'vram' THEN ' MiB peak memory'
      ELSE ' MiB weights on disk (peak memory was not measured on this run)' END AS size
    FROM roles LEFT JOIN best b ON roles.run_id = b.run_id) r)"""
MASKED = "regexp_replace(reason, '-?[0-9]+(\\.[0-9]+)?', '#', 'g') AS reason"


@query("r3_reasons", f"WITH {REASONED} SELECT run_id, candidate_id, role, {MASKED} FROM told")
def r3_reasons(t: Tables) -> DataFrame:
    found = decide.recommend(settled(t), TOLERANCE)
    return found.select("run_id", "candidate_id", "role", masked("reason").alias("reason"))


@query("r3_outcomes", f"""WITH {RECOMMENDED},
chosen AS (SELECT run_id, max(CASE WHEN role = 'pick' THEN model_name END) AS pick FROM roles
  WHERE run_id <> 3 GROUP BY run_id),
held AS (SELECT DISTINCT run_id FROM candidates)
SELECT n_nationkey AS run_id, CASE WHEN pick IS NULL THEN 'none' ELSE 'recommended' END AS kind, pick,
  CASE WHEN held.run_id IS NULL THEN 'no candidates were evaluated' WHEN pick IS NULL THEN
    'no candidate passed all gate scorers, so nothing is recommendable on this task' END AS why_none
FROM nation LEFT JOIN held ON n_nationkey = held.run_id LEFT JOIN chosen ON n_nationkey = chosen.run_id""")
def r3_outcomes(t: Tables) -> DataFrame:
    """One row per run; no candidate of run 3 completed, and most runs have none at all."""
    stopped = F.when((F.col("run_id") == 3) & (F.col("status") == "completed"), "failed").otherwise(F.col("status"))
    every = t["nation"].select(F.col("n_nationkey").cast("bigint").alias("run_id"))
    found = decide.outcomes(settled(t).withColumn("status", stopped), TOLERANCE, every)
    return found.select(
        "run_id", "kind", F.col("model_name").alias("pick"),
        F.when(F.col("kind") == "none", F.col("reason")).alias("why_none"))


@query("t3_nearest_misses", f"""WITH {JUDGED} SELECT run_id, candidate_id,
  row_number() OVER (PARTITION BY run_id ORDER BY round(coalesce(mean_score, 0), 12) DESC,
  candidate_seq) AS place FROM judged""")
def t3(t: Tables) -> DataFrame:
    ordered = Window.partitionBy("run_id").orderBy(
        decide.quality_rank("mean_score"), "candidate_seq"
    )
    place = F.row_number().over(ordered).cast("bigint").alias("place")
    return decide.nearest_misses(summary_of(t)).select("run_id", "candidate_id", place)


OFFLOAD = f"""WITH {cte('candidates')},
c AS (SELECT *, {RATED} AS rate FROM candidates WHERE status = 'completed'),
band AS (SELECT a.run_id, a.candidate_id, max(b.rate) AS best_peer,
  string_agg(b.model_name, ', ' ORDER BY b.candidate_seq) AS peers
  FROM c a JOIN c b ON a.run_id = b.run_id AND a.candidate_id <> b.candidate_id
    AND b.rate IS NOT NULL
    AND b.size_bytes >= a.size_bytes * 0.5 AND b.size_bytes <= a.size_bytes * 2.0
  GROUP BY a.run_id, a.candidate_id)
SELECT * FROM (SELECT c.run_id, c.candidate_id,
  CASE WHEN measured_peak_mib < predicted_peak_mib * 0.6 THEN 'plateau'
       WHEN rate < best_peer * 0.25 THEN 'collapse' END AS rule,
  CASE WHEN coalesce(measured_peak_mib < predicted_peak_mib * 0.6, false) THEN NULL
       WHEN rate < best_peer * 0.25 THEN peers END AS peers
  FROM c LEFT JOIN band ON c.run_id = band.run_id AND c.candidate_id = band.candidate_id)
WHERE rule IS NOT NULL"""


@query("r10_offload_suspects", OFFLOAD)
def r10(t: Tables) -> DataFrame:
    return decide.offload_suspects(rated(t)).select("run_id", "candidate_id", "rule", "peers")


@query("r4_comparison", f"""WITH {SUMMARY}
SELECT run_id, candidate_id, CASE WHEN fit_verdict = 'not-applicable' THEN '-'
    ELSE coalesce(quantization, '?') END AS quantization,
  CASE WHEN fit_verdict = 'not-applicable' THEN 'n/a' WHEN measured_peak_mib IS NULL THEN 'n/m'
    ELSE 'measured' END AS peak_kind,
  CASE WHEN mean_score IS NULL THEN '-' WHEN score_max - score_min < 1e-9 THEN 'flat'
    ELSE 'spread' END AS quality_kind, {FLAG_SQL} AS flags FROM summary""")
def r4(t: Tables) -> DataFrame:
    peak, quality = F.col("peak_mib"), F.col("quality")
    return R.comparison(summary_of(t)).select(
        "run_id", "candidate_id", "quantization",
        F.when(peak.isin("n/a", "n/m"), peak).otherwise("measured").alias("peak_kind"),
        F.when(quality == "-", "-").when(quality.contains(".."), "spread").otherwise("flat")
        .alias("quality_kind"),
        "flags",
    )


@query("r4_flag_legend", f"""WITH {SUMMARY}
SELECT run_id, model_name, token FROM summary, unnest(string_split({FLAG_SQL}, ',')) u(token)
WHERE token <> ''""")
def r4_legend(t: Tables) -> DataFrame:
    return R.flag_legend(summary_of(t)).select("run_id", "model_name", "token")


@query("r6_report", f"""WITH {REASONED}{CLASSED.removeprefix(JUDGED)}
SELECT t.run_id, t.candidate_id, c.class, t.role, {MASKED.replace('reason,', 't.reason,')}
FROM told t JOIN classed c ON t.run_id = c.run_id AND t.candidate_id = c.candidate_id""")
def r6(t: Tables) -> DataFrame:
    tables = R.report(t["units"], t["candidates"], TOLERANCE)
    classes = tables["frontier"].select("run_id", "candidate_id", "class")
    return tables["recommendation"].join(classes, ["run_id", "candidate_id"]).select(
        "run_id", "candidate_id", "class", "role", masked("reason").alias("reason")
    )


@query("f11_formatters", """
SELECT p_partkey, printf('%.3f', CAST(p_size AS DOUBLE) / 8) AS score_text,
  printf('%.0f', CAST(p_size AS DOUBLE)) AS whole_text,
  CASE WHEN p_size >= 25 THEN '+' ELSE '' END || printf('%.1f', CAST(p_size - 25 AS DOUBLE))
    AS percent_text,
  left(p_name, 12) AS digest
FROM part""")
def f11(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("double")
    return t["part"].select(
        "p_partkey", display.score(size / 8).alias("score_text"),
        display.whole(size).alias("whole_text"),
        display.signed_percent(size - 25).alias("percent_text"),
        display.short_digest(F.col("p_name")).alias("digest"),
    )


@query("t5_order_units", over_units(
    "SELECT run_id, candidate_id, example_id, repetition, unit_id FROM units"))
def t5(t: Tables) -> DataFrame:
    return planning.order_units(
        t["units"].select("run_id", "candidate_id", "example_id", "repetition", "unit_id")
    )


@query("w6_newest_resumable", f"""WITH {cte('units')},
r AS (SELECT CAST(n_nationkey AS BIGINT) AS run_id, n_nationkey AS run_seq,
  CAST((n_nationkey * 7) % 25 AS BIGINT) AS created_at_ms FROM nation)
SELECT run_id FROM r WHERE run_id IN (SELECT run_id FROM units WHERE status = 'pending')
ORDER BY created_at_ms DESC, run_seq DESC LIMIT 1""")
def w6(t: Tables) -> DataFrame:
    runs = t["nation"].selectExpr(
        "CAST(n_nationkey AS BIGINT) AS run_id", "n_nationkey AS run_seq",
        "CAST((n_nationkey * 7) % 25 AS BIGINT) AS created_at_ms",
    )
    return planning.newest_resumable(runs, t["units"])


@query("f11_rounding", """
SELECT l_orderkey, l_linenumber, printf('%.3f', l_extendedprice / 7) AS score_text,
  CASE WHEN (2 * l_partkey + 1) % 125 = 0 THEN printf('%.3f', (l_partkey + 1) / 1000.0::DOUBLE)
    ELSE printf('%.3f', (2 * l_partkey + 1) / 2000.0::DOUBLE) END AS tie_text
FROM lineitem""")
def f11_rounding(t: Tables) -> DataFrame:
    """Values next to a tie round by their binary value; true ties (multiples of 1/16) go up."""
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber",
        display.score(F.col("l_extendedprice").cast("double") / 7).alias("score_text"),
        display.score((2 * F.col("l_partkey") + 1) / F.lit(2000.0)).alias("tie_text"),
    )
