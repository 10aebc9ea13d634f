"""Planning, listing and ordering queries over supplier, part, nation, orders and lineitem."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import fit
from gradelake.operators import aggregates as A
from gradelake.operators import joins as J
from gradelake.operators import sets as U
from gradelake.plans import planning as P
from gradelake.session import shared_folder
from gradelake.sources import journal, packs
from workload.registry import Tables, cte, query, view
from workload.telemetry import INFO, KNOWN, KV

view(
    "examples", "part",
    "p_brand AS pack", "p_partkey AS example_id", "p_name", "p_size",
)
FREE = 8000.0
SIZE = "CAST(round((s_acctbal + 1000) * 1000000) AS BIGINT)"


def models(t: Tables) -> DataFrame:
    return t["supplier"].select(
        F.col("s_suppkey").alias("candidate_seq"), F.lower("s_name").alias("model_name"),
        F.expr(SIZE).alias("size_bytes"), "s_nationkey",
    )


def known_architectures(t: Tables) -> DataFrame:
    return t["supplier"].select(
        F.lower("s_name").alias("model_name"),
        fit.architecture_from_info(F.expr(INFO)).alias("arch"),
    )


def assessed(t: Tables) -> DataFrame:
    return J.assess_fit(models(t), known_architectures(t), F.lit(4096), F.lit(FREE))


ASSESSED = f"""assessed AS (SELECT s_suppkey AS candidate_seq, lower(s_name) AS model_name,
  {SIZE} AS size_bytes, CASE WHEN NOT ({KNOWN}) THEN 'unknown'
    WHEN CAST({SIZE} AS DOUBLE) / 1048576 + {KV} + 1024 <= {FREE}::DOUBLE * 0.95::DOUBLE
    THEN 'fits' ELSE 'does-not-fit' END AS verdict FROM supplier)"""


@query("j8_assess_fit", f"WITH {ASSESSED} SELECT model_name, size_bytes, verdict FROM assessed")
def j8(t: Tables) -> DataFrame:
    return assessed(t).select("model_name", "size_bytes", F.col("fit.verdict").alias("verdict"))


@query("p6_plan_filter", f"""WITH {ASSESSED}
SELECT model_name, verdict <> 'does-not-fit' AS included,
  verdict = 'does-not-fit' AS has_reason FROM assessed""")
def p6(t: Tables) -> DataFrame:
    return P.plan_filter(assessed(t)).select(
        "model_name", "included", F.col("skip_reason").isNotNull().alias("has_reason")
    )


@query("u5_plan_union", f"""WITH {ASSESSED}
SELECT model_name, verdict <> 'does-not-fit' AS included FROM assessed""")
def u5(t: Tables) -> DataFrame:
    plan = P.plan_filter(assessed(t))
    rows = plan.select("model_name", "skip_reason", F.col("included").alias("runs"))
    merged = U.plan_union(
        rows.filter("runs").select("model_name"),
        rows.filter("NOT runs").select("model_name", "skip_reason"),
    )
    return merged.select("model_name", "included")


@query("t1_order_plan", f"""
SELECT model_name, size_bytes, row_number() OVER (ORDER BY size_bytes DESC, candidate_seq) AS place
FROM (SELECT s_suppkey AS candidate_seq, lower(s_name) AS model_name, {SIZE} AS size_bytes
  FROM supplier)""")
def t1(t: Tables) -> DataFrame:
    from gradelake.operators.scale import group_index

    ordered = P.order_plan(models(t)).withColumn("plan", F.lit(1))
    # Sizes fall along the order, so blocks of 2**28 bytes are the numbering buckets.
    placed = group_index(
        ordered, ["plan"], [F.desc("size_bytes"), F.col("candidate_seq")],
        -F.floor(F.col("size_bytes") / (1 << 28)), "i",
    )
    return placed.select("model_name", "size_bytes", (F.col("i") + 1).alias("place"))


@query("t2_recent_runs", f"""WITH {cte('runs')}
SELECT run_id, created_at_ms FROM runs ORDER BY created_at_ms DESC, run_seq DESC LIMIT 10""")
def t2(t: Tables) -> DataFrame:
    return P.recent_runs(t["runs"]).select("run_id", "created_at_ms")


@query("p3_pick_run", f"""WITH {cte('runs')}
SELECT 'newest' AS asked, (SELECT run_id FROM runs ORDER BY created_at_ms DESC, run_seq DESC LIMIT 1)
  AS run_id
UNION ALL SELECT 'prefix', (SELECT run_id FROM runs WHERE starts_with(run_id, 'run-nation_1')
  ORDER BY created_at_ms DESC, run_seq DESC LIMIT 1)""")
def p3(t: Tables) -> DataFrame:
    newest = P.pick_run(t["runs"]).select(F.lit("newest").alias("asked"), "run_id")
    named = P.pick_run(t["runs"], "run-nation_1").select(F.lit("prefix").alias("asked"), "run_id")
    return newest.unionByName(named)


@query("p2_limit_examples", f"""WITH {cte('examples')}
SELECT pack, example_id FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY example_id)
  AS r FROM examples) WHERE r <= 7""")
def p2(t: Tables) -> DataFrame:
    return P.limit_examples(t["examples"], 7).select("pack", "example_id")


@query("j9_work_plan", f"""WITH {cte('candidates', 'examples')}
SELECT c.candidate_id, e.example_id, r.repetition FROM candidates c
JOIN examples e ON c.pack = e.pack, (SELECT unnest([1, 2, 3]) AS repetition) r
WHERE r.repetition <= 1 + e.p_size % 3""")
def j9(t: Tables) -> DataFrame:
    plan = J.work_plan(t["candidates"], t["examples"], F.expr("1 + p_size % 3"))
    return plan.select("candidate_id", "example_id", "repetition")


@query("a20_estimate", f"""WITH {cte('candidates')},
u AS (SELECT l_suppkey, count(*) AS units FROM lineitem GROUP BY l_suppkey)
SELECT c.run_id, count(*) AS candidates, CAST(sum(CAST(floor(
  coalesce(u.units, 0) * (512 / 20.0::DOUBLE + 2) + 30 + 0.5) AS BIGINT)) AS BIGINT)
  AS total_seconds
FROM candidates c LEFT JOIN u ON u.l_suppkey = c.candidate_id GROUP BY c.run_id""")
def a20(t: Tables) -> DataFrame:
    return A.plan_estimate(plan_of(t))


def plan_of(t: Tables) -> DataFrame:
    units = t["lineitem"].groupBy(F.col("l_suppkey").alias("candidate_id")).agg(
        F.count(F.lit(1)).alias("units")
    )
    rate = F.when(F.col("candidate_id") % 5 == 3, F.col("measured_peak_mib") / 100)
    return t["candidates"].join(units, "candidate_id", "left").select(
        "run_id", "candidate_seq", F.coalesce("units", F.lit(0)).alias("units"),
        F.lit(512).alias("max_tokens"), rate.alias("rate"),
    )


@query("w9_remaining_time", f"""WITH {cte('candidates')},
u AS (SELECT l_suppkey, count(*) AS units FROM lineitem GROUP BY l_suppkey),
p AS (SELECT c.run_id, c.candidate_seq, coalesce(u.units, 0) AS units,
  CASE WHEN c.candidate_id % 5 = 3 THEN measured_peak_mib / 100 END AS rate
  FROM candidates c LEFT JOIN u ON u.l_suppkey = c.candidate_id),
r AS (SELECT *, first_value(rate IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY candidate_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
  row_number() OVER (PARTITION BY run_id ORDER BY candidate_seq) - 1 AS position,
  count(*) OVER (PARTITION BY run_id) AS n FROM p)
SELECT run_id, candidate_seq, position, CAST(floor(
  units * (512 / coalesce(known, 20.0::DOUBLE) + 2) + 30 + 0.5) AS BIGINT) * (n - position)
  AS seconds_left FROM r""")
def w9(t: Tables) -> DataFrame:
    return P.remaining_time(plan_of(t)).select(
        "run_id", "candidate_seq", "position", "seconds_left"
    )


def two_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    remote = (F.col("s_nationkey") % 6 == 0).alias("remote")
    explicit = t["supplier"].filter("s_nationkey < 12").select(
        F.col("s_suppkey").alias("seq"),
        F.concat(F.lit("m"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), remote,
        F.expr(SIZE).alias("size_bytes"), F.lit(None).cast("string").alias("quantization"),
        F.lit("4b").alias("parameter_size"),
    )
    local = t["supplier"].select(
        F.col("s_suppkey").alias("seq"),
        F.concat(F.lit("m"), (F.col("s_suppkey") % 90).cast("string")).alias("name"), remote,
        F.expr(SIZE).alias("size_bytes"), F.lit("Q4").alias("quantization"),
        F.lit(None).cast("string").alias("parameter_size"),
    )
    return explicit, local


MERGED = f"""merged AS (SELECT * FROM (
  SELECT 0 AS part, s_suppkey AS seq, 'm' || (s_suppkey % 60) AS name, s_nationkey % 6 = 0 AS remote,
    {SIZE} AS size_bytes, NULL AS quantization, '4b' AS parameter_size
  FROM supplier WHERE s_nationkey < 12
  UNION ALL SELECT 1, s_suppkey, 'm' || (s_suppkey % 90), s_nationkey % 6 = 0, {SIZE}, 'Q4', NULL
  FROM supplier)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY part, seq) = 1)"""


@query("u1_merge_candidates", f"""WITH {MERGED}
SELECT name, part, seq, CASE WHEN remote THEN 'remote (' || CASE part WHEN 0 THEN 'from run config'
  ELSE 'from local store' END || '); cloud models cannot be measured locally' END
  AS excluded_reason FROM merged""")
def u1(t: Tables) -> DataFrame:
    return U.merge_candidates(*two_lists(t)).select("name", "part", "seq", "excluded_reason")


@query("p7_exclude_remote", """
SELECT s_suppkey, CASE WHEN s_nationkey % 6 = 0 THEN
  'remote (from local store); cloud models cannot be measured locally' END AS excluded_reason
FROM supplier""")
def p7(t: Tables) -> DataFrame:
    listed = t["supplier"].select(
        "s_suppkey", (F.col("s_nationkey") % 6 == 0).alias("remote"),
        F.lit("from local store").alias("origin"),
    )
    return U.exclude_remote(listed).select("s_suppkey", "excluded_reason")


@query("r9_model_listing", f"""WITH {MERGED}
SELECT name AS model_name, coalesce(quantization, '?') AS quantization,
  coalesce(parameter_size, '?') AS parameter_size,
  round(size_bytes / 1048576.0::DOUBLE, 4) AS weights_mib,
  CASE WHEN NOT remote THEN verdict END AS verdict, remote OR verdict <> 'fits' AS has_note
FROM (SELECT m.*, CASE WHEN s_suppkey IS NULL OR NOT ({KNOWN}) THEN 'unknown'
    WHEN CAST(size_bytes AS DOUBLE) / 1048576 + {KV} + 1024 <= {FREE}::DOUBLE * 0.95::DOUBLE
    THEN 'fits' ELSE 'does-not-fit' END AS verdict
  FROM merged m LEFT JOIN supplier ON m.name = 'm' || s_suppkey)""")
def r9(t: Tables) -> DataFrame:
    named = t["supplier"].select(
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("model_name"),
        fit.architecture_from_info(F.expr(INFO)).alias("arch"),
    )
    listing = P.model_listing(*two_lists(t), named, F.lit(4096), F.lit(FREE))
    return listing.select(
        "model_name", "quantization", "parameter_size",
        F.round("weights_mib", 4).alias("weights_mib"), "verdict",
        F.col("note").isNotNull().alias("has_note"),
    )


@query("j11_drift", """
WITH s AS (SELECT o_orderkey AS run_id, o_orderstatus AS p, CASE WHEN o_orderkey % 3 <> 0
    THEN 'cfg' END AS path, o_orderpriority AS c FROM orders WHERE o_orderpriority <> '1-URGENT'),
n AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END
    AS p, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'new'
    ELSE o_orderpriority END AS c FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(s.run_id, n.run_id) AS run_id, CASE WHEN s.run_id IS NULL THEN 'not planned'
  WHEN s.p IS DISTINCT FROM n.p THEN 'pack changed'
  WHEN path IS NOT NULL AND n.c IS NULL THEN 'config unreadable'
  WHEN path IS NOT NULL AND n.c <> s.c THEN 'config changed' END AS drift
FROM s FULL JOIN n ON s.run_id = n.run_id""")
def j11(t: Tables) -> DataFrame:
    stored = t["orders"].filter("o_orderpriority <> '1-URGENT'").selectExpr(
        "o_orderkey AS run_id", "o_orderstatus AS pack_fingerprint",
        "CASE WHEN o_orderkey % 3 <> 0 THEN 'cfg' END AS config_path",
        "o_orderpriority AS config_fingerprint",
    )
    current = t["orders"].filter("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey AS run_id",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END AS pack_fingerprint",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'new' "
        "ELSE o_orderpriority END AS config_fingerprint",
    )
    return J.drift(stored, current).select("run_id", "drift")


@query("s12_unit_results", f"""WITH {cte('units')}
SELECT unit_id, candidate_id, example_id, repetition, status FROM units WHERE run_id = 3""")
def s12(t: Tables) -> DataFrame:
    return journal.unit_results(t["units"], 3).select(
        "unit_id", "candidate_id", "example_id", "repetition", "status"
    )


@query("s12_candidates", f"""WITH {cte('candidates')}
SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY candidate_seq) AS place
FROM candidates WHERE run_id = 2""")
def s12_candidates(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("candidate_seq"))
    return journal.candidates(t["candidates"], 2).select(
        "run_id", "candidate_id", place.cast("bigint").alias("place")
    )


@query("s12_runs", f"WITH {cte('runs')} SELECT run_id, created_at_ms FROM runs")
def s12_runs(t: Tables) -> DataFrame:
    return journal.runs(t["runs"]).select("run_id", "created_at_ms")


@query("s14_draft_ids", """
SELECT p_brand AS pack, p_partkey AS seq, lpad(CAST(row_number() OVER (
  PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR), greatest(3, CAST(length(CAST(count(*) OVER (
  PARTITION BY p_brand) AS VARCHAR)) AS INT)), '0') AS example_id FROM part""")
def s14(t: Tables) -> DataFrame:
    rows = t["part"].selectExpr("p_brand AS pack", "p_partkey AS seq", "p_name AS input")
    return packs.draft_ids(rows).select("pack", "seq", "example_id")


@query("s13_export", f"""WITH {cte('units', 'candidates')},
named AS (SELECT u.*, c.model_name FROM units u JOIN candidates c ON u.candidate_id = c.candidate_id)
SELECT 'units' AS table_name, count(*) AS n, count(DISTINCT model_name) AS models FROM named
UNION ALL SELECT 'outputs', count(*), count(DISTINCT model_name) FROM named WHERE output IS NOT NULL
UNION ALL SELECT 'scores', count(*), 0 FROM named WHERE output IS NOT NULL AND score IS NOT NULL
UNION ALL SELECT 'candidates', count(*), count(DISTINCT model_name) FROM candidates
UNION ALL SELECT 'run', count(*), 0 FROM runs""".replace("FROM runs", "FROM nation"))
def s13(t: Tables) -> DataFrame:
    """What an export holds, read back from its own tables once its manifest agrees."""
    models = t["candidates"].select("candidate_id", "model_name")
    units = t["units"].join(models, "candidate_id").withColumns({
        "pack": F.lit("demo"), "details": F.lit(None).cast("string"), "repetition": F.col("repetition").cast("int")})
    folder = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    journal.write_export(units, t["candidates"], folder, run=t["runs"])
    tables = journal.read_export(t.spark, folder)
    counts = [
        table.select(
            F.lit(name).alias("table_name"),
            (F.col("model_name") if "model_name" in table.columns else F.lit(None).cast("string")).alias("model_name"))
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("model_name").alias("models"))
