"""Query registry and the views the queries share.

A view is a select list that means the same in Spark and in the SQL twin, over
one whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradelake.operators.scale import spread_small
from gradelake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS: dict[str, tuple[str, list[str]]] = {}


def view(name: str, table: str, *columns: str) -> None:
    VIEWS[name] = (table, list(columns))


def cte(*names: str) -> str:
    """The views as common table expressions, without WITH."""
    parts = []
    for name in names:
        table, columns = VIEWS[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {table})")
    return ",\n".join(parts)


class Tables:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in VIEWS:
            table, columns = VIEWS[name]
            return self[table].selectExpr(*columns)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A view for work that is heavy per row: small tables are spread over all cores."""
        return spread_small(self[name])


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with its SQL twin if there is one."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_DONE = "l_returnflag <> 'R'"
view(
    "units", "lineitem",
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), "
    "CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS unit_id",
    "l_suppkey % 7 AS run_id",
    "l_suppkey AS candidate_id",
    "l_partkey % 20 AS example_id",
    "l_linenumber AS repetition",
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' "
    "WHEN l_returnflag = 'R' AND l_tax < 0.04 THEN 'pending' "
    "WHEN l_returnflag = 'R' THEN 'skipped' ELSE 'completed' END AS status",
    f"CASE WHEN {_DONE} THEN 1 - l_discount * 10 END AS score",
    f"CASE WHEN {_DONE} THEN l_discount < 0.005 END AS pass",
    f"CASE WHEN {_DONE} AND l_suppkey % 4 = 0 AND l_tax > 0.075 THEN 'json-schema' "
    f"WHEN {_DONE} AND l_suppkey % 8 = 0 AND l_tax > 0.065 THEN 'pattern' END AS failed_gate",
    f"CASE WHEN {_DONE} THEN CASE WHEN l_suppkey % 13 = 0 THEN '  ' "
    "WHEN l_suppkey % 3 = 0 THEN concat(l_returnflag, l_linestatus) "
    "ELSE concat('out-', CAST(l_partkey % 20 AS STRING)) END END AS output",
    f"CASE WHEN {_DONE} THEN CASE WHEN l_quantity >= 25 THEN 'length' ELSE 'stop' END END "
    "AS done_reason",
    f"CASE WHEN {_DONE} AND l_quantity > 2 THEN l_quantity * 10 END AS ttft_ms",
    f"CASE WHEN {_DONE} AND l_quantity > 2 THEN l_extendedprice / 1000 END AS tokens_per_second",
    f"CASE WHEN {_DONE} AND l_quantity > 1 THEN l_extendedprice / 10 END AS wall_ms",
    f"CASE WHEN {_DONE} AND l_quantity > 1 THEN CAST(l_quantity AS BIGINT) * 10 END "
    "AS prompt_token_count",
    f"CASE WHEN {_DONE} THEN CAST(l_linenumber AS BIGINT) * 5 END AS output_token_count",
)
view(
    "candidates", "supplier",
    "s_suppkey % 7 AS run_id",
    "s_suppkey AS candidate_id",
    "s_suppkey AS candidate_seq",
    "lower(replace(s_name, '#', '-')) AS model_name",
    "CASE WHEN s_suppkey % 17 = 0 THEN CAST(0 AS BIGINT) "
    "ELSE CAST(round((s_acctbal + 1000) * 1000000) AS BIGINT) END AS size_bytes",
    "CASE WHEN s_suppkey % 10 = 0 THEN 'oom' WHEN s_suppkey % 10 = 5 THEN 'failed' "
    "WHEN s_suppkey % 23 = 1 THEN 'running' ELSE 'completed' END AS status",
    "CASE WHEN s_suppkey % 20 = 0 THEN 'cuda out of memory' END AS status_reason",
    "CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal + 2500 END AS predicted_peak_mib",
    "CASE WHEN s_suppkey % 6 <> 0 "
    "THEN (s_acctbal + 2500) * (0.5 + (s_suppkey % 5) * 0.15) END AS measured_peak_mib",
    "CASE WHEN s_suppkey % 7 = 3 THEN 'q8' END AS quantization",
    "CASE WHEN s_suppkey % 9 = 4 THEN 'not-applicable' ELSE 'fits' END AS fit_verdict",
    "CASE WHEN s_suppkey % 19 = 2 THEN 'suspected cpu/gpu split' END AS offload_suspect_reason",
    "concat('Brand#', CAST(s_nationkey + 1 AS STRING)) AS pack",
)
view(
    "runs", "nation",
    "n_nationkey AS run_seq",
    "concat('run-', lower(n_name)) AS run_id",
    "CAST(1700000000000 AS BIGINT) + CAST((n_nationkey * 7) % 25 AS BIGINT) * 86400000 "
    "AS created_at_ms",
    "CASE n_nationkey % 3 WHEN 0 THEN 'ollama 0.24.0' WHEN 1 THEN 'rapid-mlx 0.6.0' "
    "ELSE 'anthropic api' END AS backend_version",
    "n_nationkey",
    "n_regionkey",
)
view(
    "samples", "events",
    "user_id AS candidate_id", "CAST(ts AS TIMESTAMP) AS at", "value AS used_mib", "event_id AS sample_id",
)
