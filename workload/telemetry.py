"""Telemetry, logs, listings and streams over events, nation and supplier."""

from __future__ import annotations

import itertools
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions import fit
from gradelake.functions.predicates import is_oom_suspect
from gradelake.operators import aggregates as A
from gradelake.operators import joins as J
from gradelake.operators import telemetry as M
from gradelake.operators.scale import keep_first
from gradelake.session import shared_folder
from gradelake.sources import logs, packs
from gradelake.streaming import jobs as X
from workload.registry import VIEWS, Tables, cte, query, view
from workload.scoring import SCORED, example_rows, specs


def us(c):
    return F.unix_micros(c)


@query("a12_peak_memory", f"""WITH {cte('samples')}
SELECT candidate_id, max(used_mib) AS peak_mib, count(used_mib) AS n_samples FROM samples
GROUP BY candidate_id""")
def a12(t: Tables) -> DataFrame:
    return A.peak_memory(t["samples"])


TIMED = """SELECT user_id AS generation_id, count(*) FILTER (WHERE event_type <> 'error') AS n,
  min(ts) FILTER (WHERE event_type <> 'error') AS f,
  max(ts) FILTER (WHERE event_type <> 'error') AS l, min(ts) AS s, max(ts) AS e
  FROM events GROUP BY user_id"""


@query("a13_generation_timing", f"""
SELECT generation_id, round(CAST(epoch_us(f) - epoch_us(s) AS DOUBLE) / 1000.0, 3) AS ttft_ms,
  CASE WHEN n >= 2 AND epoch_us(l) > epoch_us(f) THEN
    round((n - 1) * 1000.0 / (CAST(epoch_us(l) - epoch_us(f) AS DOUBLE) / 1000.0), 9) END
    AS tokens_per_second,
  round(CAST(epoch_us(e) - epoch_us(s) AS DOUBLE) / 1000.0, 3) AS wall_ms, n AS token_count
FROM ({TIMED})""")
def a13(t: Tables) -> DataFrame:
    events = t["events"].withColumn("at", F.col("ts").cast("timestamp"))
    spans = events.groupBy(F.col("user_id").alias("generation_id")).agg(
        F.min("at").alias("started_at"), F.max("at").alias("finished_at")
    )
    tokens = events.filter("event_type <> 'error'").select(
        F.col("user_id").alias("generation_id"), "at"
    )
    timing = A.generation_timing(tokens, spans)
    return timing.select(
        "generation_id", F.round("ttft_ms", 3).alias("ttft_ms"),
        F.round("tokens_per_second", 9).alias("tokens_per_second"),
        F.round("wall_ms", 3).alias("wall_ms"), "token_count",
    )


@query("a14_assemble_output", """
SELECT user_id AS generation_id, md5(string_agg(event_type || props, '' ORDER BY event_id))
  AS digest FROM events GROUP BY user_id""")
def a14(t: Tables) -> DataFrame:
    tokens = t["events"].select(
        F.col("user_id").alias("generation_id"), F.col("event_id").alias("seq"),
        F.concat("event_type", "props").alias("text"),
    )
    return A.assemble_output(tokens).select("generation_id", F.md5("output").alias("digest"))


view(
    "process_lines", "events", "event_id", "user_id AS tick",
    """concat('  ', CAST(CAST(round(value * 100) AS BIGINT) AS STRING), ' /usr/bin/',
 upper(event_type), ' --serve') AS line""",
)
RSS = """SELECT tick, CAST(floor(sum(kib) / 1024.0 + 0.5) AS BIGINT) AS used_mib FROM (
  SELECT user_id AS tick, CASE WHEN event_type IN ('click', 'view') THEN
    CAST(round(value * 100) AS BIGINT) ELSE 0 END AS kib FROM events) GROUP BY tick"""


@query("s8_rss_by_tick", RSS)
def s8(t: Tables) -> DataFrame:
    return logs.rss_by_tick(t.spread("process_lines"), ["CLICK", "view"])


@query("a17_process_memory", """
SELECT tick, CAST(floor(sum(kib) / 1024.0 + 0.5) AS BIGINT) AS used_mib FROM (
  SELECT user_id AS tick, CAST(round(value * 100) AS BIGINT) AS kib FROM events) GROUP BY tick""")
def a17(t: Tables) -> DataFrame:
    return A.process_memory(
        t["events"].selectExpr("user_id AS tick", "CAST(round(value * 100) AS BIGINT) AS rss_kib")
    )


CAP = 16


@query("w4_decimate", f"""
SELECT sample_id, candidate_id FROM (
  SELECT event_id AS sample_id, user_id AS candidate_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE (i < {CAP} AND i % (1 << greatest(0, CASE WHEN n < {CAP} THEN 0
        ELSE 1 + (n - {CAP}) // {CAP // 2} END)) = 0)
  OR (i >= {CAP} AND (1 << ((n - {CAP}) // {CAP // 2} - (i - {CAP}) // {CAP // 2}))
        <= {CAP // 2}
      AND ((i - {CAP}) % {CAP // 2})
        % (1 << ((n - {CAP}) // {CAP // 2} - (i - {CAP}) // {CAP // 2})) = 0)""")
def w4(t: Tables) -> DataFrame:
    return M.decimate(t["samples"], CAP).select("sample_id", "candidate_id")


@query("w5_sample_offsets", """
SELECT event_id AS sample_id, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (
  PARTITION BY user_id)) / 1000.0 + 0.5) AS BIGINT) AS offset_ms FROM events""")
def w5(t: Tables) -> DataFrame:
    return M.sample_offsets(t["samples"]).select("sample_id", "offset_ms")


@query("w11_settle_audit", """
WITH u AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS unloaded_at,
    CASE WHEN user_id % 9 <> 0 THEN CAST(user_id % 200 AS DOUBLE) END AS baseline
    FROM events GROUP BY user_id),
s AS (SELECT e.user_id, min(e.ts) AS settled_at FROM events e JOIN u ON e.user_id = u.user_id
  WHERE e.ts >= u.unloaded_at AND e.value <= u.baseline + 16 GROUP BY e.user_id)
SELECT u.user_id AS candidate_id,
  CASE WHEN baseline IS NULL THEN false
    WHEN settled_at IS NULL THEN true
    ELSE (epoch_us(settled_at) - epoch_us(unloaded_at)) / 1000.0 > 3600000 END AS flagged
FROM u LEFT JOIN s ON u.user_id = s.user_id""")
def w11(t: Tables) -> DataFrame:
    unloads = t["events"].groupBy(F.col("user_id").alias("candidate_id")).agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts").cast("timestamp"))).alias(
            "unloaded_at"
        )
    ).withColumn(
        "baseline_mib",
        F.when(F.col("candidate_id") % 9 != 0, (F.col("candidate_id") % 200).cast("double")),
    )
    return M.settle_audit(t["samples"], unloads, 16.0, 3600000.0).select(
        "candidate_id", "flagged"
    )


@query("w11_settle_twice", """
WITH u AS (SELECT user_id, event_type, max(ts) AS unloaded_at, CAST(user_id % 200 AS DOUBLE) AS baseline
    FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id, event_type),
s AS (SELECT e.user_id, u.event_type, min(e.ts) AS settled_at FROM events e
  JOIN u ON e.user_id = u.user_id
  WHERE e.ts >= u.unloaded_at AND e.value <= u.baseline + 16 GROUP BY e.user_id, u.event_type)
SELECT u.user_id AS candidate_id, u.event_type AS cause,
  (epoch_us(settled_at) - epoch_us(unloaded_at)) / 1000.0 AS waited_ms,
  coalesce((epoch_us(settled_at) - epoch_us(unloaded_at)) / 1000.0 > 3600000, true) AS flagged
FROM u LEFT JOIN s ON u.user_id = s.user_id AND u.event_type = s.event_type""")
def w11_twice(t: Tables) -> DataFrame:
    """Two unloads of each candidate, judged apart."""
    causes = t["events"].filter(F.col("event_type").isin("click", "purchase"))
    unloads = causes.groupBy(
        F.col("user_id").alias("candidate_id"), F.col("event_type").alias("cause")
    ).agg(F.max(F.col("ts").cast("timestamp")).alias("unloaded_at")).withColumn(
        "baseline_mib", (F.col("candidate_id") % 200).cast("double")
    )
    return M.settle_audit(t["samples"], unloads, 16.0, 3600000.0).select(
        "candidate_id", "cause", "waited_ms", "flagged"
    )


# Log and listing sources ---------------------------------------------------------

view(
    "log_lines", "events", "event_id", "user_id AS generation_id", "event_id AS seq",
    """CASE event_type WHEN 'click' THEN concat('{"response": "t', user_id, ' ", "done": false}')
 WHEN 'view' THEN concat('{"response": "", "done": true, "done_reason": "length", "eval_count": ',
  user_id, ', "prompt_eval_count": ', event_id, '}')
 WHEN 'purchase' THEN concat('{"error": "CUDA out of memory ', user_id, '"}')
 WHEN 'signup' THEN '   ' ELSE concat(props, ' trailing') END AS line""",
)


@query("s3_generation_log", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'token' WHEN 'view' THEN 'done'
    WHEN 'purchase' THEN 'error' ELSE 'bad' END AS kind,
  CASE WHEN event_type = 'click' THEN 't' || user_id || ' ' END AS text,
  CASE WHEN event_type = 'view' THEN 'length' END AS done_reason,
  CASE WHEN event_type = 'view' THEN user_id END AS output_token_count,
  CASE WHEN event_type = 'view' THEN event_id END AS prompt_token_count,
  CASE WHEN event_type = 'purchase' THEN 'CUDA out of memory ' || user_id END AS message,
  CASE WHEN event_type = 'error' THEN props || ' trailing' END AS quarantine
FROM events WHERE event_type <> 'signup'""")
def s3(t: Tables) -> DataFrame:
    return logs.parse_generation_log(t.spread("log_lines")).select(
        "event_id", "kind", "text", "done_reason", "output_token_count", "prompt_token_count",
        "message", "quarantine",
    )


view(
    "sse_lines", "events", "event_id", "user_id AS generation_id", "event_id AS seq",
    """CASE event_type
 WHEN 'click' THEN concat('data: {"choices": [{"delta": {"content": "w', user_id, '"}}]}')
 WHEN 'view' THEN concat('data: {"choices": [{"delta": {"content": ""}, "finish_reason": "stop"}],',
  ' "usage": {"prompt_tokens": ', event_id, ', "completion_tokens": 7}}')
 WHEN 'purchase' THEN 'data: not json' WHEN 'signup' THEN ': comment'
 ELSE CASE WHEN value > 200 THEN 'data: [DONE]' ELSE '' END END AS line""",
)


@query("s4_sse_log", """
WITH e AS (SELECT user_id, min(event_id) AS end_seq FROM events
  WHERE event_type = 'error' AND value > 200 GROUP BY user_id),
live AS (SELECT v.* FROM events v LEFT JOIN e ON v.user_id = e.user_id
  WHERE v.event_type IN ('click', 'view') AND (e.end_seq IS NULL OR v.event_id < e.end_seq))
SELECT g.user_id AS generation_id,
  max(CASE WHEN event_type = 'view' THEN 'stop' END) AS finish_reason,
  max(CASE WHEN event_type = 'view' THEN event_id END) AS prompt_tokens,
  count(*) FILTER (WHERE event_type = 'click') AS token_count,
  CASE WHEN count(*) FILTER (WHERE event_type = 'view') = 0 THEN 'stream ended without a finish_reason' END
    AS failure_reason
FROM (SELECT DISTINCT user_id FROM events) g LEFT JOIN live ON g.user_id = live.user_id
GROUP BY g.user_id""")
def s4(t: Tables) -> DataFrame:
    return logs.sse_generations(t.spread("sse_lines")).select(
        "generation_id", "finish_reason", "prompt_tokens", "token_count", "failure_reason",
    )


view(
    "listings", "supplier", "s_suppkey AS listing_id", "s_name", "s_acctbal", "s_nationkey",
    """concat('{"models": [{"name": "', s_name, ':latest", "size": ',
 CAST(CAST(floor(s_acctbal + 1000) AS BIGINT) AS STRING), ', "details": {"quantization_level": "',
 CASE WHEN s_nationkey % 2 = 0 THEN 'Q4' ELSE '' END, '"}},',
 ' {"name": "', s_name, '", "remote_host": "',
 CASE WHEN s_nationkey % 3 = 0 THEN 'cloud' ELSE '' END, '"}, {"digest": "no name"}]}') AS body""",
)


@query("s5_explode_models", """
SELECT s_suppkey AS listing_id, 0 AS seq, s_name || ':latest' AS name,
  CAST(floor(s_acctbal + 1000) AS BIGINT) AS size_bytes,
  CASE WHEN s_nationkey % 2 = 0 THEN 'Q4' END AS quantization, false AS remote FROM supplier
UNION ALL
SELECT s_suppkey, 1, s_name, 0, NULL, s_nationkey % 3 = 0 FROM supplier""")
def s5(t: Tables) -> DataFrame:
    return logs.explode_models(t["listings"]).select(
        "listing_id", "seq", "name", "size_bytes", "quantization", "remote"
    )


@query("s6_lookup_model", """
SELECT wanted, CASE WHEN s_suppkey IS NULL THEN NULL WHEN wanted = s_name THEN s_name || ':latest'
  ELSE s_name || ':latest' END AS name, size_bytes FROM (
  SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, 'Customer', 'Supplier')
    ELSE c_name END AS wanted FROM customer) w
LEFT JOIN (SELECT s_suppkey, s_name, CAST(floor(s_acctbal + 1000) AS BIGINT) AS size_bytes FROM supplier) s
ON w.wanted = s.s_name""")
def s6(t: Tables) -> DataFrame:
    listing = logs.explode_models(t["listings"]).select(
        (F.col("listing_id") * 10 + F.col("seq")).alias("seq"), "name", "size_bytes"
    )
    wanted = t["customer"].select(
        F.expr(
            "CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, 'Customer', 'Supplier') "
            "ELSE c_name END"
        ).alias("wanted")
    ).distinct()
    return J.lookup_model(wanted, listing)


@query("s7_gpu_samples", """
SELECT event_id, CAST(floor(value) AS BIGINT) AS used_mib FROM events
WHERE event_type NOT IN ('error', 'signup')""")
def s7(t: Tables) -> DataFrame:
    lines = t["events"].selectExpr(
        "event_id",
        "CASE event_type WHEN 'error' THEN 'N/A' WHEN 'signup' THEN '' "
        "WHEN 'view' THEN concat(' ', CAST(value AS STRING), ' MiB') "
        "ELSE CAST(floor(value) AS STRING) END AS line",
    )
    return logs.parse_gpu_samples(lines).select("event_id", "used_mib")


@query("s7_gpu_snapshot", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS free_mib,
  CASE WHEN event_type <> 'error' THEN user_id END AS used_mib,
  CASE WHEN event_type <> 'click' THEN 'GPU ' || user_id END AS name FROM events""")
def s7_snapshot(t: Tables) -> DataFrame:
    line = F.expr(
        "CASE WHEN event_type = 'error' THEN '12' "
        "ELSE concat(CAST(floor(value) AS STRING), ', ', user_id) END"
    )
    identity = F.expr(
        "CASE WHEN event_type = 'click' THEN concat(', 1.0, ', user_id) "
        "ELSE concat('GPU ', user_id, ', 550.1, 24576') END"
    )
    return t.spread("events").select(
        "event_id", logs.gpu_snapshot(line).alias("s"), logs.gpu_identity(identity).alias("g")
    ).select("event_id", "s.free_mib", "s.used_mib", "g.name")


@query("s9_meminfo", """
SELECT user_id, event_id, CAST(floor(total / 1024.0 + 0.5) AS BIGINT) AS total_mib,
  greatest(0, CAST(floor(total / 1024.0 + 0.5) AS BIGINT)
    - CAST(floor(avail / 1024.0 + 0.5) AS BIGINT)) AS used_mib
FROM (SELECT *, user_id * 100000 + 5 AS total, CAST(floor(value * 20000) AS BIGINT) AS avail FROM events)""")
def s9(t: Tables) -> DataFrame:
    text = F.expr(
        "concat('Junk: 1 kB\\nMemTotal:       ', user_id * 100000 + 5, ' kB\\nMemFree: 3 kB\\n',"
        " 'MemAvailable:   ', CAST(floor(value * 20000) AS BIGINT), ' kB\\n')"
    )
    return t.spread("events").select("user_id", "event_id", logs.parse_meminfo(text).alias("m")).select(
        "user_id", "event_id", "m.total_mib", "m.used_mib"
    )


@query("s10_status", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN
  CAST(floor(CAST(user_id AS DOUBLE) / 8 * 1024 + 0.5) AS BIGINT) END AS active_mib FROM events""")
def s10(t: Tables) -> DataFrame:
    body = F.expr(
        "CASE WHEN event_type = 'error' THEN '{\"metal\": {\"active_memory_gb\": \"x\"}}' "
        "ELSE concat('{\"metal\": {\"active_memory_gb\": ', CAST(user_id AS DOUBLE) / 8, '}}') END"
    )
    return t.spread("events").select("event_id", logs.parse_status(body).alias("active_mib"))


HOST_FILES = r"""f AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS pack, page_id, url, html FROM pages)"""


@query("a15_host_fingerprint", f"""WITH {HOST_FILES},
p AS (SELECT pack, concat(page_id % 3, '/', page_id, '.html') AS path, html FROM f UNION ALL
  SELECT pack, concat(page_id % 3, '.txt') || page_id, url FROM f)
SELECT pack, sha256(string_agg(path || chr(0) || html || chr(0), '' ORDER BY string_split(path, '/'))) AS fingerprint
FROM p GROUP BY pack""")
def a15_hosts(t: Tables) -> DataFrame:
    """Every host is a pack of many files in folders; 1/2.html comes before 1.txt7."""
    pack = F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("pack")
    folder, page = (F.col("page_id") % 3).cast("string"), F.col("page_id").cast("string")

    def file(path, column: str):
        return F.struct(path.alias("relpath"), F.encode(column, "utf-8").alias("content"))

    both = F.array(file(F.concat(folder, F.lit("/"), page, F.lit(".html")), "html"),
                   file(F.concat(folder, F.lit(".txt"), page), "url"))
    files = t["pages"].select(pack, F.explode(both).alias("f")).select("pack", "f.*")
    return packs.pack_fingerprint(files, ("pack",))


@query("a15_pack_fingerprint", f"""WITH {HOST_FILES},
d AS (SELECT pack, sha256(concat(page_id, '/', md5(url)) || chr(0) || html) AS h FROM f),
s AS (SELECT pack, count(*)::VARCHAR || {" || ".join(
    f"'-' || sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))} AS told FROM d GROUP BY pack)
SELECT pack, sha256(told) AS fingerprint FROM s""")
def a15(t: Tables) -> DataFrame:
    files = t["pages"].select(
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("pack"),
        F.concat(F.col("page_id").cast("string"), F.lit("/"), F.md5("url")).alias("relpath"),
        F.encode("html", "utf-8").alias("content"),
    )
    return packs.set_fingerprint(files, ("pack",))


@query("a15_exact_fingerprint", r"""
SELECT page_id, sha256('a/url' || chr(0) || url || chr(0) || 'a.html' || chr(0) || html || chr(0))
  AS fingerprint FROM pages""")
def a15_exact(t: Tables) -> DataFrame:
    # Each page is a pack of two files, as small as packs people write.
    def file(path: str, column: str):
        return F.struct(
            F.lit(path).alias("relpath"), F.encode(column, "utf-8").alias("content")
        )

    files = t["pages"].select(
        "page_id", F.explode(F.array(file("a.html", "html"), file("a/url", "url"))).alias("f")
    ).select("page_id", "f.relpath", "f.content")
    return packs.pack_fingerprint(files, ("page_id",))


@query("a16_file_fingerprint", """
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN sha256(html) END AS fingerprint FROM pages""")
def a16(t: Tables) -> DataFrame:
    content = F.when(F.col("page_id") % 5 != 0, F.encode("html", "utf-8"))
    return t["pages"].select("page_id", packs.file_fingerprint(content).alias("fingerprint"))


# Model metadata --------------------------------------------------------------------

INFO = """CASE WHEN s_suppkey % 8 = 7 THEN map('general.architecture', '')
 WHEN s_suppkey % 8 = 6 THEN map('general.architecture', 'qwen', 'qwen.block_count', '-1')
 WHEN s_suppkey % 2 = 0 THEN map('general.architecture', 'qwen', 'qwen.block_count', '36',
  'qwen.attention.head_count_kv', '8', 'qwen.attention.head_count', '32',
  'qwen.attention.key_length', '128', 'qwen.attention.value_length', '128',
  'qwen.context_length', '40960')
 ELSE map('general.architecture', 'gem', 'gem.block_count', '26', 'gem.attention.head_count', '4',
  'gem.embedding_length', CAST(1024 + s_suppkey % 4 AS STRING), 'gem.context_length', '32768') END"""
KNOWN = "s_suppkey % 8 NOT IN (6, 7)"


def architectures(t: Tables) -> DataFrame:
    return t["supplier"].select(
        "s_suppkey", F.lower("s_name").alias("model_name"), F.expr(INFO).alias("info")
    )


@query("f9_architecture", f"""
SELECT s_suppkey, CASE WHEN {KNOWN} THEN CASE WHEN s_suppkey % 2 = 0 THEN 'qwen' ELSE 'gem' END END
    AS architecture,
  CASE WHEN {KNOWN} THEN CASE WHEN s_suppkey % 2 = 0 THEN 8.0::DOUBLE ELSE 4.0::DOUBLE END END
    AS kv_head_count,
  CASE WHEN {KNOWN} THEN CASE WHEN s_suppkey % 2 = 0 THEN 128.0::DOUBLE
    ELSE (1024 + s_suppkey % 4)::DOUBLE / 4 END END AS key_length FROM supplier""")
def f9(t: Tables) -> DataFrame:
    return architectures(t).select(
        "s_suppkey", fit.architecture_from_info(F.col("info")).alias("a")
    ).select("s_suppkey", "a.architecture", "a.kv_head_count", "a.key_length")


KV = """CASE WHEN s_suppkey % 2 = 0 THEN 36.0::DOUBLE * 8 * 256 * 4096 * 2 / 1048576
  ELSE 26.0::DOUBLE * 4 * (2 * ((1024 + s_suppkey % 4)::DOUBLE / 4)) * 4096 * 2 / 1048576 END"""


@query("f7_kv_cache", f"""
SELECT s_suppkey, CASE WHEN {KNOWN} THEN round({KV}, 6) END AS kv_cache_mib FROM supplier""")
def f7(t: Tables) -> DataFrame:
    arch = fit.architecture_from_info(F.col("info"))
    found = architectures(t).select("s_suppkey", arch.alias("a"))
    return found.select(
        "s_suppkey", F.round(fit.kv_cache_mib(F.col("a"), F.lit(4096)), 6).alias("kv_cache_mib")
    )


@query("f8_predict_fit", f"""
SELECT s_suppkey, CASE WHEN NOT ({KNOWN}) OR free IS NULL THEN 'unknown'
    WHEN peak <= free * 0.95::DOUBLE THEN 'fits' ELSE 'does-not-fit' END AS verdict,
  CASE WHEN {KNOWN} THEN round(peak, 4) END AS predicted_peak_mib FROM (
  SELECT *, CAST(CAST(round((s_acctbal + 1000) * 1000000) AS BIGINT) AS DOUBLE) / 1048576 + {KV} + 1024
    AS peak, CASE WHEN s_nationkey > 2 THEN 8000.0::DOUBLE END AS free FROM supplier)""")
def f8(t: Tables) -> DataFrame:
    found = t["supplier"].select(
        "s_suppkey", fit.architecture_from_info(F.expr(INFO)).alias("a"),
        F.expr("CAST(round((s_acctbal + 1000) * 1000000) AS BIGINT)").alias("size"),
        F.expr("CASE WHEN s_nationkey > 2 THEN 8000.0D END").alias("free"),
    )
    fitted = found.withColumn(
        "f", fit.predict_fit(F.col("size"), F.col("a"), F.lit(4096), F.col("free"))
    )
    return fitted.select(
        "s_suppkey", "f.verdict", F.round("f.predicted_peak_mib", 4).alias("predicted_peak_mib")
    )


@query("f10_unified_free", """
SELECT event_id, greatest(0, CAST(floor(user_id * 0.75::DOUBLE) AS BIGINT)
  - CAST(floor(value) AS BIGINT)) AS free_mib FROM events""")
def f10(t: Tables) -> DataFrame:
    free = fit.unified_free_mib(F.col("user_id"), F.floor("value"))
    return t["events"].select("event_id", free.cast("bigint").alias("free_mib"))


@query("j10_resolve_architecture", """
SELECT lower(s_name) AS model_name, CASE WHEN s_suppkey % 8 NOT IN (6, 7) THEN
    CASE WHEN s_suppkey % 2 = 0 THEN 'qwen' ELSE 'gem' END
  WHEN s_acctbal > 3000 THEN 'header' END AS architecture FROM supplier""")
def j10(t: Tables) -> DataFrame:
    headers = t["supplier"].filter("s_acctbal > 3000").select(
        F.lower("s_name").alias("model_name"),
        F.expr(
            "map('general.architecture', 'header', 'header.block_count', '2', "
            "'header.attention.head_count', '2', 'header.embedding_length', '8', "
            "'header.context_length', '16')"
        ).alias("info"),
    )
    listing = architectures(t).select("model_name", "info")
    return J.resolve_architecture(listing, headers).select("model_name", "arch.architecture")


# Streams -----------------------------------------------------------------------------

_RUNS = itertools.count()


def stream_of(t: Tables, table: str) -> DataFrame:
    """One table as a stream; its file is found through a glob."""
    path = f"{t.sf_dir}/{table}.parquet"
    schema = t.spark.read.parquet(path).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{table}.parque[t]")


def stream_folder(t: Tables) -> str:
    """A new folder for one stream, in the shared folder."""
    app = t.spark.sparkContext.applicationId
    return f"{shared_folder(t.spark)}/stream-{app}-{next(_RUNS)}-{time.time_ns()}"


def run_stream(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its output back, batch by batch."""
    folder = stream_folder(t)
    t.spark.conf.set(*next(iter(X.STATE_STORE.items())))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    job = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("x1_score_stream", f"WITH {SCORED} SELECT unit_id, round(score, 6) AS score, pass, "
       "failed_gate FROM scored")
def x1(t: Tables) -> DataFrame:
    outputs = stream_of(t, "events").selectExpr(*VIEWS["event_outputs"][1]).drop(
        "props", "user_id"
    )
    scored = X.score_stream(outputs, example_rows(t), specs(t)).select(
        "unit_id", F.round("score", 6).alias("score"), "pass", "failed_gate"
    )
    return run_stream(t, scored).drop("batch")


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL
    OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
closed AS (SELECT user_id AS generation_id, min(ts) AS f, max(ts) AS l, count(*) AS token_count
  FROM s GROUP BY user_id, session)"""


@query("x2_timing_stream", SESSIONS + """
SELECT generation_id, epoch_us(f) AS first_us, token_count,
  CASE WHEN token_count >= 2 AND l > f THEN round((token_count - 1) * 1000.0
    / (CAST(epoch_us(l) - epoch_us(f) AS DOUBLE) / 1000.0), 9) END AS tokens_per_second
FROM closed WHERE l + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def x2(t: Tables) -> DataFrame:
    events = stream_of(t, "events").select(
        F.col("user_id").alias("generation_id"), F.col("ts").cast("timestamp").alias("at")
    )
    timed = run_stream(t, X.timing_stream(events, "1 hour", "6 hours"))
    return timed.select(
        "generation_id", us("first_at").alias("first_us"), "token_count",
        F.round("tokens_per_second", 9).alias("tokens_per_second"),
    )


def last_state(out: DataFrame, key: str) -> DataFrame:
    """Newest row per key of an update-mode output."""
    rest = [c for c in out.columns if c not in (key, "batch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        key, "_r.*"
    )


def sample_stream(t: Tables) -> DataFrame:
    return stream_of(t, "events").selectExpr(*VIEWS["samples"][1])


@query("x3_peak_stream", f"""WITH {cte('samples')}
SELECT candidate_id, max(used_mib) AS peak_mib, count(used_mib) AS n_samples FROM samples
GROUP BY candidate_id""")
def x3(t: Tables) -> DataFrame:
    return last_state(run_stream(t, X.peak_stream(sample_stream(t)), "update"), "candidate_id")


@query("x3_peak_series", """
SELECT user_id AS candidate_id, (epoch_us(ts) // 86400000000) * 86400000000 AS from_us,
  max(value) AS peak_mib FROM events
GROUP BY user_id, epoch_us(ts) // 86400000000
HAVING (epoch_us(ts) // 86400000000 + 1) * 86400000000
  <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""")
def x3_series(t: Tables) -> DataFrame:
    series = run_stream(t, X.peak_series(sample_stream(t), "1 hour", "1 day"))
    return series.select("candidate_id", us("from").alias("from_us"), "peak_mib")


@query("x4_timeline_stream", f"""
WITH g AS (SELECT user_id, event_id, ts, value, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 24 HOUR THEN 0 ELSE 1 END
    AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1 AS i,
    count(*) OVER (PARTITION BY user_id, session) AS n FROM s),
k AS (SELECT *, CASE WHEN i < {CAP} THEN i % (1 << greatest(0, CASE WHEN n < {CAP} THEN 0
    ELSE 1 + (n - {CAP}) // {CAP // 2} END)) = 0
  ELSE (1 << ((n - {CAP}) // {CAP // 2} - (i - {CAP}) // {CAP // 2})) <= {CAP // 2} AND ((i - {CAP}) % {CAP // 2})
    % (1 << ((n - {CAP}) // {CAP // 2} - (i - {CAP}) // {CAP // 2})) = 0 END AS stays FROM p)
SELECT user_id AS candidate_id, max(value) AS peak_mib, count(*) AS sample_total,
  string_agg(epoch_us(ts)::VARCHAR, ',' ORDER BY ts, event_id) FILTER (stays) AS kept_us,
  round(sum(value) FILTER (stays), 6) AS kept_sum
FROM k GROUP BY user_id, session
HAVING (max(epoch_us(ts)) + 999) // 1000 + 86400000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000""")
def x4(t: Tables) -> DataFrame:
    out = run_stream(t, X.timeline_stream(sample_stream(t), CAP, "1 hour", 86_400_000))
    return out.select(
        "candidate_id", "peak_mib", "sample_total",
        F.array_join(F.transform("kept", lambda k: us(k["at"]).cast("string")), ",").alias("kept_us"),
        F.round(F.aggregate("kept", F.lit(0.0), lambda total, k: total + k["used_mib"]), 6).alias("kept_sum"),
    )


@query("x2_generation_stream", SESSIONS.replace("SELECT user_id, ts", "SELECT user_id, event_type, ts").replace(
    "count(*) AS token_count", """min(ts) FILTER (WHERE event_type = 'signup') AS s,
  max(ts) FILTER (WHERE event_type = 'purchase') AS e,
  count(*) FILTER (WHERE event_type NOT IN ('signup', 'purchase')) AS n,
  min(ts) FILTER (WHERE event_type NOT IN ('signup', 'purchase')) AS tf,
  max(ts) FILTER (WHERE event_type NOT IN ('signup', 'purchase')) AS tl""") + """
SELECT generation_id, epoch_us(s) AS started_us, (epoch_us(tf) - epoch_us(s)) / 1000.0 AS ttft_ms,
  CASE WHEN n >= 2 AND tl > tf THEN round((n - 1) * 1000.0 / ((epoch_us(tl) - epoch_us(tf)) / 1000.0), 9) END
    AS tokens_per_second, (epoch_us(e) - epoch_us(s)) / 1000.0 AS wall_ms, n AS token_count
FROM closed WHERE l + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def x2_generations(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end")
    events = stream_of(t, "events").select(
        F.col("user_id").alias("generation_id"), F.col("ts").cast("timestamp").alias("at"),
        F.coalesce(kind, F.lit("token")).alias("kind"),
    )
    timed = run_stream(t, X.generation_stream(events, "1 hour", "6 hours"))
    return timed.select(
        "generation_id", us("started_at").alias("started_us"), "ttft_ms",
        F.round("tokens_per_second", 9).alias("tokens_per_second"), "wall_ms", "token_count",
    )


@query("x5_journal_sink", f"WITH {SCORED} SELECT unit_id, round(score, 6) AS score FROM scored")
def x5(t: Tables) -> DataFrame:
    from gradelake.sources.journal import unit_rows
    outputs = stream_of(t, "events").selectExpr(*VIEWS["event_outputs"][1]).drop(
        "props", "user_id"
    )
    scored = X.score_stream(outputs, example_rows(t), specs(t)).select(
        "unit_id", "pack", "score", "pass", "failed_gate"
    ).withColumn("run_id", F.col("pack"))
    folder = stream_folder(t)
    X.journal_sink(scored, f"{folder}/journal", f"{folder}/checkpoint").awaitTermination()
    return unit_rows(t.spark, f"{folder}/journal").select(
        "unit_id", F.round("score", 6).alias("score")
    )


def completion_events(lines: DataFrame) -> DataFrame:
    return logs.parse_generation_log(lines).select(
        "generation_id", "seq", "at", "kind", "done_reason", "message",
        F.coalesce(is_oom_suspect(F.col("message")), F.lit(False)).alias("oom_suspect"),
    )


COMPLETION_SQL = """
WITH e AS (SELECT user_id, min(event_id) AS end_id FROM events
  WHERE event_type IN ('view', 'purchase') GROUP BY user_id)
SELECT v.user_id AS generation_id,
  CASE WHEN max(x.event_type) = 'view' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN max(x.event_type) = 'view' THEN false ELSE true END AS oom_suspect,
  count(*) FILTER (WHERE v.event_type = 'click' AND (e.end_id IS NULL OR v.event_id < e.end_id))
    AS token_count
FROM events v LEFT JOIN e ON v.user_id = e.user_id
LEFT JOIN events x ON x.event_id = e.end_id
WHERE v.event_type <> 'signup' GROUP BY v.user_id"""


@query("x6_completion_stream", COMPLETION_SQL)
def x6(t: Tables) -> DataFrame:
    lines = stream_of(t, "events").selectExpr(
        *VIEWS["log_lines"][1], "CAST(ts AS TIMESTAMP) AS at"
    )
    out = run_stream(t, X.completion_stream(
        completion_events(lines), "1 hour", 3600000, keep_closed_ms=366 * 86_400_000
    ))
    return out.select("generation_id", "status", "oom_suspect", "token_count")


@query("x6_completion_batch", COMPLETION_SQL)
def x6_batch(t: Tables) -> DataFrame:
    lines = t.spread("events").selectExpr(
        "user_id AS generation_id", "event_id AS seq", "CAST(ts AS TIMESTAMP) AS at",
        *[c for c in VIEWS["log_lines"][1] if c.endswith("AS line")],
    )
    return X.completion_batch(completion_events(lines)).select(
        "generation_id", "status", "oom_suspect", "token_count"
    )


@query("w8_keep_first", """
SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def w8(t: Tables) -> DataFrame:
    return keep_first(
        t["documents"].select("text", "doc_id", "lang", "source"), ["text"], ["doc_id"]
    ).select("doc_id", "lang", "source")
