"""Aggregates, frontier, recommendation and offload rules against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gradelake.operators import aggregates as A
from gradelake.operators import scale
from gradelake.operators.frontier import frontier
from gradelake.operators.joins import size_peers, size_position
from gradelake.plans import decide, planning, report
from gradelake.plans.summary import candidate_summary

UNITS = (
    "run_id string, candidate_id string, unit_id string, example_id string, repetition int, "
    "status string, score double, pass boolean, failed_gate string, output string, "
    "done_reason string, ttft_ms double, tokens_per_second double, wall_ms double"
)
CANDIDATES = (
    "run_id string, candidate_id string, candidate_seq int, model_name string, size_bytes bigint, "
    "status string, status_reason string, predicted_peak_mib double, measured_peak_mib double, "
    "offload_suspect_reason string, fit_verdict string, quantization string"
)


def unit(cand, ex, rep, score, output="o", status="completed", gate=None, reason="stop", ttft=10.0,
         rate=5.0, wall=1.0, run="r"):
    return (run, cand, f"{run}{cand}{ex}{rep}", ex, rep, status, score,
            None if score is None else score == 1.0, gate, output, reason, ttft, rate, wall)


def candidate(cand, seq, size=1 << 30, status="completed", predicted=1000.0, measured=900.0, run="r",
              reason=None):
    return (run, cand, seq, f"m-{cand}", size, status, reason, predicted, measured, None, "fits", "q4")


def summarize(spark, units, candidates):
    return candidate_summary(spark.createDataFrame(units, UNITS), spark.createDataFrame(candidates, CANDIDATES))


def test_summary(spark):
    units = [
        unit("a", "1", 1, 1.0, ttft=10.0, rate=4.0), unit("a", "1", 2, 0.5, ttft=30.0, rate=None),
        unit("a", "2", 1, 1.0, output="x", ttft=20.0, rate=8.0), unit("a", "2", 2, 1.0, output="y", wall=None),
        unit("a", "3", 1, None, status="failed", output=None), unit("a", "3", 2, None, status="pending", output=None),
        unit("b", "1", 1, 0.0, output=" \n", reason="length", gate="json-schema"),
        unit("b", "1", 2, 0.0, output=" \n", reason="length", gate="pattern"),
        unit("b", "2", 1, None, status="completed", output=None),
        unit("c", "1", 1, None, status="skipped", output=None),
    ]
    got = {r["candidate_id"]: r for r in summarize(
        spark, units, [candidate(c, i) for i, c in enumerate("abcd")]).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["completed"], a["failed"], a["pending"], a["skipped"]) == (4, 1, 1, 0)
    assert a["mean_score"] == 0.875 and a["pass_rate"] == 0.75
    assert (a["score_min"], a["score_max"]) == (0.75, 1.0)
    assert (a["ttft_median"], a["ttft_min"], a["ttft_max"]) == (15.0, 10.0, 30.0)
    assert a["rate_median"] == 5.0 and a["wall_ms_total"] == 3.0
    assert a["outputs_deterministic"] is False and a["gates_passed"] is True
    assert a["memory_delta_percent"] == pytest.approx(-10.0)
    assert b["completed"] == 2 and b["truncated_empty_count"] == 2
    assert b["gate_failure_counts"] == {"json-schema": 1, "pattern": 1} and b["gates_passed"] is False
    assert b["outputs_deterministic"] is True
    for empty in (c, d):
        assert empty["mean_score"] is None and empty["gates_passed"] is None
        assert empty["outputs_deterministic"] is None and empty["ttft_median"] is None
        assert empty["completed"] == 0 and empty["wall_ms_total"] == 0.0
    assert c["skipped"] == 1


def test_exact_medians_of_skewed_groups(spark):
    rng = random.Random(7)
    groups = {"hot": 60_000, "even": 10, "odd": 11, "one": 1, "ties": 5_000}
    rows = []
    for key, n in groups.items():
        for i in range(n):
            value = 3.0 if key == "ties" and i % 3 else rng.lognormvariate(0, 3)
            rows.append((key, i, value, None if i % 2 else float(i)))
    df = spark.createDataFrame(rows, "k string, id int, x double, y double")
    got = {r["k"]: r for r in scale.exact_medians(df, ["k"], ["x", "y"], ["id"]).collect()}
    for key in groups:
        xs = [r[2] for r in rows if r[0] == key]
        ys = [r[3] for r in rows if r[0] == key and r[3] is not None]
        assert got[key]["x_median"] == statistics.median(xs)
        assert got[key]["y_median"] == statistics.median(ys)


def beats(o, p):
    axes = [(1, 1), (2, -1), (3, 1)]
    better = worse = False
    for i, sign in axes:
        if o[i] is None or p[i] is None or o[i] == p[i]:
            continue
        if (o[i] - p[i]) * sign > 0:
            better = True
        else:
            worse = True
    return better and not worse


@pytest.mark.parametrize("most", [100_000, 7])
def test_exact_medians_of_any_distribution(spark, monkeypatch, most):
    """Constant, two-valued, exponential, clustered and tiny groups; with a bound of 7 all are narrowed down."""
    monkeypatch.setattr(scale, "ORDERED", most)
    monkeypatch.setattr(scale, "POINTS", 8)
    rng = random.Random(3)
    groups = {
        "constant": [4.0] * 300, "two": [1.0] * 150 + [2.0] * 150, "odd": [1.0] * 150 + [2.0] * 151,
        "steep": [2.0 ** -i for i in range(900)], "both": [(-1.0) ** i * 10.0 ** (i % 600 - 300) for i in range(700)],
        "ends": [0.0] * 100 + [rng.random() for _ in range(50)] + [1e9] * 100, "one": [5.0], "pair": [1.0, 4.0],
        "gap": [float(i) for i in range(500)] + [1e12 + i for i in range(500)], "none": [None, None],
    }
    rows = [(k, v, None if v is None or i % 3 else -v) for k, vs in groups.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"]: (r["a_median"], r["b_median"]) for r in scale.exact_medians(df, ["k"], ["a", "b"], ["a"]).collect()}
    for k in groups:
        for at in (1, 2):
            held = sorted(r[at] for r in rows if r[0] == k and r[at] is not None)
            want = statistics.median(held) if held else None
            assert got.get(k, (None, None))[at - 1] == want, (k, at)


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier_with_missing_axes(spark, seed, monkeypatch):
    monkeypatch.setattr("gradelake.operators.frontier.PIECE", 16)
    rng = random.Random(seed)
    pick = lambda low: None if rng.random() < low else rng.randint(0, 12) * 1.0
    pts = [(f"c{i}", rng.randint(0, 12) * 1.0, pick(0.3), pick(0.3), "hot" if i % 3 else f"r{i % 5}")
           for i in range(300)]
    df = spark.createDataFrame(
        pts, "candidate_id string, quality double, vram_mib double, tokens_per_second double, run_id string")
    got = {r["candidate_id"] for r in frontier(df).collect()}
    want = {p[0] for p in pts if not any(o[4] == p[4] and beats(o, p) for o in pts)}
    assert got == want


def test_size_position_is_exact_on_doubling(spark):
    sizes = [1, 2, 3, 7, 1023, 1024, 5_000_000_001, (1 << 52) - 1]
    df = spark.createDataFrame([(s,) for s in sizes], "_size bigint")
    got = df.select(size_position(F.col("_size")).alias("a"), "_size").collect()
    twice = df.select((F.col("_size") * 2).alias("_size")).select(size_position(F.col("_size")).alias("a")).collect()
    assert [b["a"] - a["a"] for a, b in zip(got, twice)] == [1 << 52] * len(sizes)
    ordered = sorted((r["_size"], r["a"]) for r in got)
    assert [a for _, a in ordered] == sorted(a for _, a in ordered)


def test_size_peers_against_all_pairs(spark):
    rng = random.Random(3)
    sizes = [0, 0, 1, 2, 4, 8, 16] + [rng.choice([100, 200, 400, 401, 199, 50, 1 << 40]) + rng.randint(0, 1)
                                      for _ in range(80)]
    rows = [("r" if i % 4 else "s", i, s, None if i % 5 == 0 else float(rng.randint(1, 50))) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "run_id string, candidate_id int, size_bytes bigint, tokens_per_second double")
    got = {r["candidate_id"]: r for r in size_peers(df).collect()}
    for run, cid, size, rate in rows:
        band = [r for r in rows if r[0] == run and r[3] is not None and size * 0.5 <= r[2] <= size * 2]
        assert got[cid]["peer_count"] == len([r for r in band if r[1] != cid])
        assert got[cid]["band_best_rate"] == max((r[3] for r in band), default=None)


def summary_row(spark, rows):
    """(id, quality, measured, rate, size, status, gates, run)"""
    schema = ("run_id string, candidate_id string, candidate_seq int, model_name string, status string, "
              "status_reason string, mean_score double, gates_passed boolean, "
              "gate_failure_counts map<string,bigint>, measured_peak_mib double, rate_median double, size_bytes bigint")
    data = [(r[7] if len(r) > 7 else "r", r[0], i, f"m-{r[0]}", r[5], None, r[1], r[6],
             {} if r[6] else {"json-schema": 2, "pattern": 1}, r[2], r[3], r[4]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


MIB = 1 << 20


def test_recommendation(spark):
    rows = [
        ("best", 0.95, 9000.0, 10.0, 1, "completed", True),
        ("edge", 0.95 * (1 - 0.02), 4000.0, 20.0, 1, "completed", True),
        ("below", 0.90, 1000.0, 50.0, 1, "completed", True),
        ("gates", 0.99, 100.0, 50.0, 1, "completed", False),
        ("oom", None, None, None, 1, "oom", None),
        # a run without measured memory: weights decide
        ("w1", 0.5, None, 5.0, 200 * MIB, "completed", True, "w"),
        ("w2", 0.5, 10.0, 9.0, 100 * MIB, "completed", True, "w"),
        # an API run: quality, then rate
        ("n1", 0.7, None, 5.0, 0, "completed", True, "n"),
        ("n2", 0.7, None, 6.0, 0, "completed", True, "n"),
        # nothing eligible
        ("x1", 0.2, 1.0, 1.0, 1, "failed", True, "x"), ("x2", 0.4, 1.0, 1.0, 1, "completed", False, "x"),
    ]
    summary = summary_row(spark, rows)
    ordered = decide.recommend(summary).collect()
    got = {r["candidate_id"]: r for r in ordered}
    assert {k for k, r in got.items() if r["role"] == "pick"} == {"edge", "w2", "n2"}
    assert got["edge"]["reason"] == ("m-edge holds quality 0.931, within 2% of the best (0.950 from m-best), "
                                     "at 4000 MiB peak memory versus 9000 MiB.")
    assert got["best"]["reason"] == "same quality band but 5000 MiB more peak memory than m-edge"
    assert got["below"]["runner_up_case"] == "below-tolerance"
    assert got["below"]["reason"].startswith("quality 0.900 is 5.3% below the best 0.950")
    assert got["gates"]["reason"] == "failed gate scorers: json-schema (2 units), pattern (1 unit)"
    assert got["oom"]["reason"] == "did not run: out of memory"
    assert (got["w1"]["footprint_kind"], got["n1"]["footprint_kind"]) == ("weights", "none")
    assert got["n1"]["reason"] == "same quality band but 5.0 tok/s median versus 6.0 for m-n2"
    assert got["x1"]["role"] == got["x2"]["role"] == "nearest-miss"
    assert [r["candidate_id"] for r in ordered if r["run_id"] == "x"] == ["x2", "x1"]
    assert [r["candidate_id"] for r in ordered if r["run_id"] == "r"] == ["edge", "gates", "best", "below", "oom"]
    classes = {r["candidate_id"]: r["class"] for r in decide.frontier_table(summary).collect()}
    assert classes["below"] == "frontier" and classes["gates"] == classes["oom"] == "excluded"
    assert classes["n1"] == "dominated"


@pytest.mark.parametrize("tolerance", [-0.1, 1.0, math.nan, math.inf])
def test_tolerance_has_to_be_a_fraction(tolerance):
    with pytest.raises(ValueError, match="fraction"):
        decide.check_tolerance(tolerance)


def test_offload_rules(spark):
    schema = ("run_id string, candidate_id string, candidate_seq int, model_name string, status string, "
              "predicted_peak_mib double, measured_peak_mib double, size_bytes bigint, tokens_per_second double")
    rows = [
        ("r", "a", 0, "m-a", "completed", 1000.0, 599.0, 100, 50.0),
        ("r", "b", 1, "m-b", "completed", 1000.0, 900.0, 150, 9.0),
        ("r", "c", 2, "m-c", "completed", None, None, 200, 40.0),
        ("r", "d", 3, "m-d", "completed", None, None, 5000, 1.0),
        ("r", "e", 4, "m-e", "failed", 1000.0, 1.0, 100, 90.0),
    ]
    got = {r["candidate_id"]: r for r in decide.offload_suspects(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b"}
    assert "599 MiB plateaued under 60% of the predicted 1000 MiB" in got["a"]["reason"]
    assert "9.0 tok/s is under 25% of the 50.0 tok/s" in got["b"]["reason"]
    assert "(m-a, m-c)" in got["b"]["reason"]


def test_offload_suspects_read_the_candidates_once(spark, tmp_path):
    path = str(tmp_path / "candidates")
    spark.createDataFrame(
        [("r", f"c{i}", i, f"m{i}", "completed", 100.0, 90.0, 100 + i, 50.0 if i else 1.0) for i in range(5)],
        "run_id string, candidate_id string, candidate_seq int, model_name string, status string, "
        "predicted_peak_mib double, measured_peak_mib double, size_bytes bigint, tokens_per_second double",
    ).write.parquet(path)
    found = decide.offload_suspects(spark.read.parquet(path))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()  # from what was written
    assert [(r["candidate_id"], r["peers"]) for r in found.collect()] == [("c0", "m1, m2, m3, m4")]


def test_report_tables(spark):
    units = [unit("a", "1", 1, 1.0), unit("a", "1", 2, 1.0), unit("b", "1", 1, 0.5, gate="pattern")]
    tables = report.report(
        spark.createDataFrame(units, UNITS),
        spark.createDataFrame([candidate("a", 0), candidate("b", 1), candidate("c", 2, status="oom")], CANDIDATES))
    rows = tables["comparison"].collect()
    assert [r["flags"] for r in rows] == ["", "gates!", "oom"]
    assert rows[0]["peak_mib"] == "900 (-10.0%)" and rows[2]["quality"] == "-"
    assert {r["class"] for r in tables["frontier"].collect()} == {"frontier", "excluded"}


def test_group_index_matches_a_plain_window(spark):
    df = spark.createDataFrame([("h" if i % 3 else "k", (i * 37) % 1000) for i in range(1000)], "k string, v int")
    got = scale.group_index(df, ["k"], [F.col("v")], F.floor(F.col("v") / 50), "i", "n").collect()
    for key in "hk":
        mine = sorted((r["v"], r["i"], r["n"]) for r in got if r["k"] == key)
        assert [i for _, i, _ in mine] == list(range(len(mine))) and mine[0][2] == len(mine)


def test_salted_lookup_equals_broadcast(spark, monkeypatch):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(500)], "id int, k string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    plain = sorted(scale.lookup_join(facts, lookup, ["k"], ["id"]).collect())
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    for how in ("left", "inner", "left_semi"):
        salted = sorted(scale.lookup_join(facts, lookup, ["k"], ["id"], how).collect())
        assert salted == sorted(facts.join(lookup, "k", how).select(*scale.lookup_join(facts, lookup, ["k"], ["id"], how).columns).collect())
    assert sorted(scale.lookup_join(facts, lookup, ["k"], ["id"]).collect()) == plain


def test_remaining_time_uses_the_first_measured_rate(spark):
    plan = spark.createDataFrame([("r", 0, 10, 100, None), ("r", 1, 10, 100, 50.0), ("r", 2, 10, 100, 25.0)],
                                 "run_id string, candidate_seq int, units int, max_tokens int, rate double")
    got = [r["seconds_left"] for r in planning.remaining_time(plan).orderBy("candidate_seq").collect()]
    assert got == [(10 * 7 + 30) * 3, (10 * 7 + 30) * 2, 10 * 4 + 30]


def test_timing_edges(spark):
    spans = spark.sql("SELECT id AS generation_id, timestamp_millis(0) AS started_at, timestamp_millis(1000) AS finished_at FROM range(3)")
    tokens = spark.sql("SELECT g AS generation_id, timestamp_millis(m) AS at FROM VALUES (0, 100), (1, 100), (1, 100), (2, 100), (2, 200), (2, 350) AS t(g, m)")
    got = {r["generation_id"]: r for r in A.generation_timing(tokens, spans).collect()}
    assert got[0]["tokens_per_second"] is None and got[1]["tokens_per_second"] is None
    assert got[2]["tokens_per_second"] == 8.0 and got[2]["ttft_ms"] == 100.0 and got[2]["wall_ms"] == 1000.0
