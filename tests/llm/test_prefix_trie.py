"""The prefix trie against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gradelake.llm import prefix_trie, queries
from gradelake.llm.common import importable

ROWS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def said(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def in_order(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: (*t[:3], said(*t[2:])))] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    """One row per distinct prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        words = len(path[-1][1].encode().split()) if path else 0
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in below)
    return sorted(
        (min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids.get(path, [])), leaves[path],
         saved[path], hashlib.sha256(
             ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path)).encode()).hexdigest())
        for path, m in members.items())


def trie(spark, rows, members=None):
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, ROWS).withColumn("pos", F.lit("x")))
    found = members if members is not None else turns.select("conv_id").distinct()
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(turns, found).collect())


def conversations(rng, n, letters=4):
    rows = []
    for c in range(n):
        for t in range(rng.choice((1, 2, 3, 3, 7))):
            rows.append((c * 3, t, rng.choice(("user", "assistant")), " ".join(rng.choice("ab") for _ in range(rng.randrange(letters)))))
    return rows


def test_random_conversations(spark, monkeypatch):
    rng = random.Random(8)
    rows = conversations(rng, 150)
    rows += [(9000 + i, t, "user", "the same first words" if t == 0 else f"then {i} {t}") for i in range(80) for t in range(3)]
    rows += [(9500 + i, 0, "user", "copied") for i in range(60)]
    rng.shuffle(rows)
    want = brute(in_order(rows))
    assert trie(spark, rows) == want
    # many small tasks, so that most arcs are linked across tasks and most pieces are cut
    for name, value in (("BLOCK", 9), ("PART", 2), ("TURNS", 2), ("NEAR", 1), ("PIECE", 4)):
        monkeypatch.setattr(prefix_trie, name, value)
    assert trie(spark, rows) == want


def test_nulls_ties_repeats_and_silent_members(spark):
    rows = [(1, None, None, "x y"), (1, None, "b", None), (1, 2, "a", "q"), (1, 2, "a", "p"), (1, 2, "a", "p"),
            (2, 5, "", "x y"), (2, 4, "", "x y"), (None, 1, "a", "lost"), (3, 1, "", "x y"), (4, 1, "", "  \n")]
    convs = in_order(rows)
    assert trie(spark, rows) == brute(convs)
    silent = spark.createDataFrame([(c, 1) for c in (1, 2, 3, 4, 77, 78)], "conv_id bigint, depth int")
    assert trie(spark, rows, silent) == brute({**convs, 77: [], 78: []})


def test_only_silent_members_and_empty_tables(spark):
    nothing = spark.createDataFrame([], ROWS)
    turns = prefix_trie.ordered_turns(nothing)
    assert prefix_trie.prefix_trie(turns, turns.select("conv_id")).count() == 0
    alone = spark.createDataFrame([(5,), (7,)], "conv_id bigint")
    got = [tuple(r) for r in prefix_trie.prefix_trie(turns, alone).collect()]
    assert got == [(5, 0, None, 2, 0, 1, 0, hashlib.sha256(b"5,7").hexdigest())]


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART", 16)
    monkeypatch.setattr(prefix_trie, "TURNS", 50)
    rows = [(1, t, "user", f"word {t % 7}") for t in range(300)] + [(2, t, "user", f"word {t % 7}") for t in range(120)]
    assert trie(spark, rows) == brute(in_order(rows))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"said {rng.randrange(5)}  in\t{rng.randrange(2)}")
            for c in range(130) for t in range(rng.randrange(0, 6)) if c not in (40, 60)]
    rows += [(41, None, None, None), (100, 9, None, "x")]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_conversation_prefix_trie"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    want = brute(rebuilt(in_order(rows)))
    assert sorted(map(tuple, got.collect())) == want
    assert any(not turns for turns in rebuilt(in_order(rows)).values())
