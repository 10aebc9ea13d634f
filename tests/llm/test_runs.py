"""Periodic runs against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.llm import queries, runs
from gradelake.llm.common import importable

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def brute_runs(words, repeats=4, least=6):
    """start, length, period: every stretch of equal words a period apart, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made(rng):
    n, letters = rng.randrange(90), rng.choice((1, 2, 2, 3, 5))
    words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words + words[::-1] + words if rng.random() < 0.3 else words


def test_runs_and_collapsed_words_equal_brute_force():
    rng = random.Random(3)
    total = 0
    for _ in range(3000):
        words = made(rng)
        found = runs.word_runs(words)
        assert found == brute_runs(words)
        assert runs.without_repeats(words, found) == brute_collapsed(words, found)
        total += len(found)
    assert total > 2000


def test_other_repeats_and_lengths():
    rng = random.Random(4)
    for _ in range(500):
        words = made(rng)
        assert runs.word_runs(words, 3, 4) == brute_runs(words, 3, 4)
        assert runs.word_runs(words, 6, 9) == brute_runs(words, 6, 9)
    with pytest.raises(ValueError):
        runs.runs_of(np.array([1, 1, 1]), repeats=2)


def test_tree_answers_every_extension_and_both_orders():
    rng = random.Random(5)
    for letters in (1, 2, 4):
        s = [rng.randrange(1, letters + 1) for _ in range(60)]
        tree = runs.SuffixTree(s)
        ends = [s[i:] + [0] for i in range(61)]
        up = sorted(range(61), key=lambda i: ends[i])
        down = sorted(range(61), key=lambda i: [-x if x else -99 for x in ends[i]])
        assert [up[r] for r in range(61)] == sorted(range(61), key=tree.ranks().__getitem__)
        assert [down[r] for r in range(61)] == sorted(range(61), key=tree.ranks(True).__getitem__)
        i, j = np.array([(a, b) for a in range(61) for b in range(61) if a != b]).T
        want = [next(k for k in range(62) if ends[a][k:k + 1] != ends[b][k:k + 1]) for a, b in zip(i, j)]
        assert tree.extensions().of(i, j).tolist() == want


def test_long_texts_of_one_word_and_of_fibonacci_words():
    assert runs.word_runs([b"a"] * 30000) == [(0, 30000, 1)]
    one, two = [b"a"], [b"a", b"b"]
    while len(two) < 10000:
        one, two = two, two + one
    assert runs.word_runs(two) == []  # no power of four
    assert runs.word_runs(two * 5)[0] == (0, 5 * len(two), len(two))


def test_operator_on_nulls_empty_texts_repeats_and_clashing_names(spark):
    rows = [(1, "x a b a b a b a b y"), (1, "x a b a b a b a b y"), (2, None), (3, ""), (None, "é  é \té  é  é  é "), (4, "A a A a A a A a"), (5, "a b c")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                  for r in runs.collapse_runs(docs).collect()), key=repr)
    same = (1, 10, [(1, 8, 2)], "x a b y")
    assert got == sorted([
        same, same, (2, 0, [], ""), (3, 0, [], ""), (None, 6, [(0, 6, 1)], "é "),
        (4, 8, [(0, 8, 2)], "A a"), (5, 3, [], "a b c")], key=repr)
    assert runs.collapse_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force_over_its_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute_runs(words)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        told = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        want.append((r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
                     hashlib.sha256(told.encode()).hexdigest(),
                     hashlib.sha256(b" ".join(brute_collapsed(words, found))).hexdigest()))
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(row[1] for row in want) > 5
