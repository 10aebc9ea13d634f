"""SimHash fingerprints and groups against plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gradelake.llm import queries, simhash
from gradelake.llm.common import importable

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=2):
    marks = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, one in enumerate(marks):
        for j in range(i):
            if (one ^ marks[j]).bit_count() <= radius:
                group[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted((repr(doc), f"{marks[i]:016x}", least.get(top(i))) for i, (doc, _) in enumerate(rows))


def found(df):
    return sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def prose(rng, n, words=("ka", "lo", "Mi", "ner", "os", "pra", "É", "tun", "vel", "dish")):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def test_fingerprints_of_all_lengths_and_of_texts_read_in_blocks(monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (1, 2, 3, 4, 254, 255, 256, 257, 511, 700)]
    texts += [None, "", " \n\t", "A\x0bB\x0cC", "a b c d e f"]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash.word_blocks, "__defaults__", (40,))
    monkeypatch.setattr(simhash, "CHUNK", 16)
    assert [simhash.fingerprint(t) for t in texts] == want


def test_groups_equal_brute_force(spark):
    rng = random.Random(6)
    rows, base = [], [prose(rng, 160) for _ in range(12)]
    for i in range(220):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i + 3, " ".join(words)))
    rows += [(400, None), (401, ""), (2, " "), (None, base[0]), (None, "alone it stands"), (9, base[1].upper())]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.withColumn("f", F.lit(1)).withColumn("component", F.lit("x")).withColumn("variant", F.lit(0))
    want = brute_groups(rows)
    assert found(simhash.near_copies(clash)) == want
    assert len({g for _, _, g in want}) < len(rows) - 20  # links other than exact copies matter
    assert found(simhash.near_copies(docs, radius=4)) == brute_groups(rows, 4)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_links_at_the_radius_and_not_beyond(spark):
    one = 0x8000_0000_0000_0001
    marks = [one, one ^ 0b110, one ^ 0b11110, one ^ (1 << 63), 0x0FF0_0000_0000_0000]
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame(signed, "f bigint")).collect()}
    linked = {frozenset(p) for p in got}
    assert linked == {
        frozenset((signed[a][0], signed[b][0])) for a, b in ((0, 1), (0, 3), (1, 2))}


def test_a_large_ball_of_copies_makes_no_pairs(spark):
    marks = sorted({(1 << a) | (1 << b) for a in range(40) for b in range(a)})
    made = simhash.links(spark.createDataFrame([(m,) for m in marks], "f bigint"))
    assert made.count() < 65 * len(marks)


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "f bigint"), 3)


def test_query_equals_brute_force_over_its_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(queries.QUERIES["op12_simhash_near_dedup"](spark, sf_dir)) == brute_groups(rows)
