"""Each text operator against plain Python, with nulls, empty texts, repeats and clashing names."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradelake.llm import (chat, components, dedup_exact, html_text, licenses, lines, minhash, packing,
                           pieces, quality, queries, toxicity)
from gradelake.llm.common import importable

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def fetched(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


WORDS = [a + b for a in ("ka", "lo", "mi", "ner", "os", "pra") for b in ("t", "vel", "dun", "ish", "o")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# exact dedup

def test_exact_dedup_of_nulls_repeats_and_case(spark):
    docs = documents(spark, [(1, "A b", "x"), (2, "a B", None), (3, None, "x"), (4, "", "x"), (5, "É", "x"), (6, "é", "x")])
    got = fetched(dedup_exact.exact_dedup(docs.withColumn("kept", F.lit(7)), stable_id=-F.col("doc_id")),
                  "doc_id", "keep_id", "group_size", "kept")
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True)]


def test_exact_dedup_tells_colliding_texts_apart(spark):
    docs = documents(spark, [(1, "ab", "x"), (2, "cd", "x"), (3, "ab", "x"), (4, "efg", "x")])
    got = fetched(dedup_exact.exact_dedup(docs, hash_text=lambda t: F.length(t)), "doc_id", "keep_id", "group_size")
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


# line dedup

def brute_lines(rows):
    seen, out = {}, {}
    windows = sorted(
        (i, k, tuple(t.split("\n")[k:k + 3])) for i, t in rows if t is not None
        for k in range(len(t.split("\n")) - 2))
    gone = set()
    for i, k, w in windows:
        if not "".join(w).strip():
            continue
        if w in seen:
            gone |= {(i, k), (i, k + 1), (i, k + 2)}
        seen.setdefault(w, (i, k))
    for i, t in rows:
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abc ") for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n\n\n\n"), (63, "one\ntwo"), (64, rows[3][1])]
    docs = documents(spark, [(i, t, "x") for i, t in rows]).withColumn("removed_lines", F.lit("clash"))
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_removes_long_passages_on_one_or_two_lines(spark):
    rng = random.Random(15)
    one, two = prose(rng, 50), prose(rng, 30) + "\n" + prose(rng, 20)
    short = prose(rng, 49)
    rows = [
        (1, f"a\n{one}\nb"), (2, one), (3, f"{two}\nc"), (4, f"d\ne\n{two}\nf\n{one}"), (5, short), (6, short),
        (7, f"x\n{one}\ny\n{one}"), (8, f"  {one}"), (9, f"{one}\nb\nz"), (10, None)]
    got = {r["doc_id"]: (r["kept_text"], r["removed_lines"])
           for r in lines.dedup_lines(documents(spark, [(i, t, "x") for i, t in rows])).collect()}
    assert got == {
        1: (rows[0][1], 0), 2: ("", 1), 3: (rows[2][1], 0), 4: ("d\ne\nf", 3), 5: (short, 0), 6: (short, 0),
        7: ("x\ny", 2), 8: (f"  {one}", 0), 9: ("z", 2), 10: (None, 0)}


def test_line_dedup_of_repeated_ids(spark):
    passage, own = "p one\np two\np three", "own a\nown b\nown c\nown d"
    rows = [(1, passage), (2, f"{passage}\nend"), (2, own), (2, own), (None, passage), (3, f"{own}\n{passage}")]
    got = sorted(((r["doc_id"], r["text"], r["kept_text"]) for r in lines.dedup_lines(
        documents(spark, [(i, t, "x") for i, t in rows])).collect()), key=repr)
    assert got == sorted([
        (1, passage, passage), (2, f"{passage}\nend", "end"), (2, own, own), (2, own, own), (None, passage, passage),
        (3, f"{own}\n{passage}", "")], key=repr)


# licences

def test_license_scan_finds_phrases_and_templates(spark):
    docs = documents(spark, [
        (1, "Released under the MIT License.\nmit-license CC BY 4", "x"), (2, None, "x"), (3, "", "x"),
        (4, "ALL RIGHTS\nreserved", "x"), (5, "x all,rights;RESERVED", "x"),
        (6, "licensed under apache license version 2 0", "x"), (7, "mit license", "x"), (7, "all rights reserved", "x"),
        (None, "all rights reserved", "x")])
    rows = licenses.license_scan(docs.withColumn("labels", F.lit(1)).withColumn("t", F.lit("x"))).collect()
    got = {r["doc_id"]: r for r in rows}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (10, 3, 3, 7)
    assert got[1]["base_labels"] == "cc-by,mit" and got[1]["labels"] == "cc-by,mit,mit-notice"
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "", 0.0)
    assert got[4]["labels"] == "all-rights-reserved" and got[5]["labels"] == "all-rights-reserved"
    assert got[6]["labels"] == "apache"  # 7 of 8 words are less than nine tenths
    assert sorted(r["labels"] for r in rows if r["doc_id"] == 7) == ["all-rights-reserved", "mit"]
    assert got[None]["labels"] == "all-rights-reserved"
    assert licenses.license_scan(docs.limit(0)).count() == 0
    assert {r["labels"] for r in licenses.license_scan(docs, templates={}).collect()} == {"", "apache", "cc-by,mit", "mit"}


def brute_labels(text, templates, threshold):
    words = (text or "").split()
    best = {}
    for label, told in templates.items():
        own, n = set(told.split()), len(told.split())
        for i in range(0, len(words), (n + 1) // 2):
            overlap = len(own & set(words[i:i + 2 * n]))
            if threshold[1] * overlap >= threshold[0] * len(own):
                best[label] = max(best.get(label, 0), overlap / len(own))
    return ",".join(sorted(best)), max(best.values(), default=0.0)


@pytest.mark.parametrize("many, threshold", [(6, (6, 10)), (200, (9, 10))])
def test_license_scan_equals_every_block_against_every_template(spark, many, threshold):
    rng = random.Random(9)
    templates = {f"t{k:03}": prose(rng, rng.randrange(3, 9 if many < 9 else 60)) for k in range(many)}
    texts = ["\n".join(prose(rng, rng.randrange(0, 12)) for _ in range(rng.randrange(9))) for _ in range(80)]
    texts += [prose(rng, 40) + "\n" + "\n * ".join(rng.choice(list(templates.values())).split()) + prose(rng, 9) for _ in range(20)]
    docs = documents(spark, [(i, t, "x") for i, t in enumerate(texts)])
    got = fetched(licenses.license_scan(docs, {}, templates, threshold), "doc_id", "labels", "score")
    want = [(i, *brute_labels(t.replace("*", ""), templates, threshold)) for i, t in enumerate(texts)]
    assert got == want and sum(bool(labels) for _, labels, _ in want) > 15


def test_license_scan_of_wrapped_notices_and_of_scattered_words(spark):
    rng = random.Random(16)
    rows, expected = [], {}
    for i, (label, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        wrapped = "\n".join(" * " + " ".join(w[k:k + 4]) for k in range(0, len(w), 4))
        rows.append((i, f"{prose(rng, rng.randrange(90))}\n{wrapped}\n{prose(rng, rng.randrange(90))}", "x"))
        expected[i] = label
    # Its words far apart are no notice, on one line or on several.
    apart = ["all", "rights", "reserved"], ["licensed", "under", "cc", "sa", "by", "4", "0"]
    rows += [(50 + i, gap.join(w), "x") for i, w in enumerate(apart) for gap in (f" {prose(rng, 1000)} ",)]
    rows += [(60 + i, f"\n{prose(rng, 20)}\n".join(w), "x") for i, w in enumerate(apart)]
    got = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, rows)).collect()}
    for i, label in expected.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert [got[i]["labels"] for i in (50, 51, 60, 61)] == [""] * 4


# quality

def test_quality_features_and_cascade(spark):
    rng = random.Random(3)
    good = prose(rng, 200)
    texts = [good, None, "", "a b", "x y z " * 40, good.upper(), " ".join(w + "###" for w in good.split()), "\n".join(["same line"] * 30)]
    docs = documents(spark, [(i, t, "x") for i, t in enumerate(texts)])
    facts = ["n_words", "n_repeat_words", "n_dup_lines", "n_symbols", "word_chars"]
    got = {r["doc_id"]: r for r in quality.quality_report(docs, facts=facts).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        held = [x for x in (t or "").split("\n") if x.strip()]
        assert tuple(got[i][f] for f in facts) == (
            len(w), len(covered), len(held) - len(set(held)), sum((t or "").count(c) for c in "#*$%&|<>"), sum(map(len, w)))
    assert [i for i in got if got[i]["failed"] is None] == [0]
    kept = quality.quality_filter(docs)
    assert fetched(kept, "doc_id") == [(0,)] and kept.columns == docs.columns
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    a, b, c = (quality.Rule(n, None) for n in "abc")
    assert quality.by_rejection_per_cost([(a, 2.0, 0.1), (b, 0.1, 0.1), (c, 1.0, 0.9)]) == [b, c, a]


# near dedup

def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(1, 120))) for i in range(40)]
    base = prose(rng, 150).split()
    for i in range(40, 140):  # one group of near copies, many of them too far from one another
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, rows[0][1].upper()), (204, "a b"), (205, "a b")]
    docs = documents(spark, [(i, t, "x") for i, t in rows]).withColumn("kept", F.lit(0))
    assert fetched(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == brute_groups(rows)


def test_bands_follow_the_similarity(spark):
    assert minhash.banding((85, 100)) == (26, 5)
    for part in (1, 10, 30, 50, 80, 99, 100):
        bands, rows = minhash.banding((part, 100))
        assert (1 - (part / 100) ** rows) ** bands <= minhash.MISS
    # 60 unrelated pairs with 64 of 125 to 128 shingles in common: 26 bands of 5 miss two fifths of such pairs.
    rows = []
    for i in range(60):
        head = [f"h{i}x{k}" for k in range(68)]
        rows += [(2 * i, " ".join(head + [f"a{i}x{k}" for k in range(36 - i % 4)])),
                 (2 * i + 1, " ".join(head + [f"b{i}x{k}" for k in range(28)]))]
    docs = documents(spark, [(i, t, "x") for i, t in rows])
    got = fetched(minhash.near_duplicates(docs, similarity=(50, 100)), "doc_id", "component_id")
    assert got == [(i, i - i % 2) for i in range(120)]


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    import corpus_pipeline
    base = [f"w{k}" for k in range(104)]
    near, far = base[:93] + [f"n{k}" for k in range(11)], base[:92] + [f"f{k}" for k in range(12)]
    assert 80 <= 100 * 89 / 111 < 85 and 100 * 88 / 112 < 80
    docs = documents(spark, [(1, " ".join(base), "x"), (2, " ".join(near), "x"), (3, " ".join(far), "x")])
    assert fetched(corpus_pipeline.one_of_near_duplicates(spark, docs, ""), "doc_id") == [(1,), (3,)]


def test_super_minhash_estimates_with_low_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 130).astype(np.uint64)
        a, b = np.sort(pool[:100]), np.sort(pool[30:])
        one, two = minhash.super_minhash([a, b], 130)
        errors.append((one == two).mean() - 70 / 130)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (70 * 60 / 130**3) ** 0.5
    assert (minhash.super_minhash([pool[:1]], 130)[0] >> np.uint64(32)).max() == 129


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(70, 71), (5, 5), (None, 3)], "u long, v long")
    got = fetched(components.components(edges), "node", "component")
    assert got == [(i, 0) for i in range(51)] + [(70, 70), (71, 70)]


# packing

def test_packing_covers_every_id_once_and_keeps_the_mixture(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice((1, 30, 700))), rng.choice(("a", "a", "a", "b", None))) for i in range(120)]
    rows += [(503, "a <|endoftext|> b", "a"), (504, "<|startoftext|>Up<|ENDOFTEXT|>", "b"), (505, "µσİ. don't '<|end", "b")]
    rows += [(500, None, "b"), (501, "", None), (502, "Ébène, “x” it's 42.\tNEW\nline", "a"), (502, "again", "a")]
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    expected = sorted(
        (i, zlib.crc32(np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
        for i, t, _ in rows if i != 502)
    docs = documents(spark, rows).withColumn("offset", F.lit("clash"))
    got = packing.pack(docs, path).collect()
    single = sorted((r["doc_id"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"])
    assert set(single) <= {(i, c) for i, c in expected} | {(r["doc_id"], r["ids_crc32"]) for r in got if r["doc_id"] == 502}
    lengths = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    for i, t, _ in rows:
        if i != 502:
            assert lengths[i] == len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["source"]))
    last = max(by_sequence)
    for number, held in by_sequence.items():
        held.sort()
        assert [o for o, _, _ in held] == [sum(n for _, n, _ in held[:k]) for k in range(len(held))]
        assert number == last or sum(n for _, n, _ in held) == packing.SEQUENCE
    total = sum(r["length"] for r in got)
    share = sum(r["length"] for r in got if r["source"] == "a") / total
    for number in range(last - 1):
        mine = sum(n for _, n, s in by_sequence[number] if s == "a")
        assert abs(mine - share * packing.SEQUENCE) <= 3 * packing.PACKET
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_looks_distinct_parts_up_once_and_keeps_the_plain_ids(monkeypatch):
    looked = []

    class Counted(packing.PartIds):
        def get(self, part):
            looked.append(part)
            return super().get(part)

    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    texts = ["The cat, the END. a$$$, b,. c'S, É. ½, 1984.\nthe  cat.", "", ". , .", "a\x85, b\xa0.", "NOËL,\tx..",
             "İ, ſ. e\u0301, 漢. Cat, <|", "a, <|endoftext|>, <|STARTOFTEXT|>. B,"] * 40
    expected = [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for most in (5 << 18, 8):  # with room, and forgetting again and again
        monkeypatch.setattr(packing, "REMEMBERED", most)
        known = Counted(path)
        for _ in range(2):
            looked.clear()
            found = known.ids(texts)
            assert len(looked) <= 2 * len({p for t in texts for p in t.split()}) + 10
            assert [np.frombuffer(ids.as_buffer(), known.dtype).tolist() for ids in found] == expected


def test_packing_remembers_a_bounded_number_of_parts_and_learns_in_portions(monkeypatch):
    learned = []

    class Counted(packing.PartIds):
        def learn(self, parts):
            learned.append(len(parts))
            super().learn(parts)

    assert packing.REMEMBERED <= 3 << 18  # about 180 bytes each
    monkeypatch.setattr(packing, "REMEMBERED", 600)
    monkeypatch.setattr(packing, "PORTION", 64)
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    known = Counted(path)
    for k in range(8):
        texts = [f"often seen, word{chr(97 + k)}{chr(97 + i)}x rest-{chr(97 + k)}{i % 9}." for i in range(26)] * 8
        texts += ["".join(chr(97 + (i * 7 + k * j) % 26) for j in range(1, 9)) + "." for i in range(200)]
        expected = [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        found = known.ids(texts)
        assert [np.frombuffer(ids.as_buffer(), known.dtype).tolist() for ids in found] == expected
        assert len(known) <= 600 + 300 and "often" in known and "seen" in known
    assert max(learned) <= 64


def test_near_dedup_leaves_no_words_with_the_worker():
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three four five six", None]})
    assert minhash.REMEMBERED <= 1 << 18  # about 200 bytes each
    for task in (minhash._signer(29, 4), minhash._whole_sets):
        steps = task(iter([rows.slice(0, 1)]))
        assert next(steps).num_rows == 1 and len(minhash._hash_of) > 0
        assert list(steps) == [] and not minhash._hash_of


def test_packing_forgets_and_learns_without_walking_through_all_it_knows(monkeypatch):
    class Watched(packing.PartIds):
        walks = 0

        def __iter__(self):
            Watched.walks += 1
            return super().__iter__()

    assert packing.REMEMBERED <= 1 << 19 and packing.TOGETHER <= 2 << 20 and packing.PORTION <= 1 << 13
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    monkeypatch.setattr(packing, "PORTION", 16)
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    known = Watched(path)
    for k in range(6):
        texts = [f"often, seen word{chr(97 + k)}{chr(97 + i)}x, X{i}y-{k}{i}. often. Größe, 漢{i}字" for i in range(26)] * 2
        found = known.ids(texts)
        expected = [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert [np.frombuffer(ids.as_buffer(), known.dtype).tolist() for ids in found] == expected
    assert Watched.walks == 0 and "seen" in known


def test_packing_and_near_dedup_give_room_back_between_batches(monkeypatch):
    assert minhash.CHUNK <= 1 << 15 and minhash.REMEMBERED <= 1 << 17
    rng = random.Random(11)
    rows = pa.RecordBatch.from_pydict({
        "doc_id": list(range(40)), "source": ["a"] * 40, "text": [prose(rng, 300) for _ in range(40)]})

    def parts_of(batches, *names):
        return [tuple(b.column(n)[i].as_py() for n in names) for b in batches for i in range(b.num_rows)]

    path = public_tokenizers.path("word_bpe_49k.json")
    once = parts_of(packing.tokenize(path)(iter([rows])), "doc_id", "n_tokens", "ids")
    signed = parts_of(minhash._signer(29, 4)(iter([rows])), "doc_id", "n_shingles", "node", "bands")
    monkeypatch.setattr(packing, "TOGETHER", 1 << 11)
    monkeypatch.setattr(minhash, "CHUNK", 1 << 9)
    assert parts_of(packing.tokenize(path)(iter([rows])), "doc_id", "n_tokens", "ids") == once
    assert parts_of(minhash._signer(29, 4)(iter([rows])), "doc_id", "n_shingles", "node", "bands") == signed


def test_packing_checksums_are_those_of_the_pieces(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice((2, 300, 2500))), rng.choice("aab")) for i in range(40)] + [(7, None, None)]
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    ids = [(i, whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows]
    got = packing.pack(documents(spark, rows), path).collect()
    assert max(r.length for r in got) > packing.PACKET and sum(r.length for r in got) == sum(len(x) for _, x in ids)
    for r in got:
        assert r.ids_crc32 in {zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes())
                               for i, x in ids if i == r.doc_id and len(x) == r.doc_tokens}


def served_by_rounds(queues, quanta, packet=256):
    """Deficit round-robin as it is usually told: (doc_id, start, length) of every packet in order."""
    left = {s: [(d, k, min(packet, n - k)) for d, n in docs for k in range(0, n, packet)] for s, docs in queues.items()}
    deficit, out = dict.fromkeys(quanta, 0.0), []
    while any(left[s] for s in quanta):
        for s in sorted(quanta):
            deficit[s] += quanta[s]
            while left[s] and left[s][0][2] <= deficit[s] + 1e-6:
                deficit[s] -= left[s][0][2]
                out.append(left[s].pop(0))
    return out


def test_packing_by_weights_equals_plain_rounds(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.choice((3, 60, 400))), rng.choice("aabcd")) for i in range(160)]
    weights = {"a": 1, "b": 3, "nowhere": 4}
    got = packing.pack(documents(spark, rows), public_tokenizers.path("word_bpe_49k.json"), weights).collect()
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    queues = {}
    for r in got:
        docs = queues.setdefault(r.source, [])
        if (r.doc_id, r.doc_tokens) not in docs:
            docs.append((r.doc_id, r.doc_tokens))
    size = {s: sum(n for _, n in docs) for s, docs in queues.items()}
    rest = size["c"] + size["d"]
    want = served_by_rounds(queues, {s: 2048 * weights[s] / 8 for s in "ab"})
    want += served_by_rounds(queues, {s: 2048 * size[s] / rest for s in "cd"})
    assert [(d, k + i) for d, k, n in want for i in range(n)] == [
        (r.doc_id, r.start + i) for r in got for i in range(r.length)]


# toxicity

def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        w = prose(rng, 80).split()
        if i % 3 == 0:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(("vilewordone", "hatefulthing", "nastyphrase"))
        rows.append((i, " ".join(w), "x"))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = documents(spark, rows), spark.createDataFrame(marks + [(None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    more = documents(spark, [(1000, None, "x"), (1001, "", "x")])
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs.unionByName(more), model).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in unseen)
    right = [got[i]["predicted"] == int(i % 3 == 0) for i in unseen]
    assert sum(right) / len(right) >= 0.9
    assert got[1000]["score"] == got[1001]["score"] and got[1000]["predicted"] == 0
    empty = toxicity.train_on(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs.limit(3), empty).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_learns_from_texts_with_a_common_passage():
    rng = random.Random(12)
    shared, vile = prose(rng, 40), ("vilewordone", "hatefulthing", "nastyphrase")
    toxic, ordinary = [], []
    for _ in range(60):
        w = prose(rng, 60).split()
        for word in vile:
            w[rng.randrange(60)] = word
        toxic.append(shared + " " + " ".join(w))
    ordinary = [prose(rng, 80) for _ in range(120)]
    model = toxicity.train(toxic, ordinary, 0.3)
    assert model.learned == (60, 120)
    scores = toxicity.Scorer(model).scores([shared + " " + prose(rng, 30) + " hatefulthing nastyphrase vilewordone", prose(rng, 60)])
    assert scores[0] >= toxicity.TOXIC_FROM > scores[1]
    copied = toxicity.train(toxic + toxic[:20], ordinary + ordinary, 0.3)
    assert copied.learned == (60, 120)
    # The passage itself is toxic and the same in every text.
    passage = prose(rng, 20) + " vilewordone hatefulthing nastyphrase " + prose(rng, 20)
    model = toxicity.train([passage + " " + prose(rng, 40) for _ in range(60)], ordinary, 0.3)
    assert len(model.weights) and toxicity.Scorer(model).scores([passage + " " + prose(rng, 40)])[0] >= toxicity.TOXIC_FROM


def test_toxic_rows_without_a_model_are_an_error():
    rng = random.Random(13)
    with pytest.raises(ValueError, match="no toxicity model from 2 toxic"):
        toxicity.train([prose(rng, 40), prose(rng, 40)], [prose(rng, 40) for _ in range(50)], 0.1)


# HTML

LONG = "This is a long paragraph of the article with many words in it, so that its ratio is high enough."


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<", "<"), ("plain  text", "plain text"),
    ("<nav><a href=x>a</a></nav><article><h1>T &amp; t</h1><p>one\n two<p><b>three<br>four</article><footer>f</footer>",
     "T & t\n\none two\n\nthree four"),
    ("<body><article><p>Text of it</p><div class='comments'><p>A long comment by a reader of this</p></div></article>", "Text of it"),
    ("<script>var t='</p>';</script><main><p>x</p><form><p>y</p></form><aside>z</aside></main>", "x"),
    # names and forms around everything
    (f'<div class="site no-sidebar"><article><h1>T</h1><p>{LONG}</p></article></div>', f"T\n\n{LONG}"),
    (f'<div class="page-header-wrap"><main><p>{LONG}</p></main></div>', LONG),
    (f'<form id="aspnetForm"><div><p>{LONG}</p></div></form>', LONG),
    # several regions
    (f'<article><p>{LONG}</p></article><div class="ad">Buy</div><article><p>2 {LONG}</p></article>', f"{LONG}\n\n2 {LONG}"),
    # an article's own sections, and what is none of them
    (f'<article><p>{LONG}</p><section id="discussion"><p>D {LONG}</p></section><div id="side-effects"><p>S {LONG}</p>'
     "</div></article>", f"{LONG}\n\nD {LONG}\n\nS {LONG}"),
    (f'<article><p>{LONG}</p><div id="side-links"><a>a</a><a>b</a><br><a>c</a><a>d</a></div></article>', LONG),
    (f'<article><p>{LONG}</p><section class="comments"><p>C {LONG}</p><p>C {LONG}</p><p>C {LONG}</p></section></article>', LONG),
    (f'<main><article><p>{LONG}</p></article></main><div id="comments"><article class="comment"><p>C {LONG * 3}</p>'
     "</article></div>", LONG),
    (f"<article><p>{LONG}</p><aside><article><p>A card</p></article></aside></article>", LONG),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_main_text_of_generated_pages():
    """Pages of known articles: whatever stands around them, the article comes out whole and alone."""
    rng = random.Random(21)
    around = ["<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<footer><p>(c) 2020 Us</p></footer>",
              "<aside><h3>More</h3><p><a href=/c>Link</a></aside>", "<div class='cookie-notice'>We use cookies <b>ok</b></div>",
              "<div id='sidebar'><ul><li><a>x</a></ul></div>", "<script>if (a<b) { x('</p>') }</script>",
              "<form><label>Mail <input></label></form>", "<div class='ad-slot'><a href=/buy>Buy now</a></div>",
              "<section class='comments'><p>I liked it very much, thank you for it all</p></section>"]
    wrappers = ["<div class='page'>{}</div>", "<div class='layout no-sidebar'>{}</div>", "<form id='f'>{}</form>",
                "<div id='header-and-page'>{}</div>", "{}"]
    articles = ["<article>{}</article>", "<main>{}</main>", "<div class='entry-content'>{}</div>",
                "<div id='main-content'><article>{}</article></div>"]
    for _ in range(300):
        blocks = [prose(rng, rng.randrange(25, 70)) for _ in range(rng.randrange(2, 9))]
        inside = "".join(f"<{t}>{b.replace(' ', '  ', 3)}</{t}>" for b in blocks for t in [rng.choice(("p", "p", "div", "blockquote"))])
        page = rng.choice(wrappers).format("".join(rng.sample(around, 3)) + rng.choice(articles).format(inside))
        page = "".join(rng.sample(around, 2)) + page + "".join(rng.sample(around, 2))
        assert html_text.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == "\n\n".join(blocks)


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é</article>"), (2, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in html_text.extract_pages(pages.withColumn("text", F.lit(0))).orderBy("page_id").collect()] == [
        (1, "u", "é", 1), (2, None, "", 0)]


# chat

def test_chat_round_trip_of_hostile_turns():
    parts = [chat.START, chat.END, "<", "\\", "|", "\n", "a", "<\\|", "<\\\\|im_end|>"]
    rng = random.Random(6)
    for _ in range(2000):
        turns = [("".join(rng.choices(parts, k=rng.randrange(3))), "".join(rng.choices(parts, k=rng.randrange(6)))) for _ in range(3)]
        assert chat.recovered(chat.format_chat(turns)) == turns
    assert chat.recovered("<|im_start|>user\nx") is None and chat.format_chat([]) == ""


def test_chat_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "<|im_end|>"), (None, 0, "user", "n"), (1, 1, "assistant", "b")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(said).collect()}
    assert chat.recovered(got[1]["formatted"]) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.recovered(got[2]["formatted"]) == [("", "<|im_end|>")] and len(got) == 3
    assert [got[1]["formatted"][a:b] for a, b in zip(got[1]["loss_start"], got[1]["loss_end"])] == ["b", "b"]


# pieces

def test_streaming_viterbi_equals_the_library():
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    encoder, rng = pieces.Encoder(vocabulary), random.Random(8)
    letters = "abcdeéß. ,\n\t  the and ing 漢字かな0123😀 <0x0A>"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 150)))
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode(text) and pieces.decode(vocabulary, ids) == text
    stream, long = pieces.StreamingViterbi(vocabulary), "thequickbrownfox" * 4000
    ids = [i for k in range(0, len(long), 777) for i in stream.feed(long[k:k + 777])] + stream.finish()
    assert "".join(vocabulary.names[i] for i in ids) == long and stream.widest <= 2 * pieces.STRIDE


def test_texts_of_batches_equal_those_of_single_lists():
    ids = {"▁": 3, "a": 4, "▁a": 5, "é": 6, "\n": 7}
    vocabulary = pieces.Vocabulary.of(ids, dict.fromkeys(ids, 0.0), "bpe", {b: 10 + b for b in range(256)})
    rng, raw = random.Random(3), [10 + b for b in b"\xe2\x96\x81\xf0\xc3\xa9 \x80"]
    lists = [[rng.choice([*ids.values(), *raw, 0, 999, -1]) for _ in range(rng.randrange(12))] for _ in range(300)]
    array = pa.array([[4], *lists], pa.list_(pa.int32())).slice(1)
    assert pieces.Decoder(vocabulary).texts(array).to_pylist() == [pieces.decode(vocabulary, x) for x in lists]


def test_every_piece_that_may_end_a_path_is_seen_once():
    """The search reads a character once, however long the pieces that begin before it."""
    class Counted(str):
        sliced = 0

        def __getitem__(self, at):
            Counted.sliced += isinstance(at, slice)
            return str.__getitem__(self, at)

    names = ["a" * n for n in range(1, 33)] + ["b"]
    scores = {n: -float(k) for k, n in enumerate(names)}
    vocabulary = pieces.Vocabulary.of({n: k for k, n in enumerate(names)}, scores, "unigram", {}, 99)
    stream = pieces.StreamingViterbi(vocabulary)
    assert "".join(names[i] for i in stream.feed(Counted("a" * 60 + "b")) + stream.finish()) == "a" * 60 + "b"
    assert Counted.sliced == 0 and len(vocabulary.nodes) == 33


def test_unigram_paths_have_the_best_total():
    rng = random.Random(7)
    names = list("abc") + ["ab", "bc", "abc", "ca", "cab", "bca"]
    scores = {n: -rng.random() * len(n) for n in names}
    vocabulary = pieces.Vocabulary.of({n: k for k, n in enumerate(names)}, scores, "unigram", {}, 99)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 200)))
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            best[i] = max(best[j] + scores[text[j:i]] for j in range(max(0, i - 3), i) if text[j:i] in scores)
        stream = pieces.StreamingViterbi(vocabulary)
        ids = stream.feed(text) + stream.finish()
        assert "".join(names[i] for i in ids) == text
        assert sum(scores[names[i]] for i in ids) == pytest.approx(best[-1])


def test_encoded_documents(spark):
    docs = documents(spark, [(1, None, "x"), (2, "", "x"), (3, "it is\n  so ", "x")]).withColumn("ids", F.lit(0))
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.decode_documents(pieces.encode_documents(docs, path), path).orderBy("doc_id").collect()
    assert [r["decoded"] for r in got] == ["", "", "it is\n  so "] and got[0]["ids"] == []


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= kept
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept
