"""All rows of the pipeline against plain Python; only the toxicity model is the operator's own."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from gradelake.llm import toxicity
from gradelake.llm.common import importable

WORDS = [a + b for a in ("ka", "lo", "mi", "ner", "os", "pra") for b in ("t", "vel", "dun", "ish", "o")]
VILE = ("vilewordone", "hatefulthing", "nastyphrase")


def prose(rng, n, line=12):
    w = [rng.choice(WORDS) + rng.choice("bcdfg") for _ in range(n)]
    return "\n".join(" ".join(w[k:k + line]) for k in range(0, n, line))


def fixture(rng):
    texts = []
    for i in range(300):
        w = prose(rng, 90, 90).split()
        if i % 3 == 0:
            for word in VILE:
                w[rng.randrange(90)] = word
        texts.append("\n".join(" ".join(w[k:k + 12]) for k in range(0, 90, 12)))
    block, paragraph = prose(rng, 36), prose(rng, 60, 60)
    for _ in range(4):
        texts += [prose(rng, 96) + "\n" + block + "\n" + prose(rng, 24), prose(rng, 96) + "\n" + paragraph]
    base = prose(rng, 104, 104).split()
    for changed in (6, 11, 12):  # 0.89, 0.80, 0.79 of the first
        texts += [" ".join(base), " ".join(base[:104 - changed] + [f"n{changed}x{k}" for k in range(changed)])]
    texts += [None, "", "too short", "x y z " * 40, prose(rng, 80).upper(), prose(rng, 60).replace(" ", " ## "),
              "\n".join([prose(rng, 20, 20)] * 9), " ".join("ab" for _ in range(60)), prose(rng, 900)]
    sources = ("a", "a", "a", "b", "c", None)
    return [(i, t, "en", rng.choice(sources), len(t or "")) for i, t in enumerate(texts)]


def good(text):
    t = text or ""
    w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    often = {g for g in grams if grams.count(g) > 1}
    repeats = len({k + d for k, g in enumerate(grams) if g in often for d in range(3)})
    n, chars = len(w), sum(map(len, w))
    return not (n < 50 or 100 * repeats > 50 * n or 10 * sum(c in "#*$%&|<>" for c in t) > n
                or 100 * sum(c.isupper() for c in t) > 50 * chars
                or 100 * (len(lines) - len(set(lines))) > 30 * len(lines) or chars < 2 * n or chars > 20 * n)


def without_repeats(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines)):
            for width in (1, 2, 3):
                window = lines[k:k + width]
                if len(window) < width or not "".join(window).strip():
                    continue
                if width < 3 and len(" ".join(window).split()) < 50:
                    continue
                if tuple(window) in seen:
                    gone.update(range(k, k + width))
                seen.add(tuple(window))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def without_near_copies(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: t for i, t in texts.items() if group[i] == i}


def packed(texts, source, place):
    from tokenizers import Tokenizer
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: encoder.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    total, packets = sum(map(len, ids.values())), []
    for s in {source[i] for i in ids}:
        mine = sorted((i for i in ids if source[i] == s), key=lambda i: (place[i] % 2**64 >> 40, place[i], i))
        share, sent = sum(len(ids[i]) for i in mine) / total, 0
        for i in mine:
            for start in range(0, len(ids[i]), 256):
                length = min(256, len(ids[i]) - start)
                packets.append((-int(-(sent + length) / (share * 2048) // 1), s, sent, i, start, length))
                sent += length
    at, where = 0, {i: {} for i in ids}
    for _, _, _, i, start, length in sorted(packets):
        where[i].update({start + k: at + k for k in range(length)})
        at += length
    rows = []
    for i, found in where.items():
        cuts = [k for k in sorted(found) if k == 0 or found[k] != found[k - 1] + 1 or found[k] % 2048 == 0]
        for start, end in zip(cuts, [*cuts[1:], len(found)]):
            crc = zlib.crc32(np.array(ids[i][start:end], "<u4").tobytes())
            rows.append((i, start, end - start, crc, len(found), found[start] // 2048, found[start] % 2048, source[i]))
    return sorted(rows)


def test_run_equals_plain_python(spark, tmp_path):
    importable(spark)
    rows = fixture(random.Random(21))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train_on(docs.select("doc_id", "text"), labels)
    scores = toxicity.Scorer(model).scores([t for _, t, _, _, _ in rows])
    clean = {r[0]: r[1] for r, score in zip(rows, scores) if score < toxicity.TOXIC_FROM}
    fine = {i: t for i, t in clean.items() if good(t)}
    unlike = without_repeats(fine)
    left = without_near_copies(unlike)
    assert len(rows) > len(clean) > len(fine) > len(left) and unlike != fine  # every stage has work
    place = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    expected = packed(left, {i: s or "" for i, _, _, s, _ in rows}, place)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple((r[c] or "") if c == "source" else r[c] for c in columns) for r in got) == expected
