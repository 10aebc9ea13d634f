"""Near-dedup: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import stored
from gradelake.llm.components import components

#: Words of a shingle.
WIDTH = 5
#: Least similarity, as numerator and denominator.
SIMILARITY = (85, 100)
#: Largest chance that a pair at exactly the least similarity misses every band
#: (independent slots; SuperMinHash varies less).
MISS = 2.5e-7
#: Slots of a signature, unless one slot per band needs more.
SLOTS = 130
#: Shingles whose signatures are computed together.
CHUNK = 1 << 15
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 17

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, remembered until the end of a task: its worker goes on to other work."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _Words()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z.

    Fewer words than ``width`` are one shingle, none give none.
    """
    words = (text or "").encode().lower().split()  # splits at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    folded = np.full(n, span, np.uint64)
    for k in range(span):
        folded = folded * _FOLD + h[k:k + n]
    return np.unique(mix(folded))


def super_minhash(sets: Sequence[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row each.

    Every element visits all slots in an order of its own, a Fisher-Yates permutation, and
    at its j-th visit offers j plus a random fraction, so an element is best at one slot at
    most by rank and the slots of a signature vary less than independent ones. Ranks are
    taken in order: a document stops as soon as no slot is empty, since later ranks only
    offer more. Values are rank * 2^32 + fraction.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets)
    empty = np.uint64(2**64 - 1)
    out = np.full(len(sets) * slots, empty, np.uint64)
    order = None
    for rank in range(slots):
        if not len(element):
            break
        x = mix(element + np.uint64((rank + 1) * int(_GOLDEN) % 2**64))
        pick = rank + (((x >> np.uint64(32)) * np.uint64(slots - rank)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(rank) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
        if rank == 0:
            slot = pick
        else:
            rows = np.arange(len(element))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, rank]
        np.minimum.at(out, owner * slots + slot, value)
        open_sets = (out.reshape(-1, slots) == empty).any(axis=1)
        stay = open_sets[owner]
        if rank == 0:
            pick = pick[stay]
            order = np.empty((len(pick), slots), np.uint16)
            order[:] = np.arange(slots, dtype=np.uint16)
            order[np.arange(len(pick)), pick] = 0
        else:
            order = order[stay]
        element, owner = element[stay], owner[stay]
    return out.reshape(-1, slots)


def banding(similarity: tuple[int, int]) -> tuple[int, int]:
    """Bands and slots per band: the longest bands in ``SLOTS`` that keep the chance ``MISS``.

    26 bands of 5 at 0.85, 29 of 4 at 0.80, 53 of 2 at 0.50.
    """
    s = similarity[0] / similarity[1]
    if not 0 < s <= 1:
        raise ValueError(f"similarity {similarity} is not above 0 and up to 1")
    fitting = (1, 1)
    for rows in range(1, SLOTS + 1):
        bands = 1 if s == 1 else math.ceil(math.log(MISS) / math.log1p(-s**rows))
        if rows > 1 and bands * rows > SLOTS:
            break
        fitting = (bands, rows)
    return fitting


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        keys = mix(keys * _FOLD + parts[:, :, k])
    return keys


def digest(s: np.ndarray) -> bytes:
    """128 bits that depend on the elements of a set only."""
    low, high = mix(s ^ _GOLDEN), mix(s + _FOLD)
    return int(low.sum(dtype=np.uint64)).to_bytes(8, "little") + int(high.sum(dtype=np.uint64)).to_bytes(8, "little")


_SIGNED = "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>"
_SETS = "node binary, shingles array<bigint>"


def _signer(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            start, held, total = 0, [], 0
            for i in range(batch.num_rows):
                held.append(shingles(texts[i].as_py()))
                total += len(held[-1])
                if total >= CHUNK or i + 1 == batch.num_rows:
                    yield _signed(ids.slice(start, len(held)), held, bands, rows)
                    start, held, total = i + 1, [], 0
        _hash_of.clear()

    return sign


def _signed(ids: pa.Array, sets: list[np.ndarray], bands: int, rows: int) -> pa.RecordBatch:
    filled = [s for s in sets if len(s)]
    keys = np.empty((0, bands), np.uint64)
    if filled:
        keys = band_keys(super_minhash(filled, bands * rows), bands, rows)
    ends = np.cumsum([0] + [bands if len(s) else 0 for s in sets]).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        ids.cast(pa.int64()),
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel())),
    ], names=["doc_id", "n_shingles", "node", "bands"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, total = [], 0
        for i, text in enumerate(batch.column("text")):
            held.append(shingles(text.as_py()))
            total += len(held[-1])
            if total >= CHUNK or i + 1 == batch.num_rows:
                ends = np.cumsum([0] + [len(s) for s in held]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest(s) for s in held], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(np.concatenate(held).view(np.int64))),
                ], names=["node", "shingles"])
                held, total = [], 0
    _hash_of.clear()


def _reaches(common, n_u, n_v, similarity: tuple[int, int]):
    """Whether sets of these sizes with so much in common are similar enough."""
    return (similarity[0] + similarity[1]) * common >= similarity[0] * (n_u + n_v)


def _in_common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, common, n_u, n_v of pairs of nodes, from their whole sets."""
    one = sets.select(F.col("node").alias("v"), F.col("shingles").alias("of_v"))
    two = sets.select(F.col("node").alias("u"), F.col("shingles").alias("of_u"))
    both = pairs.join(one, "v").join(two, "u")
    return both.select(
        "u", "v", F.size(F.array_intersect("of_u", "of_v")).alias("common"),
        F.size("of_u").alias("n_u"), F.size("of_v").alias("n_v"))


def _similar(tested: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    return tested.where(
        _reaches(F.col("common"), F.col("n_u"), F.col("n_v"), similarity)).select("u", "v")


def _named(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of nodes with their component, the node itself where it has no link."""
    return rows.join(grouped, "node", "left").withColumn(
        "comp", F.coalesce("component", "node")).drop("component")


def _open_pairs(
    members: DataFrame, tested: DataFrame, sets: DataFrame, grouped: DataFrame,
    similarity: tuple[int, int],
) -> DataFrame:
    """u, v: pairs of a bucket that are not in one component and could still be similar.

    Each member i knows its leader L: a = |i & L| and the rest e of i outside L that at least one
    other open node holds. Two members have at most min(a, a') + min(e, e') shingles in common.
    A member whose own a + e is too small for any size in its bucket is out before it meets
    another, and only members outside the leader's component look for partners.
    """
    live = _named(members, grouped)
    leads = grouped.select(F.col("node").alias("lead"), F.col("component").alias("lead_group"))
    live = live.join(leads, "lead", "left").withColumn("main", F.coalesce("lead_group", "lead")).drop("lead_group")
    facts = live.groupBy("band", "key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least")
    ).where("low <> high").drop("low", "high")
    live = stored(live.join(facts, ["band", "key"]))
    alone = (
        sets.join(live.select("node").distinct(), "node")
        .select("node", F.explode("shingles").alias("x"))
        .groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
        .groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    )
    against = tested.select(F.col("u").alias("lead"), F.col("v").alias("node"), "common")
    known = (
        live.join(against, ["lead", "node"], "left").join(alone, "node", "left")
        .withColumn("a", F.coalesce("common", "n"))  # the leader itself
        .withColumn("e", F.col("n") - F.col("a") - F.when(F.col("common").isNull(), 0).otherwise(F.coalesce("own", F.lit(0))))
        .select("band", "key", "node", "n", "comp", "main", "a", "e", "least")
    )
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * similarity[0] / similarity[1]))
    able = stored(known.where(_reaches(F.col("a") + F.col("e"), F.col("n"), smallest, similarity)).drop("least"))
    seeking = able.where("comp <> main").select(
        "band", "key", *[F.col(c).alias(f"s_{c}") for c in ("node", "n", "comp", "a", "e")])
    most = F.least("a", "s_a") + F.least("e", "s_e")
    return seeking.join(
        able,
        (seeking["band"] == able["band"]) & (seeking["key"] == able["key"])
        & (F.col("comp") != F.col("s_comp")) & ((F.col("comp") == F.col("main")) | (F.col("node") < F.col("s_node")))
        & _reaches(most, F.col("n"), F.col("s_n"), similarity),
    ).select(F.col("s_node").alias("u"), F.col("node").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents with the same shingle set are one node, whatever their number. Nodes that
    agree in a band form a bucket. A bucket tests its leader, the node that shares the most
    buckets with others and so stands in the middle of a group of copies, against all its
    members: a star instead of all pairs. Buckets that are one component then are done. In
    the others, pairs across components are tested unless what both have in common with the
    leader, and what they hold beside it, rules them out. Every link is confirmed on the
    whole sets, and no pair of a bucket is left out: it is tested, joined by tested links
    already, or ruled out by an exact bound. A similar pair that shares no bucket is missed:
    the bands follow ``similarity``, so that a pair at it is missed with a chance of ``MISS``
    at most, and a more similar one less often.

    A document without words, or with a null text, has no shingles and is linked with
    nothing. Rows that repeat an id are separate rows of the same id; rows without an id
    can be linked but give no component id. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signer(*banding(similarity)), _SIGNED))
    nodes = stored(
        signed.where("n_shingles > 0").groupBy("node")
        .agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"),
             F.any_value("bands").alias("bands"))
    )
    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = stored(members.join(shared, ["band", "key"]))
    ranked = buckets.groupBy("node").agg(F.sum("c").alias("weight"))
    needed = ranked.join(nodes, "node").select(F.col("first_id").alias("_id")).distinct()
    sets = stored(
        texts.join(needed, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        .select("text").mapInArrow(_whole_sets, _SETS).dropDuplicates(["node"])
    )
    weighed = buckets.join(ranked, "node")
    lead = weighed.groupBy("band", "key").agg(F.max(F.struct("weight", "node")).alias("top"))
    led = stored(weighed.join(lead, ["band", "key"]).select(
        "band", "key", "node", F.col("n").cast("int").alias("n"), F.col("top.node").alias("lead")))
    stars = led.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct()
    tested = stored(_in_common(stars, sets))
    links = _similar(tested, similarity)
    grouped = components(links)
    more = stored(_similar(
        _in_common(_open_pairs(led, tested, sets, grouped, similarity), sets), similarity))
    if not more.isEmpty():
        grouped = components(links.unionByName(more))
    named = nodes.select("node", "first_id").join(grouped, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "first_id")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component_id")
    joined = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
