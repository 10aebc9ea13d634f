"""SimHash near-dedup by meet-in-the-middle balls: close fingerprints share a variant half-way."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.common import stored
from gradelake.llm.components import components

#: Words of a shingle, and the seed of a shingle's XXH64.
WIDTH, SEED = 3, 42
#: Most differing bits of linked fingerprints.
RADIUS = 2
#: Bytes of a text that are cut into words at once, and shingles whose bits are counted at once.
BLOCK, CHUNK = 1 << 20, 1 << 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SIGNED = "doc_id bigint, f bigint"


def word_blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about ``size`` bytes each."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first.

    Eight bits are added as the bytes of one number, 255 hashes at a time.
    """
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64)
    whole = len(hashes) // 255 * 255
    sums = bits[:whole * 8].reshape(-1, 255, 8).sum(axis=1)
    rest = bits[whole * 8:].reshape(-1, 8).sum(axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64) + rest.view(np.uint8)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The SimHash of a text's word shingles, repeats included; A-Z count as a-z.

    Fewer words than ``width`` are one shingle; without words the fingerprint is zero.
    """
    digest, ones, n, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for block in word_blocks((text or "").encode().lower()):
        words = tail + block
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
        left = max(0, len(words) - width + 1)
        n += left
        while left:
            now = min(left, CHUNK)
            ones += _ones(np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(now))), np.uint64, now))
            left -= now
        tail = words[-(width - 1):] if width > 1 else []
    if not n:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "f"])


def flips(bits: int) -> list[int]:
    """Every 64-bit mask of at most so many ones, as a signed number."""
    masks = [sum(1 << b for b in chosen) for k in range(bits + 1) for chosen in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links that join all distinct fingerprints ``f`` at ``radius`` or fewer bits into their groups.

    Every fingerprint emits its ball, all variants within half the radius: 65 for a radius of
    2. Two fingerprints at the radius or less share a variant, and two that share one are
    that close, so the fingerprints of a variant are all linked and a star around the
    smallest stands for their pairs. At most as many distinct fingerprints as a ball has
    variants can meet on one, however many documents are alike.
    """
    if radius < 0 or radius % 2:
        raise ValueError(f"radius {radius} is not an even number of bits")
    balls = fingerprints.select("f", F.explode(F.array(*map(F.lit, flips(radius // 2)))).alias("mask")).select(
        F.col("f").bitwiseXOR(F.col("mask").cast("bigint")).alias("variant"), "f")
    met = balls.withColumn("lead", F.min("f").over(Window.partitionBy("variant"))).where("f <> lead")
    pairs = met.select(F.col("lead").alias("u"), F.col("f").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) of every row.

    Documents of one fingerprint are one node, whatever their number, so only distinct
    fingerprints emit variants. A null or empty text, or one of white space, has fingerprint
    zero and is linked like any other. Texts are read by blocks, so a very long one needs
    little more memory than itself. Rows that repeat an id are separate rows of the same id;
    rows without an id link others but name no component, whose id is null if no row of it
    has one. An empty table gives an empty result. Other columns are not read, whatever
    their names.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_sign, _SIGNED))
    nodes = stored(signed.groupBy("f").agg(F.min("doc_id").alias("first_id")))
    grouped = components(links(nodes.select("f"), radius))
    named = nodes.join(grouped, F.col("f") == F.col("node"), "left").select(
        "f", "first_id", F.coalesce("component", "f").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fingerprint = named.join(smallest, "component").select("f", "component_id")
    return signed.join(of_fingerprint, "f").select(
        "doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
