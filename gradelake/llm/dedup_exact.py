"""Exact dedup: groups by a 128-bit content hash, bytes compared inside groups. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import lower_ascii
from gradelake.session import cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stable_id: Column | None = None,
    normalize=lower_ascii,
    hash_text=content_hash,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents with equal normalised texts form a group; the row with the smallest
    ``stable_id`` (a non-null number, ``id_col`` by default) stays. Rows are grouped by
    (hash, text), so texts that share a hash are told apart by their bytes; copies
    combine before the shuffle, whatever their number. Documents then find their group
    by the hash alone. Only where one hash holds several texts, which one row per hash
    tells, are those documents joined by their bytes as well.

    A null text counts as empty. A row without an id is a member of its group and never
    stays unless no row of the group has an id. Rows that repeat an id and its text are
    one document twice: both count, and both are kept or dropped. Other columns are not
    read, so their names cannot clash. An empty table gives an empty table.
    """
    ident = F.col(id_col)
    rows = docs.select(
        ident.alias("doc_id"),
        (ident if stable_id is None else stable_id).alias("sid"),
        normalize(F.col(text_col)).alias("norm"),
    ).withColumn("h", hash_text(F.col("norm")))
    best = F.min(F.struct(F.col("sid").isNull().alias("none"), "sid", "doc_id"))
    texts = rows.groupBy("h", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    # One narrow row per hash, kept so that the texts are grouped once.
    hashes = cut_lineage(
        texts.groupBy("h").agg(
            F.count(F.lit(1)).alias("texts"), F.min("best").alias("best"), F.sum("n").alias("n")
        )
    )
    light = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    found = light.join(hashes.where("texts = 1").drop("texts"), "h")
    clashing = hashes.where("texts > 1").select("h")
    if not clashing.isEmpty():
        exact = texts.join(clashing, "h", "left_semi")
        found = found.unionByName(
            rows.join(exact, ["h", "norm"]).select(
                "h", "doc_id", F.sha2("norm", 256).alias("text_sha256"), "best", "n"
            )
        )
    keep = F.col("best.doc_id")
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
