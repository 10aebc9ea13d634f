"""A training corpus from raw documents: filters, dedup and packing, one stage after another.

Each stage reads what the one before kept, as Parquet from the shared folder. All but the
last return the columns of ``documents``, in their order.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gradelake.llm import lines, minhash, packing, quality, toxicity  # noqa: E402
from gradelake.llm.common import stored, table  # noqa: E402

#: Least similarity of near copies, for the pipeline only; op6 has a contract of its own.
SIMILARITY = (80, 100)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not call toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train_on(docs.select("doc_id", "text"), labels)
    return toxicity.drop_toxic(docs, model)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.quality_filter(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus; n_chars follows."""
    deduped = lines.dedup_lines(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.when(
        F.col("removed_lines") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return deduped.select(*[changed[c].alias(c) if c in changed else deduped[c] for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without words all stay."""
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), similarity=SIMILARITY)
    dropped = groups.where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences with the mixture of the sources."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", one_of_near_duplicates),
    ("packing", packed),
]

#: Stages 1 and 5 cannot be expressed in SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
