"""Small helpers the text operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Recent:
    """A bounded memory of two dictionaries: the older one goes when the newer is full."""

    def __init__(self, most: int) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.most = most

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    In a text of ASCII alone ``lower`` does the same, and faster.
    """
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.length(whole)
    return F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, as where it is not installed."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    given = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in given:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*given, here]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new folder in the shared folder and read it back.

    Cuts lineage: a lost executor does not bring the computation back, and every
    later use reads the same rows. The folder belongs to the cluster's checkpoint
    space and is cleared with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
