"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings that change results, so they are always set.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Duplicate JSON keys: the last one wins, as in JavaScript.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Runtime settings that only change speed.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sketch aggregates stay hash based for more groups per task before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else created."""
    for key, value in {**REQUIRED_CONF, **TUNING_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "gradelake", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        # Otherwise every Column call records its Python call site, which is slow
        # for scoring expressions. Static, so only a new session can set it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**REQUIRED_CONF, **TUNING_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary folder stands in only in local mode, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is not None:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="gradelake-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    Reliable: a lost executor does not bring the computation back.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
