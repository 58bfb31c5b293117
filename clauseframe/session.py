"""The session that the engine's operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; ``conf`` comes on top. The master is the cluster's unless given."""
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over four tasks for each core, before a small row becomes much work.

    A file of keys alone is a few MB, so it would be read by one or two tasks whatever is made of each key. What is made of it is not told
    by the file's size either, so joins above it carry a ``merge`` hint; else Spark may send millions of rows through the driver.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Where frames are settled on a local master whose session names no folder.
OWN_FOLDER = "/tmp/clauseframe-checkpoints"


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the folder that ``spark.checkpoint.dir`` names, for a plan that reads it many times.

    The plan above it stays small, and a lost executor costs nothing of it. On a local master the folder may be unset.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or OWN_FOLDER)
    return df.checkpoint()
