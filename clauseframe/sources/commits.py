"""Snapshots of a table with atomic commits: a commit is one manifest file, named by its version, that tells where the data is.

Data is written first, under a name of its own, and nobody reads it. Then the manifest, whole, takes the name of version n + 1 in
one step, which fails if there is one; so of two writers that both saw version n one is refused, and no reader sees half a change.
Through Hadoop's file systems the step is a rename, which must not replace a file (HDFS does not); on a local disk it is a link.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class Refused(Exception):
    """Somebody has committed since the version that the writer saw."""


def _files(spark: SparkSession, where: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _manifest(where: str, version: int) -> str:
    return f"{where}/_versions/{version:020d}.json"


def current(spark: SparkSession, where: str) -> int:
    """The last committed version, 0 before the first."""
    fs, folder = _files(spark, f"{where}/_versions")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def read(spark: SparkSession, where: str, version: int | None = None) -> DataFrame:
    """The table at ``version``, or as last committed."""
    version = current(spark, where) if version is None else version
    fs, path = _files(spark, _manifest(where, version))
    stream = fs.open(path)
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return spark.read.schema(told["schema"]).parquet(f"{where}/{told['data']}")


def _taken(fs, whole, path) -> bool:  # noqa: ANN001
    """Gives the file ``whole`` the name ``path``, unless that is taken."""
    try:
        if fs.getScheme() == "file":
            os.link(whole.toUri().getPath(), path.toUri().getPath())
            return True
        return not fs.exists(path) and fs.rename(whole, path)
    except FileExistsError:
        return False
    finally:
        fs.delete(whole, False)


def commit(df: DataFrame, where: str, expected: int) -> int:
    """Makes ``df`` the version after ``expected`` and returns its number; ``Refused`` if that exists. What a refused writer wrote is never
    read. A commit holds all rows of the table: changes are made on a frame that ``read`` gave."""
    spark, data = df.sparkSession, f"data/{uuid.uuid4().hex}"
    if current(spark, where) != expected:
        raise Refused(f"version {current(spark, where)} is there, {expected} was expected")
    df.write.parquet(f"{where}/{data}")
    fs, path = _files(spark, _manifest(where, expected + 1))
    fs.mkdirs(path.getParent())
    said = json.dumps({"data": data, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}).encode()
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_versions/_{uuid.uuid4().hex}")
    out = fs.create(whole, False)
    out.write(said)
    out.close()
    if not _taken(fs, whole, path):
        raise Refused(f"version {expected + 1} was committed meanwhile")
    return expected + 1
