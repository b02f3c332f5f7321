"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own_dirs: dict[str, str] = {}
_removed_at_end: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all tasks are on this machine, as in tests, is a temporary folder
    taken, one an application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors share no folder")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="packrel-")
        found = _own_dirs[app]
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    own = f"{shared_dir(spark)}/packrel/{app}"
    if own not in _removed_at_end:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(own)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _removed_at_end.add(own)
    return own


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor makes Spark read the files again instead of
    computing what led to them.  An application's files are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """The frame with names of our own, the new name of each column, and what gives the old ones back.

    Whatever the caller's columns are called, they can't clash with ours.
    """
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names, [F.col(n).alias(c) for c, n in names.items()]


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle whose number isn't left to adaptive planning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lanes(spark: SparkSession) -> int:
    """How many ways a hot key is split; follows the number of shuffle partitions."""
    return max(64, 4 * partitions(spark))


def spread_join(rows: DataFrame, key: str, found: DataFrame, lane: Column) -> DataFrame:
    """Left join on one key, any of whose values may hold a third of all rows.

    The table is first joined to the distinct (key, lane) pairs of the rows, then the rows
    to that on both columns, so that a hot key's rows meet the table in many tasks.
    ``found`` has one row a key.
    """
    laned = rows.withColumn("__lane", lane)
    pairs = laned.select(key, "__lane").distinct().join(found, key)
    return laned.join(pairs, [key, "__lane"], "left").drop("__lane")
