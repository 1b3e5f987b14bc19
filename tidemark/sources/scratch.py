"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folders of this process below shared folders; what is left in them goes when it ends.
_OWN: set[str] = set()
_RUN = f"tidemark-{uuid.uuid4().hex[:12]}"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def path_and_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it is on."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    there, system = path_and_system(spark, path)
    system.delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    there, system = path_and_system(spark, path)
    return system.exists(there)


def rename(spark: SparkSession, path: str, to: str) -> None:
    there, system = path_and_system(spark, path)
    if not system.rename(there, path_and_system(spark, to)[0]):
        raise OSError(f"cannot rename {path} to {to}")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        delete(spark, path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the process ends, if not before."""
    own = f"{shared_root(spark)}/{_RUN}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_delete_at_exit, spark, own)
    return f"{own}/{uuid.uuid4().hex[:12]}/{name}"


#: Settings while a table is written. A query's shuffle files go when it ends: what is written is read back from the table,
#: so they serve no one. Batches for Python are of fewer rows than usual, since a row may be a whole document. Partitions are
#: merged up to the advised size, not only down to one for each core: small tables are few files.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def written(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    spread: the last step is work for all cores, even if that makes more files.
    """
    spark = df.sparkSession
    settings = WHILE_WRITING | ({"spark.sql.adaptive.coalescePartitions.parallelismFirst": "true"} if spread else {})
    path, before = shared_path(spark, name), {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete tables that written() made and that no result reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)
