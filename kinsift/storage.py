"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing Parquet there and reading it back: the files outlive any executor, the plan
of the reader starts at a scan, and each table is computed once. The folder is the one the cluster
names in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, one is made.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How tables get to a local folder: without checksum files and the processes that set their modes (chmod, where Hadoop has no
#: native library). While the executor's JVM starts a process, a second one shows that has all of its memory.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_own: list[str] = []
_seen: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, as a path or URI that Spark can write to.

    On one machine it is deleted when Python ends; on a cluster call clean_up(), or let the cluster's
    own rule for that folder do it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        if not _own:
            os.makedirs("/tmp/checkpoints", exist_ok=True)
            _own.append(tempfile.mkdtemp(prefix="kinsift-", dir="/tmp/checkpoints"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    path = f"{base.rstrip('/')}/kinsift-{spark.sparkContext.applicationId}"
    if path not in _seen and spark.sparkContext.master.startswith("local[") and local_path(path):
        _seen.add(path)
        atexit.register(shutil.rmtree, local_path(path), ignore_errors=True)
    return path


def local_path(path: str) -> str | None:
    """The path within the local file system, or None for other stores."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write df once and return a reader of what was written, with df's schema. compression: a codec other than the session's."""
    path = new_path(df.sparkSession, name)
    df.write.options(**(_RAW if local_path(path) else {})).parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinsift_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "_kinsift_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that this application has written to the shared folder. What still reads one fails afterwards."""
    remove(spark, shared_dir(spark))
