"""Directory trees as a Spark data source, and the union of two of them.

The built-in binaryFile reader leaves out empty and hidden files, which are files here. A partition is a
share of some hundred folders of the upper levels, with all below them; problems come as rows with an `error`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinsift.functions.paths import base_name, casefold, extension
from kinsift.operators.groups import numbered

SCHEMA = "root string, path string, size long, mtime double, error string"


#: Folders that a tree is cut into, about, and levels that the driver lists for it.
SUBTREES, LEVELS = 256, 3


class Subtrees(InputPartition):
    """Folders that a task looks into: (folder, whether all below it belongs to the task)."""

    def __init__(self, root: str, folders: list[tuple[str, bool]]) -> None:
        super().__init__((root, folders))


def folders_in(folder: str) -> list[str]:
    try:
        return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
    except OSError:
        return []  # the walk reports it


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.path = options["root"], options["path"]

    def partitions(self) -> list[InputPartition]:
        above: list[str] = []
        below = [self.path]
        for _ in range(LEVELS):
            if not below or len(below) >= SUBTREES:
                break
            above += below
            below = [x for folder in below for x in folders_in(folder)]
        jobs = [(x, False) for x in above] + [(x, True) for x in below]
        n = min(len(jobs), SUBTREES)
        return [Subtrees(self.root, jobs[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, folders = partition.value
        for folder, deep in folders:
            yield from self.walk(root, folder, deep)

    def walk(self, root: str, folder: str, deep: bool) -> Iterator[tuple]:
        problems: list[OSError] = []
        for here, below, names in os.walk(folder, onerror=problems.append):
            if not deep:
                below.clear()
            for name in names:
                path = os.path.join(here, name)
                try:
                    info = os.stat(path)
                except OSError as error:
                    yield root, path, None, None, f"no facts of {path}: {error}"
                    continue
                if os.path.isfile(path):
                    yield root, path, info.st_size, info.st_mtime, None
        for error in problems:
            yield root, error.filename or folder, None, None, f"can't look into {error.filename or ''}: {error}"


class FileTree(DataSource):
    """Options: path, a folder; root, its label."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def normal_root(root: str) -> str:
    return os.path.abspath(os.path.expandvars(os.path.expanduser(root)))


def read_tree(spark: SparkSession, path: str, label: str) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("root", label).option("path", path).load()


def union_roots(found: DataFrame, roots: list[str], case_insensitive: bool = False) -> DataFrame:
    """One row for each path of rows (root, path, size, mtime), with its roots; the first root's spelling and facts stand.

    Adds id (a path's place in the order of first root and path), name, extension, path_cf and name_cf.
    Where a path key is in several roots, all of them are in `roots`.
    """
    rank = F.coalesce(*(F.when(F.col("root") == r, F.lit(i)) for i, r in enumerate(roots)), F.lit(len(roots)))
    key = F.lower("path") if case_insensitive else F.col("path")
    first = F.min_by(F.struct("path", "size", "mtime"), F.struct("_rank", "path"))
    merged = found.withColumn("_rank", rank).groupBy(key.alias("path_key")).agg(first.alias("f"), F.min("_rank").alias("_rank"), F.array_sort(F.collect_set("root")).alias("roots"))
    rows = merged.select("f.*", "roots", "_rank").withColumn("path_cf", casefold(F.col("path")))
    rows = rows.withColumn("name_cf", base_name(F.col("path_cf"))).withColumn("extension", extension(F.col("name_cf")))
    rows = numbered(rows, [F.asc("_rank"), F.asc("path")], "id").withColumn("id", F.col("id").cast("long") - 1)
    return rows.select("id", "path", "path_cf", "name_cf", "roots", "size", "mtime", "extension")


def write_tree(rows: DataFrame, top: str) -> DataFrame:
    """(path, size) of the files that rows (path, content, mtime) become below the folder top, which all executors reach.

    path is relative; a null content makes a link that leads nowhere. A file appears whole or not at all, so
    a task may run twice. Nothing is written before the result is computed.
    """

    def put(path: str, content: bytes | None, mtime: float) -> tuple[str, int | None]:
        full = os.path.join(top, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        part = f"{full}.{uuid.uuid4().hex}"
        if content is None:
            os.symlink(f"{full}.nowhere", part)
        else:
            with open(part, "wb") as file:
                file.write(content)
            os.utime(part, (mtime, mtime))
        os.replace(part, full)
        return path, None if content is None else len(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [put(*x) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64()))], ["path", "size"])

    return rows.select("path", "content", F.col("mtime").cast("double")).mapInArrow(run, "path string, size long")
