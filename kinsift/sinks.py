"""Deleting what a review marked. Nothing here runs unless it is called for by name.

The default is to write the list. Permanent deletion and moving to a quarantine folder (which stands in
for a recycle bin) work on paths that the executors can reach, and report every path.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, status string, error string"
MISSING = "there is no such file"


def write_manifest(plan: DataFrame, path: str) -> None:
    plan.select("path").write.parquet(path)


def remove(path: str) -> tuple[str, str, str | None]:
    if not os.path.exists(path):
        return path, "error", MISSING
    try:
        os.remove(path)
    except OSError as error:
        return path, "error", str(error)
    return path, "deleted", None


def quarantine(path: str, folder: str) -> tuple[str, str, str | None]:
    """Moved below folder, under its whole path."""
    if not os.path.exists(path):
        return path, "error", MISSING
    target = os.path.join(folder, os.path.abspath(path).lstrip(os.sep))
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.move(path, target)
    except OSError as error:
        return path, "error", str(error)
    return path, "deleted", None


def delete_files(plan: DataFrame, recycle_to: str | None = None, permanent: bool = False) -> DataFrame:
    """(path, status, error) for the plan's distinct paths, which are gone when the result is computed.

    Either recycle_to names a quarantine folder, or permanent is true. A task that runs twice finds its
    files gone and reports them as missing: write the result once, and don't compute it again.
    """
    if bool(recycle_to) == permanent:
        raise ValueError("say where deleted files go, or that they go for good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [remove(p) if permanent else quarantine(p, recycle_to) for p in batch.column(0).to_pylist()]
            columns = list(zip(*done)) if done else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["path", "status", "error"])

    return plan.select("path").distinct().mapInArrow(run, SCHEMA)
