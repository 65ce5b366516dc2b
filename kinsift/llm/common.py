"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinsift.session import trim

#: A word is a run of characters other than the six ASCII white-space characters. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, as a native expression; 0 for null.

    Counts the starts of words: everything but the white space becomes one letter, and each run of it
    leaves its first one.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for measuring: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def beside(keep: list[str], own: list[str]) -> list[str]:
    """The columns of `keep` that come along beside an operator's own; one with the name of an own column gives way to it."""
    taken = {name.lower() for name in own}
    return [c for c in keep if c.lower() not in taken]


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes at the most, or one row; at a task's end the worker gives unused memory back."""
    for batch in batches:
        n = batch.num_rows
        step = n if batch.nbytes <= most else max(1, int(n * most / batch.nbytes))
        for i in range(0, n, step):
            yield batch.slice(i, step)
    del batches
    trim()
