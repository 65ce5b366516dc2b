"""The driver's tables seen as files, pictures and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.functions import measures as M
from kinsift.functions.paths import base_name, extension
from kinsift.sources.content import histogram


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_files(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Documents as files: A holds the even ids and B the odd ones; names end like copies in three of five cases. Paths are ASCII, so lower() folds them."""
    suffix = F.element_at(F.array(*map(F.lit, (" (1)", "-02", " copy", "", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("d"), (F.col("doc_id") % 97).cast("string"), suffix, F.lit(".txt"))
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), name)
    out = docs.select(
        F.col("doc_id").alias("id"),
        path.alias("path"),
        F.array(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B")).alias("roots"),
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") % 1000).cast("double").alias("mtime"),
        *(["text", "n_chars"] if with_text else []),
    )
    return out.withColumns({"path_cf": F.lower("path"), "name_cf": F.lower(base_name(F.col("path"))), "extension": extension(F.lower(base_name(F.col("path"))))})


def hashed_documents(docs: DataFrame) -> DataFrame:
    """document_files with exact_hash, of those alone whose size another one has. Texts aren't shuffled: their hashes are made where they are read."""
    files = document_files(docs, with_text=True).withColumn("_h", F.sha2(F.col("text").cast("binary"), 256)).drop("text", "n_chars")
    common = files.groupBy("size").agg(F.count("*").alias("_n")).where("_n > 1").select((F.col("size") + F.lit(0)).alias("_s"), "_n")
    rows = files.join(common, F.col("size") == F.col("_s"), "left")
    return rows.withColumn("exact_hash", F.when(F.col("_n").isNotNull(), F.col("_h"))).drop("_h", "_s", "_n")


def document_prints(docs: DataFrame) -> DataFrame:
    """Documents as pictures: as wide as they have lines; the histogram of characters is the thumbnail, and what its neighbours differ in the hash (63 bits)."""
    rows = docs.select(
        F.col("doc_id").alias("id"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("width"),
        F.length("lang").cast("int").alias("height"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        F.col("n_chars").cast("double").alias("duration"),
        histogram(F.col("text")).alias("thumbnail"),
    )
    return rows.withColumn("dhash", M.dhash(F.col("thumbnail"), 64, 1))


def document_videos(docs: DataFrame, frames: int) -> DataFrame:
    """Documents as videos: as long as their characters; a frame is the histogram of 200 characters from each sampled position on."""
    ratios = M.sample_ratios(frames)
    cuts = [F.substring("text", (F.floor(F.col("n_chars") * r) + 1).cast("int"), F.lit(200)) for r in ratios]
    rows = docs.select(
        F.col("doc_id").alias("id"), F.length("lang").alias("width"), F.lit(1).alias("height"), F.col("n_chars").cast("double").alias("duration"),
        *(histogram(c).alias(f"_h{i}") for i, c in enumerate(cuts)),
    )
    hashes = F.array(*(M.dhash(F.col(f"_h{i}"), 64, 1) for i in range(len(cuts))))
    return rows.select("id", "width", "height", "duration", hashes.alias("frame_hashes"))
