"""The whole scan: two trees to groups of duplicates."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.operators import edges as E
from kinsift.operators.groups import build_groups, scan_totals
from kinsift.operators.session import Session
from kinsift.options import ScanOptions
from kinsift.sources import content, filetree
from kinsift.storage import materialize

log = logging.getLogger("kinsift")

NO_PILLOW = "pictures are only compared byte by byte: Pillow is missing"
NO_FFMPEG = "videos are only compared byte by byte: there is no ffmpeg"


@dataclass
class ScanResult:
    files: DataFrame
    edges: DataFrame
    members: DataFrame
    groups: DataFrame
    warnings: DataFrame
    image_similarity_enabled: bool
    video_similarity_enabled: bool

    def totals(self) -> DataFrame:
        return scan_totals(self.files)

    def session(self, markers: tuple[str, ...]) -> Session:
        return Session(self.members, self.groups, markers)


def dealt(files: DataFrame, tasks: int | None) -> DataFrame:
    """files in at least one task, and in as many as are asked for: what opens files is slow, whatever their rows weigh."""
    return files if tasks is None else files.repartition(max(tasks, 1), "path")


def with_hashes(files: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """files with exact_hash, of those alone whose size another file has; and warnings of what couldn't be read."""
    hashes = materialize(content.content_hashes(dealt(E.same_size(files), tasks)), "hashes")
    hashed = files.join(hashes.select("id", "exact_hash"), "id", "left")
    bad = hashes.where("error IS NOT NULL").join(files.select("id", "path"), "id").select(F.lit("hash").alias("stage"), "path", F.concat(F.lit("no content of "), "path", F.lit(": "), "error").alias("message"))
    return hashed, bad


def scan_files(files: DataFrame, options: ScanOptions, warnings: DataFrame, progress: Callable[[str], None] | None = None) -> ScanResult:
    """files: as from union_roots()."""
    spark = files.sparkSession
    say = progress or log.info
    say("comparing contents")
    hashed, bad = with_hashes(files, options.hash_workers)
    hashed = materialize(hashed, "files")
    warnings = warnings.unionByName(bad)
    found = E.exact_edges(hashed)
    notes = []
    images = options.enable_image_similarity and content.has_pillow()
    if images:
        say("comparing pictures")
        prints = materialize(content.picture_prints(dealt(E.image_candidates(hashed, options), options.image_workers)), "pictures")
        found = found.unionByName(E.image_edges(prints, options.image_threshold))
    elif options.enable_image_similarity:
        notes.append(("image", None, NO_PILLOW))
    videos = options.enable_video_similarity and content.has_ffmpeg()
    if videos:
        say("comparing videos")
        known = dealt(E.video_candidates(hashed, options), options.video_workers)
        facts = materialize(content.video_metadata(known), "metadata").join(hashed.select("id", "path"), "id")
        few = materialize(content.video_frames(E.video_metadata_candidates(facts), min(2, options.video_sample_count)), "few_frames")
        left = E.video_frame_candidates(few, options).drop("frame_hashes")
        full = materialize(content.video_frames(left, options.video_sample_count), "frames")
        found = found.unionByName(E.video_edges(full, options))
    elif options.enable_video_similarity:
        notes.append(("video", None, NO_FFMPEG))
    if notes:
        warnings = warnings.unionByName(spark.createDataFrame(notes, "stage string, path string, message string"))
    edges = materialize(E.distinct_edges(found), "edges")
    members, groups = build_groups(hashed, edges)
    say("done")
    return ScanResult(hashed, edges, members, groups, warnings, images, videos)


def scan(spark: SparkSession, options: ScanOptions, progress: Callable[[str], None] | None = None) -> ScanResult:
    say = progress or log.info
    say("looking for files")
    roots = {"A": filetree.normal_root(options.root_a), "B": filetree.normal_root(options.root_b)}
    found, notes = spark.createDataFrame([], filetree.SCHEMA), []
    for label, path in roots.items():
        if os.path.isdir(path):
            say(f"folder {label} is {path}")
            found = found.unionByName(filetree.read_tree(spark, path, label))
        else:
            notes.append(("collect", path, f"folder {label} is missing or can't be read: {path}"))
    found = materialize(found, "found")
    problems = found.where("error IS NOT NULL").select(F.lit("collect").alias("stage"), "path", F.col("error").alias("message"))
    warnings = spark.createDataFrame(notes, "stage string, path string, message string").unionByName(problems)
    files = materialize(filetree.union_roots(found.where("error IS NULL"), list(roots), options.case_insensitive_paths), "collected")
    return scan_files(files, options, warnings, progress)
