"""Groups of duplicates: components of edges, what they are called, and their numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinsift.functions.paths import root_label
from kinsift.operators.components import connected_components
from kinsift.storage import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 1, 2, ... in the given order, without ordering all rows in one task. Rows that tie get neighbouring numbers, in any order."""
    placed = materialize(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task of the sort
    offsets = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_nth", nth).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before")


def members_of(files: DataFrame, labels: DataFrame) -> DataFrame:
    """files that are in a component, with it."""
    return files.join(labels, files["id"] == labels["node"]).drop("node")  # one row on either side for each id


def evidence(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, reasons, score): the reasons of a component's edges in order, and its lowest score."""
    named = edges.join(labels, edges["src"] == labels["node"])
    return named.groupBy("component").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.min("score").alias("score"))


def group_hashes(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, group_hash): a key of each group's content: kind, score, reasons and its members in order.

    A digest has to see a group's members one after another; they pass through a task in order and are
    never held together.
    """
    head = groups.select("group_id", "kind", "score", F.array_join("reasons", ",").alias("reasons"))
    record = F.concat_ws("\0", F.lit("record"), "path_cf", root_label(F.col("roots")), F.col("size").cast("string"), F.coalesce("exact_hash", F.lit("")))
    rows = members.select("group_id", "pos", record.alias("record")).join(head, "group_id")
    # By group_id itself the join's own exchange would serve, which adaptive execution may split or read where it lies.
    rows = rows.select("group_id", "pos", "kind", "score", "reasons", "record").repartition(F.xxhash64("group_id")).sortWithinPartitions("group_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for group, kind, score, reasons, record in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if group != now:
                    if digest:
                        done.append((now, digest.hexdigest()[:12]))
                    parts = ["kind", kind, "score", str(score), *(x for r in reasons.split(",") for x in ("reason", r)), ""]
                    now, digest = group, hashlib.sha256("\0".join(parts).encode())
                digest.update(f"{record}\0".encode())
            yield _hash_batch(done)
        if digest:
            yield _hash_batch([(now, digest.hexdigest()[:12])])

    return rows.mapInArrow(run, "group_id long, group_hash string")


def _hash_batch(done: list[tuple[int, str]]) -> pa.RecordBatch:
    ids, keys = zip(*done) if done else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["group_id", "group_hash"])


def build_groups(files: DataFrame, edges: DataFrame, labels: DataFrame | None = None, with_hash: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of files (id, path, path_cf, roots, size, exact_hash, ...) and edges (src, dst, reason, score).

    members: a row of files for each member, with group_id and pos. groups: group_id, kind, score, reasons,
    n_members, n_bytes, first_path_cf and, with_hash, group_hash. Members come in order of path_cf, groups
    in order of falling size, kind and first path. A component of one file is no group. labels: the
    components (node, component), where they are known.

    A group may hold any share of the files: sizes and first paths are combined on the map side, and places
    come from one sort of all members, of which a group is a stretch.
    """
    if labels is None:
        edges = materialize(edges, "edges")
        labels = materialize(connected_components(edges), "labels")
    held = members_of(files, labels)
    sums = held.groupBy("component").agg(F.count("*").alias("n_members"), F.sum("size").alias("n_bytes"), F.min("path_cf").alias("first_path_cf"))
    groups = sums.where("n_members > 1").join(evidence(edges, labels), "component").withColumn("kind", F.array_join("reasons", "+"))
    groups = numbered(groups, [F.desc("n_members"), F.asc("kind"), F.asc("first_path_cf"), F.asc("component")], "group_id")
    named = groups.select((F.col("component") + F.lit(0)).alias("_c"), "group_id")
    members = held.join(named, held["component"] == named["_c"]).drop("_c", "component")
    members = numbered(members, [F.asc("group_id"), F.asc("path_cf"), F.asc("id")], "_place")
    starts = members.groupBy("group_id").agg(F.min("_place").alias("_first"))
    starts = starts.select((F.col("group_id") + F.lit(0)).alias("_g"), "_first")
    members = members.join(starts, members["group_id"] == starts["_g"]).withColumn("pos", F.col("_place") - F.col("_first") + 1).drop("_place", "_first", "_g")
    groups = groups.drop("component")
    if with_hash:
        groups = groups.join(materialize(group_hashes(members, groups), "hashes"), "group_id")
    return members, groups


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_scanned"))
