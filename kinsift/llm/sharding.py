"""Shards by vector bin packing.

Bytes, tokens and rows are balanced jointly: an item is a vector of its shares of the three, a shard's
residual capacity is a vector too, and items are placed, largest first, where the dot product of the
two is highest among the shards that still have room for the item's bytes (where none has: the one with
the most room). Rows with equal texts are one group and one item, so that copies never sit in two shards,
up to a group that would fill a shard, which is cut into pieces.

Packing looks at every group in turn, whatever their number. Groups of more than 1/1024 of a shard are
packed first, on the driver; there are at most 1024 of them per shard, and their pieces. What room they
leave is shared out: the lighter groups fall by their hash into parts of about `PART_GROUPS`, and a part
has the share of every shard's room that it has of all lighter groups' bytes, tokens and rows. Tasks pack
their parts one by one against these shares, so the driver sees neither groups nor parts. Sums are made
before any shuffle; texts are never shuffled, rows of six numbers are joined to their groups' shards.

The law that holds is `bytes`: the shards' sizes are near equal. Slots number a shard's rows without a
gap. They are counted in parts of a shard, whose offsets are running sums, so that no task orders a
whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinsift.llm.common import read, trim, word_count
from kinsift.storage import discard, materialize

#: Groups of over 1/GRAIN of a shard are packed before all others.
GRAIN = 1024
#: Lighter groups that one task packs together, about.
PART_GROUPS = 50_000
#: A group of over this share of a shard is cut into pieces.
WHOLE = 0.9
#: Rows of a part of a shard that one task numbers.
PART_ROWS = 50_000
#: Bytes that a row has besides its text.
ROW_BYTES = 16


def place(share: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shard of every item, taken in the given order; room, of the same unit, is what shards have left and is used up."""
    out = np.zeros(len(share), np.int64)
    for i in order.tolist():
        item = share[i]
        score = np.where(room[:, 0] >= item[0], room @ item, -np.inf)
        best = int(score.argmax())
        if score[best] == -np.inf:
            best = int(room[:, 0].argmax())
        room[best] -= item
        out[i] = best
    return out


def shares(items: np.ndarray, total: np.ndarray, shards: int) -> np.ndarray:
    """Items in units of a shard's capacity, which is 1 in each dimension."""
    return items / np.where(total > 0, total, 1) * shards


def largest_first(share: np.ndarray) -> np.ndarray:
    return np.lexsort((np.arange(len(share)), -share.max(axis=1, initial=0)))


def part_room(room: np.ndarray, own: np.ndarray, light: np.ndarray) -> np.ndarray:
    """A part's share of every shard's room, if its items sum up to `own` and those of all parts to `light`."""
    return room * np.where(light > 0, own / np.where(light > 0, light, 1), 0)


def sized(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """(id, size, tokens, text_crc32, k1, k2): all that packing needs of a row; k1 and k2 name its text. row: what comes along."""
    text = F.col(text_col)
    return docs.select(
        *([] if row is None else [row.alias("row")]),
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text).alias("k2"),
    )


def _pack_parts(shards: int, total: np.ndarray, light: np.ndarray, room: np.ndarray):
    """The shard of every group of a task's parts, which come one after another. In: part, k1, k2, bytes, tokens, rows."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        part, k1, k2 = (table.column(k).to_numpy() for k in range(3))
        share = shares(np.stack([table.column(k).to_numpy() for k in range(3, 6)], axis=1).astype(float), total, shards)
        by = np.lexsort((k2, k1))  # the order in which rows come is not the same in every run
        by = by[largest_first(share[by])]
        own_room = part_room(room, share.sum(axis=0), light)
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(place(share, own_room, by).astype(np.int32))], ["g1", "g2", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != part[a]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(pa.Table.from_batches(held))
        trim()

    return run


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", part_groups: int = PART_GROUPS, row: Column | None = None) -> DataFrame:
    """(id_col, size, tokens, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    Null texts have no bytes and are equal to each other but not to the empty text; their crc32 is that
    of no bytes. Null and repeated ids are rows like any other. An empty table gives an empty result.
    Only the two named columns are looked at. row: a struct that comes along as `row`.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, id_col, text_col, row), "sized")
    others = [] if row is None else ["row"]
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = materialize(rows.groupBy("k1", "k2").agg(*sums), "groups")
    facts = groups.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens", "rows"))).first()
    n_groups, total = facts[0], np.array(facts[1:], float)
    least, whole = total[0] / (shards * GRAIN), total[0] / shards * WHOLE
    cut = F.when(F.col("bytes") > whole, F.ceil(F.col("bytes") / F.lit(max(whole, 1.0) / 4))).otherwise(1).cast("int")
    heavy = groups.where(F.col("bytes") > F.lit(least))  # at most shards * GRAIN rows, by its threshold
    heavy = F.broadcast(materialize(heavy.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), cut.alias("cut")), "heavy"))
    keyed = rows.join(heavy, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left").drop("h1", "h2")
    keyed = keyed.withColumn("piece", F.pmod(F.xxhash64("id", "k1"), F.col("cut")).cast("int")).drop("cut")
    known = sorted(map(tuple, keyed.where("piece IS NOT NULL").groupBy("k1", "k2", "piece").agg(*sums).collect()))
    share = shares(np.array([x[3:] for x in known], float).reshape(-1, 3), total, shards)
    room = np.ones((shards, 3))
    shard = place(share, room, largest_first(share))
    plan = spark.createDataFrame([(*x[:3], int(k)) for x, k in zip(known, shard)], "g1 long, g2 long, g3 int, shard int")
    same = (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
    first = keyed.where("piece IS NOT NULL").join(F.broadcast(plan), same & (F.col("piece") == F.col("g3"))).drop("g1", "g2", "g3", "piece")

    parts = max(1, -(-n_groups // part_groups))
    lighter = groups.where(F.col("bytes") <= F.lit(least)).select(F.pmod(F.xxhash64("k1", "k2"), F.lit(parts)).alias("part"), "k1", "k2", "bytes", "tokens", "rows")
    packing = _pack_parts(shards, total, shards - share.sum(axis=0), room)
    placed = lighter.repartition("part").sortWithinPartitions("part").mapInArrow(packing, "g1 long, g2 long, shard int")
    rest = keyed.where("piece IS NULL").join(placed, same).drop("g1", "g2", "piece")
    out = materialize(_slots(first.unionByName(rest), int(total[2]), shards), "shards")
    for table in (rows, groups):
        discard(table)
    return out.select(F.col("id").alias(id_col), "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *others)


def _slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    part: Column = F.pmod(F.xxhash64("id", "text_crc32"), F.lit(max(1, -(-n // (shards * PART_ROWS))))).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    nth = F.row_number().over(W.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")) - 1
    return rows.withColumn("nth", nth).join(offsets, ["shard", "part"]).withColumn("slot", (F.col("offset") + F.col("nth")).cast("long"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a folder per shard below path (`shard=K`), rows in slot order, and return the assignment.

    The files hold a column `row` with all columns of docs, whatever their names, and `slot`. Every row is
    written, null and repeated ids and repeated rows too; an empty table writes no rows.
    """
    plan = assign_shards(docs, shards, id_col, text_col, row=F.struct("*"))
    out = plan.select("row", "slot", "shard").repartition("shard", (F.col("slot") / PART_ROWS).cast("long")).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    return plan.drop("row")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"), shards=40).drop("tokens")
