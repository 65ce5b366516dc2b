"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 values (seed 42) of the
text's three-word shingles. Fingerprints with at most three differing bits are linked; a class is what
links connect.

The join walks a binary trie of the distinct fingerprints against itself. A step takes a pair of nodes
of equal depth whose prefixes differ in `err` bits and goes on with the pairs of their children, one
more error where the children's bits differ; a pair whose errors exceed the budget is pruned with all
that lies below it. The trie is never stored: in a sorted array a node is a range, and the place where
it splits comes from a running count of ones. Pairs of one depth are walked together as numpy arrays.

Over a cluster the walk is cut by the pigeonhole rule: three errors can't touch all four 16-bit blocks,
so for one of four rotations the first 16 levels of the trie hold no error at all, and there only pairs
of equal nodes are walked. Each (rotation, first block) is one subtree and one group of the shuffle;
every fingerprint is sent four times, whatever the number of rows. A subtree with more than `SPLIT`
fingerprints is cut again, at the node pairs 6 levels further down that are within the budget.

Copies of a text have one fingerprint and are one leaf, so their number doesn't matter here. What a
task returns are the links of a spanning forest of what it found: as many as fingerprints, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinsift.llm.common import pieces, read, texts
from kinsift.operators.components import connected_components
from kinsift.storage import materialize

SHINGLE, SEED, BITS, BUDGET, BLOCK = 3, 42, 64, 3, 16
#: Fingerprints of a subtree that one task walks whole; larger subtrees are cut at the node pairs `DEEPER` levels below.
SPLIT, DEEPER = 100_000, 6
#: Node pairs walked at once; pairs of nodes with at most so many combinations are compared directly.
FRONTIER, LEAF = 1 << 20, 32

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a text; of no words (null, empty): 0."""
    words = (text or b"").lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    if len(words) < SHINGLE:
        return _hash(b" ".join(words))
    n = len(words) - SHINGLE + 1
    counts = np.zeros(BITS, np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter(map(_hash, shingles), np.uint64, n)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values = np.fromiter(map(fingerprint, texts(batch.column(1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text, as a signed long. row: a long that comes with it."""
    named = [] if row is None else [row.cast("long").alias("row")]
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *named)
    return narrow.mapInArrow(_fingerprints, "id long, fp long" + (", row long" if named else ""))


class Forest:
    """Labels of an array's elements: the smallest index that links connect."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def _pairs(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each pair of small ranges."""
    wide = bh - bl
    n = (ah - al) * wide
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return al[which] + k // wide[which], bl[which] + k % wide[which]


def walk(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int, forest: Forest, across: np.ndarray | None = None) -> None:
    """Link in `forest` what is within `budget` bits in the subtrees [lo, hi) of the sorted array `keys`.

    Subtrees fill the array one after another. Elements of one are distinct and share their first `depth` bits. across: instead, where it is
    not negative, the subtree is [lo, across) and is walked against [across, hi) only.
    """
    if not len(lo):
        return
    if across is None:
        across = np.full(len(lo), -1)
    own = across < 0
    near = np.arange(len(keys) - 1)
    near = near[np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget]
    edge = np.zeros(len(keys) + 1, bool)
    edge[lo] = edge[hi] = True
    near = near[~edge[near + 1]]
    if not own.all():  # neighbours are linked only in subtrees that are walked whole
        near = near[own[np.searchsorted(lo, near, side="right") - 1]]
    forest.link(near, near + 1)
    start = (np.where(own, lo, lo), np.where(own, hi, across), np.where(own, lo, across), hi)
    stack = [(depth, *(x.astype(np.int64) for x in start), np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            for i in range(0, len(al), FRONTIER):
                stack.append((depth, *(x[i : i + FRONTIER] for x in (al, ah, bl, bh, err))))
            continue
        # What links have connected already needs no more of them.
        changes = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
        same = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (forest.label[al] == forest.label[bl])
        small = ~same & ((ah - al) * (bh - bl) <= LEAF)
        if small.any():
            i, j = _pairs(al[small], ah[small], bl[small], bh[small])
            found = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            forest.link(i[found], j[found])
        left = ~same & ~small
        if not left.any():
            continue
        al, ah, bl, bh, err = (x[left] for x in (al, ah, bl, bh, err))
        if depth not in ones:
            bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[depth]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])  # where the ones begin
        twin = al == bl
        apart = ~twin
        parts = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + np.int8(1)),
            tuple(x[apart] for x in (am, ah, bl, bm, err + np.int8(1))),
        ]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts))
        keep = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al < 2))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in (al, ah, bl, bh, err))))


def _rotated(fp: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    by = (rotation.astype(np.uint64) * np.uint64(BLOCK)) % np.uint64(BITS)
    return np.where(by == 0, fp, (fp << by) | (fp >> (np.uint64(BITS) - np.maximum(by, np.uint64(1)))))


def _links(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Links of a partition's subtrees, which come one after another: rotation, block, node pair (-1: none), fp."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        rotation, block, lower, upper = rows[:4]
        fp = rows[4].view(np.uint64)
        keys = _rotated(fp, rotation)
        order = np.lexsort((keys, upper, lower, block, rotation))
        rotation, block, lower, upper, fp, keys = (x[order] for x in (rotation, block, lower, upper, fp, keys))
        new = np.ones(len(fp), bool)
        new[1:] = (np.diff(rotation) != 0) | (np.diff(block) != 0) | (np.diff(lower) != 0) | (np.diff(upper) != 0)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(fp))
        across = np.full(len(lo), -1)
        sub = (keys >> np.uint64(BITS - BLOCK - DEEPER)) & np.uint64((1 << DEEPER) - 1)
        for g in np.flatnonzero(lower[lo] != upper[lo]):
            across[g] = lo[g] + np.searchsorted(sub[lo[g] : hi[g]], upper[lo[g]].astype(np.uint64))
        full = (across < 0) | ((across > lo) & (across < hi))
        # The rows of subtrees with one side only go: what is left are the subtrees that are walked, end to end.
        size = hi - lo
        stays = np.repeat(full, size)
        keys, fp = keys[stays], fp[stays]
        hi = np.cumsum(size[full])
        shift = lo[full] - (hi - size[full])
        lo, across = lo[full] - shift, np.where(across[full] < 0, -1, across[full] - shift)
        forest = Forest(len(fp))
        walk(keys, lo, hi, BLOCK, BUDGET, forest, across)
        tied = np.flatnonzero(forest.label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (tied, forest.label[tied])], ["src", "dst"])

    for batch in batches:
        held.append(np.stack([np.asarray(x).astype(np.int64) for x in batch.columns]))
        if sum(x.shape[1] for x in held) >= most:
            rows = np.concatenate(held, axis=1)
            last = (rows[:4] == rows[:4, -1:]).all(axis=0)  # the last subtree may go on
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield flush(rows[:, :cut])
            held = [rows[:, cut:]]
    if held:
        rows = np.concatenate(held, axis=1)
        if rows.shape[1]:
            yield flush(rows)


def links(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """(src, dst): pairs of fingerprints of the column `fp` (distinct) within the budget, which connect all that such pairs connect."""
    rotation = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.expr(f"shiftrightunsigned(fp, {(48 - BLOCK * r) % 64}) & 65535").alias("block")) for r in range(BITS // BLOCK))))
    rows = distinct.select("fp", rotation.alias("k")).select("fp", "k.r", "k.block")
    large = rows.groupBy("r", "block").agg(F.count("*").alias("n")).where(F.col("n") > split)
    rows = rows.join(large, ["r", "block"], "left")
    # The bits after the first block in this rotation: those of the next block's upper end.
    nxt = F.expr(f"shiftrightunsigned(fp, CAST((64 + 48 - {BLOCK} * ((r + 1) % 4)) % 64 AS INT) + {BLOCK - DEEPER}) & {(1 << DEEPER) - 1}").cast("int")
    masks = [m for m in range(1 << DEEPER) if m.bit_count() <= BUDGET]
    other = F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.least(F.col("nxt"), F.col("nxt").bitwiseXOR(m)).alias("lower"), F.greatest(F.col("nxt"), F.col("nxt").bitwiseXOR(m)).alias("upper")))
    whole = F.array(F.struct(F.lit(-1).alias("lower"), F.lit(-1).alias("upper")))
    rows = rows.withColumn("nxt", nxt).select("r", "block", F.explode(F.when(F.col("n").isNull(), whole).otherwise(other)).alias("p"), "fp")
    rows = rows.select(F.col("r").cast("long"), F.col("block").cast("long"), F.col("p.lower").cast("long").alias("lower"), F.col("p.upper").cast("long").alias("upper"), "fp")
    keys = ["r", "block", "lower", "upper"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links, "src long, dst long")


def classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id, keeper) of the fingerprints of rows (id, fp): the class's smallest id, and whether it is in this fingerprint.

    Of fingerprints that share a class's smallest id, the smallest is the keeper's.
    """
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    joined = connected_components(links(distinct.select("fp")))
    named = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    first = F.min_by(F.struct("least", "fp"), F.struct(F.col("least").isNull(), "least", "fp"))
    names = named.groupBy("c").agg(first.alias("first"))
    return named.join(names, "c").select("fp", F.col("first.least").alias("component_id"), (F.col("fp") == F.col("first.fp")).alias("keeper"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for every row of docs.

    component_id is the smallest id of the rows whose fingerprints links connect with this row's. Texts
    without words, null ones included, have fingerprint 0 and are linked like any other. A row with a
    null id gets its class too and gives no class its name; a class of such rows only has the name null.
    Repeated rows and repeated ids keep their rows. An empty table gives an empty result. Other columns
    of docs are not looked at.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    found = classes(rows).select(F.col("fp").alias("f"), "component_id")
    return rows.join(found, rows.fp == found.f).select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id; of several with this id, one of them.

    Null texts and texts without words are one class; a class of rows with null ids only keeps one row, and
    other classes none of theirs. Repeated rows stay once. An empty table gives an empty result. Columns may
    have any names.
    """
    key = F.xxhash64(F.struct("*"))  # rows that share it and the id are taken for equal
    rows = materialize(fingerprints(docs, id_col, text_col, key), "fingerprints")
    keepers = classes(rows).where("keeper").select(F.col("fp").alias("k"), "component_id")
    chosen = rows.join(keepers, (F.col("fp") == F.col("k")) & F.col("id").eqNullSafe(F.col("component_id")), "left_semi")
    chosen = chosen.groupBy("fp", "id").agg(F.min("row").alias("chosen")).select(F.col("id").alias("keeper"), "chosen")
    kept = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), key.alias("key"))
    kept = kept.join(chosen, (F.col("key") == F.col("chosen")) & F.col("id").eqNullSafe(F.col("keeper")), "left_semi")
    nth = F.row_number().over(W.partitionBy("key", "id").orderBy("key"))  # equal rows: any of them
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
