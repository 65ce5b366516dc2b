import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm import mixing as M, sharding as S
from kinsift.llm.common import word_count

SCHEMA = "doc_id long, text string, source string, size int, shard string"


def test_word_count(spark):
    texts = [None, "", " \n", "a", " a  b\tc\x0bd\x0ce\r\n", "x y\x1cz", "é à"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len((t or "").encode().split()) for t in texts]


def test_place_balances_jointly():
    rng = np.random.default_rng(0)
    items = np.stack([rng.lognormal(5, 1, 5000), rng.lognormal(3, 1, 5000), np.ones(5000)], axis=1)
    share = S.shares(items, items.sum(axis=0), 16)
    shard = S.place(share, np.ones((16, 3)), S.largest_first(share))
    for k in range(3):
        load = np.bincount(shard, items[:, k], 16)
        assert load.max() / load.mean() < 1.03
    assert S.place(np.zeros((0, 3)), np.ones((4, 3)), np.zeros(0, int)).tolist() == []


def plainly_best(items, shard, room):
    """Every item, in order, lies where the dot product with what is left is highest, or where the most room is if it fits nowhere."""
    for item, own in zip(items, shard):
        fits = [k for k, r in enumerate(room) if r[0] >= item[0]]
        if fits:
            score = {k: sum(x * y for x, y in zip(room[k], item)) for k in fits}
            assert score[own] >= max(score.values()) - 1e-9
        else:
            assert room[own][0] >= max(r[0] for r in room) - 1e-9
        room[own] = [x - y for x, y in zip(room[own], item)]
    return room


@pytest.mark.parametrize("part_groups", (50_000, 120))
def test_every_group_lies_where_the_dot_product_is_highest(spark, medium, part_groups):
    shards = 3
    # Larger and smaller groups than 1/1024 of a shard, and one that would fill a shard.
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    tiny = spark.range(600).select((F.col("id") + 10**6).alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 500).cast("string")).alias("text"))
    docs = docs.unionByName(tiny)
    got = {r.doc_id: r.shard for r in S.assign_shards(docs, shards, part_groups=part_groups).collect()}
    k1, k2 = F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))
    rows = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"), F.xxhash64(k1, k2).alias("h")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.k1, r.k2].append(r)
    facts = {k: (sum(len(r.text.encode()) + 16 for r in g), sum(len(r.text.encode().split()) for r in g), len(g)) for k, g in groups.items()}
    total = [sum(f[d] for f in facts.values()) for d in range(3)]
    share = {k: tuple(f[d] / total[d] * shards for d in range(3)) for k, f in facts.items()}
    where = {k: {got[r.doc_id] for r in g} for k, g in groups.items()}
    assert all(len(x) == 1 for x in where.values()) and max(f[0] for f in facts.values()) < 0.9 * total[0] / shards
    heavy = sorted((k for k in facts if facts[k][0] > total[0] / (shards * 1024)), key=lambda k: (-max(share[k]), k))
    room = plainly_best([share[k] for k in heavy], [min(where[k]) for k in heavy], [[1.0] * 3 for _ in range(shards)])
    parts = -(-len(facts) // part_groups)
    light = [k for k in facts if facts[k][0] <= total[0] / (shards * 1024)]
    assert len(heavy) > 100 and len(light) > 300
    of = defaultdict(list)
    for k in light:
        of[groups[k][0].h % parts].append(k)
    left = [shards - sum(share[k][d] for k in heavy) for d in range(3)]
    for keys in of.values():
        keys.sort(key=lambda k: (-max(share[k]), k))
        own = [sum(share[k][d] for k in keys) / left[d] for d in range(3)]
        plainly_best([share[k] for k in keys], [min(where[k]) for k in keys], [[r[d] * own[d] for d in range(3)] for r in room])


def test_shards(spark, medium):
    rows = S.op4_sharding(spark, medium).toPandas()
    docs = spark.read.parquet(f"{medium}/documents.parquet").toPandas().set_index("doc_id").text
    assert sorted(rows.doc_id) == sorted(docs.index)
    assert all(r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows.itertuples(index=False))
    load = rows.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(40)) and load.max() / load.mean() < 1.05 and load.min() / load.mean() > 0.95
    for _, slots in rows.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    where = defaultdict(set)
    for r in rows.itertuples():
        where[docs[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()


def test_hot_group_is_cut(spark):
    rows = [(i, "same text over and over", "s", 1, "x") for i in range(400)] + [(1000 + i, f"text {i} " * (i % 7), "s", 1, "x") for i in range(800)]
    out = S.assign_shards(spark.createDataFrame(rows, SCHEMA), shards=4).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(out) == 1200 and load.max() / load.mean() < 1.1


def test_shards_of_odd_rows(spark):
    rows = [(1, None, "a", 1, "x"), (None, "", "a", 1, "x"), (2, "a", None, 1, "x"), (2, "a", None, 1, "x"), (3, "long " * 30000, "a", 1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = S.assign_shards(frame, shards=3).collect()
    assert len(out) == 5 and {(r.doc_id, r.size) for r in out} >= {(1, 16), (None, 16), (2, 17), (3, 150016)}
    assert len({r.shard for r in out if r.doc_id == 2}) == 1
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert S.assign_shards(frame.limit(0), shards=3).count() == 0


def test_written_shards(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit(1).alias("shard"), F.lit("s").alias("slot"), F.lit(2).alias("_id"))
    odd = spark.createDataFrame([(None, "a", 1, "s", 2), (None, None, 1, "s", 2), (5, "twice", 1, "s", 2), (5, "twice", 1, "s", 2), (5, "thrice", 1, "s", 2)], docs.schema)
    docs = docs.unionByName(odd)
    plan = S.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r.row) for r in back.collect()) == Counter(map(tuple, docs.collect()))
    assert {(r.row.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in plan.collect()}
    S.write_shards(docs.limit(0), str(tmp_path / "none"), shards=3)


def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / max(sum(weight[s] for s in open_), 1e-12)
        above = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in open_}
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        open_ -= above


def test_targets_brute(spark):
    sizes = {"a": 100, "b": 5000, "c": 7, None: 900, "Z": 350, "ä": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(frame, (5, 2, 1), 1.5, 2.0).collect()}
    want = plain_targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_mix(spark, medium):
    first, again = (M.op8_mixing(spark, medium).toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    assert first.equals(again)
    docs = spark.read.parquet(f"{medium}/documents.parquet").toPandas().set_index("doc_id")
    assert all(r.size == len(docs.text[r.doc_id].encode().split()) for r in first.itertuples())
    first["source"] = docs.source[first.doc_id].to_numpy()
    sums = first.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    want = plain_targets(sums["size"].to_dict(), (5, 2, 1), 1.5, 2.0)
    assert all(abs(sums.target[s] - want[s]) < 1e-6 for s in want)
    assert ((sums.taken - sums.target).abs() / sums.target < 0.02).all()
    assert (first.taken <= 2 * first["size"]).all() and (first.taken % first["size"].clip(lower=1) == 0).all()


def test_inclusion_is_unequal(spark):
    """Over many seeds longer documents of a source are drawn more often, in about the wanted proportion."""
    rows = [(i, "w " * (4 if i % 2 else 60), "a", 0, "") for i in range(40)] + [(100 + i, "w " * 50, "b", 0, "") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    short = long = 0
    for seed in range(6):
        for r in M.copies(frame, weights=(1, 1), share=0.5, most=2.0, seed=seed).select("row.doc_id", "copies").collect():
            if r.doc_id < 100:
                short, long = (short + r.copies, long) if r.doc_id % 2 else (short, long + r.copies)
    assert long > 1.3 * short > 0


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a", 1, "x"), (None, "one two", None, 1, "x"), (2, "b " * 9, "a", 1, "x"), (2, "b " * 9, "a", 1, "x"), (3, "", "b", 1, "x"), (4, "c " * 40000, "c", 1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = M.copies(frame).collect()
    assert len(out) == 6 and all(0 <= r.copies <= 2 for r in out)
    assert M.mixed(frame).schema == frame.schema
    assert M.copies(frame.limit(0)).count() == 0 and M.mixed(frame.limit(0)).count() == 0
    silent = M.copies(spark.createDataFrame([(1, None, "a", 1, "x")], SCHEMA)).collect()
    assert silent[0].copies == 0 and silent[0].target == 0


def test_no_python_in_the_plan(spark, small):
    plan = M.op8_mixing(spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "ArrowEval"))
