import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kinsift.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, h int, component_id int"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_classes(pairs):
    """(id, fingerprint) to the smallest id that links reach."""
    todo, out = list(range(len(pairs))), [None] * len(pairs)
    while todo:
        group, edge = {todo[0]}, [todo[0]]
        while edge:
            i = edge.pop()
            for j in todo:
                if j not in group and (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                    group.add(j), edge.append(j)
        ids = [pairs[i][0] for i in group if pairs[i][0] is not None]
        for i in group:
            out[i] = min(ids, default=None)
        todo = [i for i in todo if i not in group]
    return out


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b C", "Ärger ÀB c d e f", "a b c d " * 50, "x y z\x1cw v", "long " * 5000])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.createDataFrame([("ab cd é",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row.h & (1 << 64) - 1 == S._hash("ab cd é".encode())


@pytest.mark.parametrize("split", [3, 40, 10**6])
def test_links_brute(spark, split):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    noisy = [int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 6)).tolist())) for b in base for _ in range(8)]
    hot = [0x1234 << 48 | int(x) & 0xF00F0F00F0F0 for x in rng.integers(0, 2**48, 300)]  # many in one block, in chains
    fps = sorted({*noisy, *hot})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), split).collect()
    place = {v: i for i, v in enumerate(signed)}
    forest = S.Forest(len(fps))
    forest.link(np.array([place[r.src] for r in found], int), np.array([place[r.dst] for r in found], int))
    assert split < 10**6 or len(found) < 4 * len(fps)
    assert forest.label.tolist() == plain_classes(list(enumerate(fps)))


def test_subtrees_with_one_side_link_nothing():
    """Such subtrees of two rotations stand next to each other; as rotated, what they hold is alike, as it is not."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        key = int(rng.integers(0, 2**63)) | 1 << 40
        turned = key ^ 1
        other = (turned >> 16 | turned << 48) & (1 << 64) - 1  # its rotation by a block is `turned`
        near = key ^ 1 << 7
        rows = [(0, 1, 0, 1, key), (1, 1, 0, 1, other), (1, 2, 5, 9, other ^ 6), (2, 3, -1, -1, key), (2, 3, -1, -1, near)]
        columns = [pa.array(np.array(x, np.uint64).view(np.int64) if k == 4 else np.array(x)) for k, x in enumerate(zip(*rows))]
        batch = pa.RecordBatch.from_arrays(columns, ["r", "block", "lower", "upper", "fp"])
        found = [sorted(x.values()) for y in S._links(iter([batch])) for x in y.to_pylist()]
        assert found == [sorted(np.array([key, near], np.uint64).view(np.int64).tolist())]


@pytest.mark.parametrize("seed", range(4))
def test_links_join_nothing_that_is_apart(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64) & np.uint64(0xFFFF_FFFF_0F0F_FFFF)
    base = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), (base >> np.uint64(16)) | (base << np.uint64(48))])
    fps = sorted({int(x) for x in base})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    label = dict(zip(signed, plain_classes(list(enumerate(fps)))))
    found = S.links(spark.createDataFrame([(v,) for v in signed], "fp long").coalesce(1), 2).collect()
    assert found and all(label[r.src] == label[r.dst] for r in found)


def test_query_brute(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op1_simhash(spark, small).collect()}
    pairs = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = {i: (f"{fp:016x}", c) for (i, fp), c in zip(pairs, plain_classes(pairs))}
    assert got == want


def odd_rows():
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, ""), (9, "  "), (None, "alone in the world"), (1, "x " * 30000), (2, "one")]
    return [(i, t, "f", 1, 2) for i, t in rows]


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 7), (None, None), (1, 1), (2, 2)], key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicate_keeps_one_row_of_each(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    kept = S.deduplicate(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, None, 1, 2], key=str)
    assert S.deduplicate(docs.limit(0)).count() == 0


def test_random_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(3000)]
    rows = [(i, " ".join(base[:1500] + [f"n{i}"] + base[1501:]), "", 0, 0) for i in range(6)]
    classes = {r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert classes == set(plain_classes(pairs))
