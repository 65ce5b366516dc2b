"""Pairs found tile by tile against brute force, with more rows than a tile has."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinsift import session
from kinsift.operators import edges as E, tiles
from kinsift.operators.components import connected_components
from kinsift.options import ScanOptions


def frame(spark, schema, *columns):
    return spark.createDataFrame(list(zip(*(c.tolist() for c in columns))), schema).repartition(7)


@pytest.fixture(scope="module")
def hashes():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 3000)
    some = rng.choice(base, tiles.TILE * 2 + 500)
    for _ in range(6):  # skewed: all differ in the lowest bits alone
        some ^= 1 << rng.integers(0, 20, len(some))
    return some


@pytest.mark.parametrize("threshold,duration", [(4, False), (14, False), (4, True)])
def test_pairs_of_many_tiles(spark, hashes, threshold, duration):
    n = len(hashes)
    times = np.random.default_rng(2).integers(1, 30000, n).astype(float)
    items = frame(spark, "id long, dhash long, d double", np.arange(n), hashes, times)
    got = E.hamming_pairs(items, [], threshold, ["d"], 63, "d" if duration else None)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for every choice of bits
    rows = np.array(sorted((r.src, r.dst, r.distance) for r in got.collect())).reshape(-1, 3)
    want = []
    for i in range(n):
        bits = np.bitwise_count(hashes[i] ^ hashes[i + 1 :])
        ok = bits <= threshold
        if duration:
            ok &= np.abs(times[i] - times[i + 1 :]) <= np.maximum(0.5, np.maximum(times[i], times[i + 1 :]) * 0.01)
        j = np.flatnonzero(ok)
        want.append(np.stack([np.full(len(j), i), j + i + 1, bits[j]], axis=1))
    assert len(rows) and np.array_equal(rows, np.concatenate(want))
    if not duration:
        one = got.limit(50).collect()
        assert all((r.l_d, r.r_d) == (times[r.src], times[r.dst]) for r in one)


def test_odd_rows_pair_nothing(spark):
    rows = [(1, 1, 5), (2, None, 5), (3, None, 5), (4, 1, None), (5, 1, None), (6, 1, 5), (7, 2, 5)]
    assert [tuple(r) for r in E.hamming_pairs(spark.createDataFrame(rows, "id long, k int, dhash long"), ["k"], 3, []).collect()] == [(1, 6, 0)]
    videos = [(1, 1, 1, 9.0, [1, None]), (2, 1, 1, 9.1, [1, 1]), (3, 1, 1, 9.2, [1, 1]), (4, 1, 1, 9.2, [1]), (5, 1, 1, None, [1, 1]), (6, 1, 1, 9.0, [1, None])]
    options = ScanOptions(video_min_matching_frames=1)
    edges = E.video_edges(spark.createDataFrame(videos, "id long, width int, height int, duration double, frame_hashes array<long>"), options).collect()
    assert sorted((r.src, r.dst) for r in edges) == [(1, 6), (2, 3)]
    assert E.hamming_pairs(spark.createDataFrame([], "id long, dhash long"), [], 3, []).count() == 0


def test_a_forest_has_the_components_and_lowest_scores_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 60)
    rows = []
    for i in range(900):
        h = int(rng.choice(base))
        for k in rng.integers(0, 62, rng.integers(0, 4)):
            h ^= 1 << int(k)
        rows.append((i, 1 + i % 2, 1, f"c{i}", h, [int(x) for x in rng.integers(0, 9, 12)]))
    prints = spark.createDataFrame(rows, "id long, width int, height int, content_hash string, dhash long, thumbnail array<int>").repartition(5)

    def told(edges):
        edges = edges.localCheckpoint()
        labels = connected_components(edges)
        low = edges.join(labels, edges.src == labels.node).groupBy("component").agg(F.min("score").alias("score"))
        return edges.count(), sorted(map(tuple, labels.collect())), sorted(map(tuple, low.collect()))

    all_pairs, forest = told(E.image_edges(prints, 4, 63, 3.0)), told(E.image_edges(prints, 4, 63, 3.0, forest=True))
    assert forest[1:] == all_pairs[1:] and forest[0] < all_pairs[0] and forest[0] < 900


def test_workers_give_memory_back_after_the_last_batch(spark, monkeypatch):
    done = []
    monkeypatch.setattr(session, "trim", lambda: done.append(1))
    out = session.trimmed(lambda batches: (x for x in batches))(iter([pa.record_batch({"a": [1]}), pa.record_batch({"a": [2]})]))
    assert next(out).num_rows == 1 and not done
    assert len(list(out)) == 1 and done == [1]
    seen = []
    monkeypatch.setattr(tiles, "trimmed", lambda run: seen.append(run) or run)
    E.hamming_pairs(spark.createDataFrame([(1, 5), (2, 5)], "id long, dhash long"), [], 3, [])
    assert len(seen) == 2  # the cutting of tiles and their comparison
