import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinsift.operators import edges as E, groups as G, keeper as K, session as S, views as V
from kinsift.operators.components import connected_components
from kinsift.options import ScanOptions

PRINT = "id long, width int, height int, content_hash string, dhash long, thumbnail array<int>"
VIDEO = "id long, width int, height int, duration double, frame_hashes array<long>"


def closure(pairs):
    label = {}
    for a, b in pairs:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(5, 5), (7, 3), (3, 7), (9, 7)], [(0, i) for i in range(1, 50)]])
def test_components(spark, pairs):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == closure([p for p in pairs if p[0] != p[1]])


def test_components_random(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1)]
    frame = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == closure([p for p in pairs[:-1] if p[0] != p[1]])


def test_exact_edges_and_sizes(spark):
    files = spark.createDataFrame([(1, 4, "a"), (2, 4, "a"), (3, 4, "b"), (4, 5, None), (5, 4, "a")], "id long, size long, exact_hash string")
    assert sorted(r.id for r in E.same_size(files).collect()) == [1, 2, 3, 5]
    assert sorted((r.src, r.dst, r.reason, r.score) for r in E.exact_edges(files).collect()) == [(1, 2, "exact", 100), (1, 5, "exact", 100)]


def test_hamming_pairs_brute(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(6)]
    values = [v - (1 << 64) if v >> 63 else v for v in (x & (1 << 64) - 1 for x in values)]
    items = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(values)], "id long, k int, dhash long")
    for t in (-1, 0, 4, 20):
        got = sorted((r.src, r.dst, r.distance) for r in E.hamming_pairs(items, ["k"], t, []).collect())
        d = lambda a, b: ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count()
        assert got == [(a, b, d(a, b)) for a, b in itertools.combinations(range(len(values)), 2) if a % 2 == b % 2 and d(a, b) <= t]


def test_image_edges(spark):
    gray, red, blue = [100] * 12, [255, 0, 0] * 4, [0, 0, 255] * 4
    rows = [
        (1, 64, 64, "p", 0, gray), (2, 64, 64, "p", 0, gray),  # equal pixels
        (3, 64, 64, "q", 3, [104] * 12),  # two bits and a mean difference of 4
        (4, 64, 64, "r", 0, red), (5, 64, 64, "s", 0, blue),  # equal hashes, other colours
        (6, 64, 32, "p", 0, gray),  # other size
        (7, 64, 64, "t", 31, gray),  # five bits
    ]
    prints = spark.createDataFrame(rows, PRINT)
    got = sorted((r.src, r.dst, r.reason, r.score) for r in E.image_edges(prints, 4).collect())
    assert got == [(1, 2, "image-content", 100), (1, 3, "image", 90), (3, 7, "image", 85)]
    assert E.image_edges(prints, -1).count() == 0


def test_many_blank_pictures_are_a_star(spark):
    rows = [(i, 8, 8, f"c{i}", 0, [200] * 12) for i in range(40)] + [(50, 8, 8, "near", 1, [201] * 12)]
    got = E.image_edges(spark.createDataFrame(rows, PRINT), 4).collect()
    assert sorted((r.src, r.dst, r.score) for r in got) == [(0, i, 100) for i in range(1, 40)] + [(0, 50, 95)]


def test_video_metadata_candidates(spark):
    rows = [(1, 1920, 1080, 60.0, None), (2, 1920, 1080, 60.3, None), (3, 1280, 720, 60.1, None), (4, 1920, 1080, 75.0, None)]
    assert sorted(r.id for r in E.video_metadata_candidates(spark.createDataFrame(rows, VIDEO)).collect()) == [1, 2]


def test_video_edges(spark):
    a, b = [0, 1, 3, 7, 15], [0, 0, 2, 6, 14]
    rows = [(1, 1920, 1080, 60.0, a), (2, 1920, 1080, 60.2, b), (3, 1280, 720, 60.0, a), (4, 9, 9, 5.0, [0] * 5), (5, 9, 9, 5.0, [0, 0, 15, 15, 15]), (6, 9, 9, 5.0, [0] * 4)]
    edges = E.video_edges(spark.createDataFrame(rows, VIDEO), ScanOptions()).collect()
    assert [(r.src, r.dst, r.reason, r.score) for r in edges] == [(1, 2, "video", 92)]


@pytest.mark.parametrize("threshold", [3, 10, 60])
def test_video_edges_brute(spark, threshold):
    rng = random.Random(threshold)
    base = [[rng.getrandbits(63) for _ in range(5)] for _ in range(8)]
    rows = []
    for i in range(70):
        frames = [h ^ sum(1 << k for k in {rng.randrange(63) for _ in range(rng.randrange(3))}) for h in rng.choice(base)]
        rows.append((i, 1 + i % 2, 1, 20 + rng.random(), frames))
    rows += [(100 + i, *rows[0][1:]) for i in range(5)]
    options = ScanOptions(video_threshold=threshold)
    edges = E.video_edges(spark.createDataFrame(rows, VIDEO), options).collect()

    def match(a, b):
        d = [(x ^ y).bit_count() for x, y in zip(a[4], b[4])]
        return a[1] == b[1] and abs(a[3] - b[3]) <= max(0.5, max(a[3], b[3]) * 0.01) and sum(d) <= threshold and sum(x <= 3 for x in d) >= 4

    want = closure([(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if match(a, b)])
    assert closure([(r.src, r.dst) for r in edges]) == want
    place = {r[0]: r for r in rows}
    assert all(match(place[r.src], place[r.dst]) for r in edges) and sum(r.dst >= 100 for r in edges) >= 5
    two = [(*r[:4], [r[4][0], r[4][-1]]) for r in rows]
    possible = lambda a, b: a[1] == b[1] and abs(a[3] - b[3]) <= 0.5 and sum(d := [(x ^ y).bit_count() for x, y in zip(a[4], b[4])]) <= threshold and 5 - sum(x > 3 for x in d) >= 4
    left = {r.id for r in E.video_frame_candidates(spark.createDataFrame(two, VIDEO), options).collect()}
    assert left == {r[0] for r in two if any(r is not o and possible(r, o) for o in two)}


def test_pairs_of_prints(spark):
    images = [(1, 64, 64, "p", 0, [100] * 12), (2, 64, 64, "q", 3, [104] * 12), (3, 64, 64, "p", 0, [100] * 12), (4, 32, 64, "p", 0, [100] * 12), (5, 64, 64, "r", 0, [0] * 12)]
    rows = spark.createDataFrame(images, PRINT).select(F.col("id"), F.struct("*").alias("s"))
    pairs = rows.where("id = 1").select(F.col("s").alias("a")).crossJoin(rows.select("id", F.col("s").alias("b")))
    got = {r.id: r.m and tuple(r.m) for r in pairs.select("id", E.image_match(F.col("a"), F.col("b"), 4).alias("m")).collect()}
    assert got == {1: ("image-content", 100), 2: ("image", 90), 3: ("image-content", 100), 4: None, 5: None}
    videos = [(1, 8, 8, 60.0, [0, 1, 3, 7, 15]), (2, 8, 8, 60.2, [0, 0, 2, 6, 14]), (3, 9, 8, 60.0, [0, 1, 3, 7, 15]), (4, 8, 8, 70.0, [0, 1, 3, 7, 15]), (5, 8, 8, 60.0, [])]
    rows = spark.createDataFrame(videos, VIDEO).select(F.col("id"), F.struct("*").alias("s"))
    pairs = rows.where("id = 1").select(F.col("s").alias("a")).crossJoin(rows.select("id", F.col("s").alias("b")))
    got = {r.id: r.m and tuple(r.m) for r in pairs.select("id", E.video_match(F.col("a"), F.col("b"), ScanOptions()).alias("m")).collect()}
    assert got == {1: ("video", 100), 2: ("video", 92), 3: None, 4: None, 5: None}


def test_search(spark):
    items = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, None)], "id long, dhash long")
    queries = spark.createDataFrame([(9, 1), (3, -2)], "id long, dhash long")
    assert sorted((r.query_id, r.id, r.distance) for r in E.hamming_search(items, queries, 2).collect()) == [(3, 3, 1), (9, 1, 1), (9, 2, 2)]
    assert E.hamming_search(items, queries, -1).count() == 0
    with pytest.raises(ValueError):
        E.hamming_search(items, queries, 64)


def test_duration_buckets_lose_nothing(spark):
    rng = random.Random(5)
    times = [rng.choice([rng.uniform(0.1, 60), rng.uniform(40, 60), rng.uniform(50, 9000)]) for _ in range(300)]
    videos = spark.createDataFrame([(i, 1, 1, t, None) for i, t in enumerate(times)], VIDEO)
    match = lambda a, b: abs(a - b) <= max(0.5, max(a, b) * 0.01)
    want = {i for i, a in enumerate(times) if any(i != j and match(a, b) for j, b in enumerate(times))}
    assert {r.id for r in E.video_metadata_candidates(videos).collect()} == want


def test_preliminary_bound(spark):
    rows = [(1, 1, 1, 5.0, [0, 0]), (2, 1, 1, 5.0, [0, 3]), (3, 1, 1, 5.0, [(1 << 20) - 1, 0]), (4, 1, 1, 5.0, [15, 15])]
    got = sorted(r.id for r in E.video_frame_candidates(spark.createDataFrame(rows, VIDEO), ScanOptions()).collect())
    assert got == [1, 2, 4]  # 2 and 4: six bits, one frame out of reach at most


FILE = "id long, path string, path_cf string, name_cf string, roots array<string>, size long, mtime double, exact_hash string"


def files(spark, rows):
    full = [(i, p, p.casefold(), p.casefold().rsplit("/", 1)[-1].rsplit("\\", 1)[-1], list(r), s, float(m), h) for i, p, r, s, m, h in rows]
    return spark.createDataFrame(full, FILE)


def session(spark, rows, markers=("★",)):
    rows = [(*r, "h") if len(r) == 5 else r for r in rows]
    members, groups = G.build_groups(files(spark, rows), E.exact_edges(files(spark, rows)))
    return S.Session(members, groups, markers)


def actions(session):
    return {r.id: r.action for r in session.with_actions().collect()}


def test_groups_mix_reasons(spark):
    rows = files(spark, [(1, "/b", "A", 5, 1, "x"), (2, "/a", "B", 5, 1, "x"), (3, "/c", "A", 6, 1, None), (4, "/d", "A", 1, 1, None)])
    edges = spark.createDataFrame([(1, 2, "exact", 100), (2, 3, "image", 90), (3, 2, "image", 90)], "src long, dst long, reason string, score int")
    members, groups = G.build_groups(rows, E.distinct_edges(edges))
    (g,) = groups.collect()
    assert (g.group_id, g.kind, g.score, g.n_members, g.n_bytes, g.reasons) == (1, "exact+image", 90, 3, 16, ["exact", "image"])
    assert [(r.id, r.pos) for r in members.orderBy("pos").collect()] == [(2, 1), (1, 2), (3, 3)]
    import hashlib

    parts = ["kind", "exact+image", "score", "90", "reason", "exact", "reason", "image"]
    parts += ["record", "/a", "B", "5", "x", "record", "/b", "A", "5", "x", "record", "/c", "A", "6", "", ""]
    text = chr(0).join(parts)
    assert g.group_hash == hashlib.sha256(text.encode()).hexdigest()[:12]


def test_group_numbers(spark):
    rows = [(i, f"/{p}", "A", 5, 1, h) for i, (p, h) in enumerate([("z", "h1"), ("y", "h1"), ("c", "h2"), ("b", "h2"), ("a", "h3"), ("x", "h3"), ("w", "h3")])]
    _, groups = G.build_groups(files(spark, rows), E.exact_edges(files(spark, rows)))
    assert [(r.group_id, r.first_path_cf) for r in groups.orderBy("group_id").collect()] == [(1, "/a"), (2, "/b"), (3, "/y")]


def test_empty(spark):
    members, groups = G.build_groups(files(spark, []), E.exact_edges(files(spark, [])))
    assert members.count() == groups.count() == 0
    assert S.Session(members, groups, ()).totals().first().asDict() == {"duplicate_file_count": 0, "duplicate_byte_count": 0, "delete_count": 0, "delete_bytes": 0}


@pytest.mark.parametrize(
    "rows,markers,kept",
    [
        ([(1, "C:\\root\\plain.txt", "A", 10, 10), (2, "C:\\root\\starred-★.txt", "B", 1, 1)], ("★",), 2),
        ([(1, "★preferred/small.txt", "A", 1, 1), (2, "plain/large.txt", "A", 10, 10)], ("★",), 1),
        ([(1, "/a/photo.jpg", "A", 1, 1), (2, "/a/photo (1).jpg", "A", 100, 100)], (), 1),
        ([(1, "/a/photo.jpg", "A", 1, 1), (2, "/b/photo-02.jpg", "A", 100, 100)], (), 1),
        ([(1, "/a/episode-02.txt", "A", 10, 10), (2, "/a/other.txt", "A", 1, 1)], (), 1),
        ([(1, "/a/写真（１）.jpg", "A", 9, 9), (2, "/a/写真.jpg", "A", 1, 1)], (), 2),
        ([(1, "/a/x.jpg", "A", 5, 5), (2, "/a/y.jpg", "A", 5, 6)], (), 2),
        ([(1, "/a/long-name.jpg", "A", 5, 5), (2, "/a/y.jpg", "A", 5, 5)], (), 2),
        ([(1, "/a/x.jpg", "A", 5, 5), (2, "/a/y.jpg", "A", 5, 5)], (), 2),
    ],
)
def test_keeper(spark, rows, markers, kept):
    got = actions(session(spark, rows, markers))
    assert got == {r[0]: "KEEP" if r[0] == kept else "DELETE" for r in rows}


def test_keep_root(spark):
    s = session(spark, [(1, "C:\\a\\one.txt", "A", 1, 1), (2, "C:\\b\\one.txt", "B", 100, 1)])
    s.keep_root("A", ())
    assert actions(s) == {1: "KEEP", 2: "DELETE"}


def test_keep_root_flags_only_candidates(spark):
    s = session(spark, [(1, "/a/photo-02.x", "A", 5, 1), (2, "/a/zzz.x", "A", 1, 1), (3, "/b/photo.x", "B", 9, 1)], ())
    s.keep_root("A", ())
    assert actions(s) == {1: "KEEP", 2: "DELETE", 3: "DELETE"}


def test_keep_root_falls_back(spark):
    s = session(spark, [(1, "/b/one", "B", 1, 1), (2, "/b/two", "B", 2, 1)], ())
    s.keep_root("A", ())
    assert actions(s) == {1: "DELETE", 2: "KEEP"}


def test_toggle_set_and_delete(spark):
    s = session(spark, [(1, "/a/one", "A", 1, 1), (2, "/b/one", "B", 2, 1)], ())
    assert actions(s) == {1: "DELETE", 2: "KEEP"} and s.unsafe_groups().count() == 0
    s.toggle(2)
    assert [r.group_id for r in s.unsafe_groups().collect()] == [1]
    with pytest.raises(S.UnsafeGroups):
        s.delete_plan()
    s.toggle(2)
    assert [r.path for r in s.delete_plan().collect()] == ["/a/one"]
    s.mark_deleted_paths(["/a/one"])
    assert s.action_for(1) == "DELETED"
    s.toggle(1), s.set_action(1, "KEEP")
    assert s.action_for(1) == "DELETED"
    s.set_action(2, "DELETE")
    assert s.unsafe_groups().count() == 1
    counts = S.action_counts(s.with_actions()).first()
    assert (counts.keep, counts["delete"], counts.deleted) == (0, 1, 1)
    with pytest.raises(ValueError):
        s.set_action(2, "GONE")


def test_recommend_again_after_deletion(spark):
    s = session(spark, [(1, "/a/one", "A", 1, 1), (2, "/b/one", "B", 2, 1)], ())
    s.set_action(2, "DELETED")
    s.apply_recommended_to_all(())
    assert actions(s) == {1: "DELETE", 2: "DELETED"} and s.unsafe_groups().count() == 1
    s.set_action(1, "KEEP")
    s.apply_recommended_to_group(1, ())
    assert actions(s)[1] == "DELETE"


def test_orders(spark):
    rows = [(1, "/a/one", "A", 5, 1, "x"), (2, "/b/one", "B", 5, 1, "x"), (3, "/c/two", "A", 5, 1, "y"), (4, "/d/two", "B", 5, 1, "y")]
    s = session(spark, rows, ())
    down = [r.id for r in s.rows().orderBy(*V.sort_order("name", True)).collect()]
    assert down == [3, 4, 1, 2]  # ties stay in their order
    assert [r.id for r in V.page(s.rows(), "path", False, 1, 2).collect()] == [2, 3]
    assert V.preview(s.rows().select("path"), "path", 3) == ["/a/one", "/b/one", "/c/two", "... 1 more"]
    lines = [r.line for r in V.row_lines(s.rows()).orderBy("group_id", "pos").collect()]
    assert len(lines) == 4 and all("exact" in x and "5 B" in x for x in lines)
    assert "keep=1 delete=1 deleted=0" in V.group_details(s.rows()).first().detail


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rows = [(i, f"/d/{i % 5}/f{i}", "AB"[i % 2], 4, i % 3, f"h{i % 4}") for i in range(40)]
    frame = files(spark, rows).orderBy(F.rand(parts)).repartition(parts)
    members, groups = G.build_groups(frame, E.exact_edges(frame))
    assert [r.group_hash for r in groups.orderBy("group_id").collect()] == test_partitions_do_not_matter.__dict__.setdefault("seen", [r.group_hash for r in groups.orderBy("group_id").collect()])


@pytest.mark.parametrize("agree,threshold,bits", [(1, 4, 64), (2, 4, 63), (3, 4, 64), (4, 4, 64), (4, 0, 64), (3, 9, 63), (2, 14, 63), (4, 3, 8)])
def test_keys_of_any_length_lose_no_pair_and_repeat_none(spark, monkeypatch, agree, threshold, bits):
    monkeypatch.setattr(E.Bands, "cost", staticmethod(lambda t, c, b, n: abs(c - agree)))
    rng = random.Random(agree * 100 + threshold)
    base = [rng.getrandbits(bits) for _ in range(12)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(bits), rng.randrange(0, min(bits, threshold + 3)))) for b in base for _ in range(5)]
    assert E.Bands(threshold, bits).agree == agree
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    found = E.hamming_pairs(spark.createDataFrame(rows, "id long, dhash long"), [], threshold, [], bits).collect()
    want = {(i, j): (a ^ b).bit_count() for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= threshold}
    assert len(found) == len(want) and {(r.src, r.dst): r.distance for r in found} == want


def test_more_hashes_have_longer_keys():
    widths = [E.Bands(4, 64, n).width for n in (100, 10**5, 10**7, 10**9)]
    assert widths == sorted(widths) and widths[0] < 14 and widths[-1] >= 27
    assert len(E.Bands(4, 64, 10**9).choices) <= 70


def test_notes_write_nothing(spark, monkeypatch):
    files = spark.createDataFrame([(i, 1, f"/a/{i}", f"/a/{i}", f"{i}", ["A"], 1, float(i), "h") for i in range(3)], "id long, g int, path string, path_cf string, name_cf string, roots array<string>, size long, mtime double, exact_hash string")
    members, groups = files.withColumnRenamed("g", "group_id").withColumn("pos", F.col("id") + 1), None
    session = S.Session(members, groups, ())
    monkeypatch.setattr(S, "materialize", lambda *x: 1 / 0)
    assert [session.action_for(i) for i in range(3)] == ["DELETE", "DELETE", "KEEP"]
    session.toggle(0)
    session.set_action(1, "DELETED")
    session.toggle(1)
    session.set_action(1, "KEEP")
    assert [session.action_for(i) for i in range(3)] == ["KEEP", "DELETED", "KEEP"] and session.action_for(9) == "KEEP"
    monkeypatch.undo()
    session.keep_root("A", ())
    assert [session.action_for(i) for i in range(3)] == ["DELETE", "DELETED", "KEEP"] and not session.notes


def test_a_log_without_keys(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(("a", "b", "", "c\nd"))) for k in range(300)]
    shown = [(k, m.replace("\n", " ")) for k, m in rows if m]
    want = [x for i, x in enumerate(shown) if i == 0 or shown[i - 1][1] != x[1]]
    frame = spark.createDataFrame(rows, "seq long, message string").repartition(5)
    assert sorted(map(tuple, V.log_lines(frame, most=None).collect())) == want
    assert sorted(map(tuple, V.log_lines(frame, most=7).collect())) == want[-7:]
    assert V.log_lines(frame.limit(0)).count() == 0


def test_a_group_has_one_key_however_its_joins_are_run(spark):
    """Once a join turns out small enough to be broadcast, its other side is read where it lies: a group's rows then lie in several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    members = spark.range(2000, numPartitions=8).selectExpr("id % 9 AS group_id", "id AS pos", "concat('/p/', id) AS path_cf", "array('A') AS roots", "1L AS size", "'h' AS exact_hash")
    groups = spark.range(9).selectExpr("id AS group_id", "'exact' AS kind", "100 AS score", "array('exact') AS reasons")
    before = {k: spark.conf.get(k, None) for k in conf}
    plain = sorted(map(tuple, G.group_hashes(members, groups).collect()))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        other = sorted(map(tuple, G.group_hashes(members, groups).collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(plain) == 9 and other == plain


def test_lines_of_groups_with_long_numbers(spark):
    row = [(123456, 1, "KEEP", "k" * 12, "exact", 100, ["A"], 5, 0.0, "/a/n.txt")]
    rows = spark.createDataFrame(row, "group_id long, pos long, action string, group_hash string, kind string, score int, roots array<string>, size long, mtime double, path string")
    assert V.row_lines(rows).first().line.split()[1] == "12..."
    assert V.row_lines(rows, marked=False).first().line == f"{'KEEP':8} 12345 {'k' * 12} {'exact':12} {'100':5} {'A':5} {'5 B':11} 1970-01-01 00:00 {'n.txt':40}"
