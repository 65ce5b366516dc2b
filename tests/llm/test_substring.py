import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm import substring as S

SCHEMA = "doc_id long, text string, n_chars long, start string, spans int"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def compare(left, right):
    mine, theirs = (S.shingle_hashes(S.word_hashes(" ".join(x).encode())[0]) for x in (left, right))
    return S.compare(mine, theirs)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "s", 1) for i, t in rows], SCHEMA)


def test_word_hashes_do_not_depend_on_the_place():
    a, _ = S.word_hashes(b"  alpha beta\tgamma ")
    b, _ = S.word_hashes(b"gamma\x0balpha\n beta")
    assert a[[2, 0, 1]].tolist() == b.tolist() and len(set(a.tolist())) == 3
    many = [b"one two three four five six", b"", b"seven eight nine ten eleven twelve one two three four five six"]
    got = list(S.documents_shingles(many))
    assert [len(x) for x in got] == [2, 0, 8] and got[0].tolist() == got[2][-2:].tolist()
    long = [b"x y z u v " * 40000, b"a b c d e"]
    assert [len(x) for x in S.documents_shingles(long)] == [200_000 - 4, 1]


@pytest.mark.parametrize("seed", range(6))
def test_compact_windows_brute(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(S.WIDTH, 250, 4)
    pool = rng.integers(0, 2**63, 6 if seed % 2 else 10**6, dtype=np.uint64)  # with many repeats, or none
    h = pool[rng.integers(0, len(pool), size.sum())]
    base = np.cumsum(size) - size
    doc = np.repeat(np.arange(4), size)
    first, last = base[doc], (base + size - 1)[doc]
    ok = (last - S.WIDTH + 1 >= np.arange(len(h)))[: len(h) - S.WIDTH + 1]
    opens = np.zeros(len(ok), bool)
    opens[base] = True
    v = (h * S._FACTORS[0] & ~S._PLACE) | np.arange(len(h), dtype=np.uint64)
    want: dict[int, list[int]] = {}
    for i in np.flatnonzero(ok):
        want.setdefault(int(i + np.argmin(v[i : i + S.WIDTH])), []).append(int(i))
    got = {}
    for start, end, c, l, r in zip(*S.compact_windows(v, S.Layout(first, last, ok, opens))):  # noqa: E741
        got[int(c)] = list(range(start, end + 1))
        assert v[l : r + 1].min() == v[c] and first[c] <= l <= c <= r <= last[c]
        assert (l == first[c] or v[l - 1] < v[c]) and (r == last[c] or v[r + 1] < v[c])
    assert got == want


def test_compare():
    rng = random.Random(0)
    p = words(rng, 80)
    x, y = words(rng, 30), words(rng, 40)
    assert compare(x + p, p + y) == [(30, 110, 0, 80, 1.0)]
    changed = p[:40] + ["new"] + p[41:]
    ((a, b, c, d, s),) = compare(x + p, changed + y)
    assert (a, b, c, d) == (30, 110, 0, 80) and 0.8 <= s < 1
    inserted = p[:40] + ["new"] + p[40:]
    assert compare(p, inserted)[0][:4] == (0, 80, 0, 81)
    assert compare(p[:40] + x, p[:40] + y) == []  # forty words are too few
    assert compare(["a"] * 100, ["a"] * 60)
    scrambled = [w for i in range(0, 80, 4) for w in (*p[i : i + 3], "q")]
    assert compare(p, scrambled) == []


def test_compare_takes_in_what_lies_beyond_a_long_insertion():
    rng = random.Random(2)
    p = words(rng, 98)
    ((a, b, c, d, s),) = compare(p, p[:49] + words(rng, 13) + p[49:])
    assert (a, b, c, d) == (0, 98, 0, 111) and 0.8 <= s < 0.82
    p = words(rng, 200)
    ((a, b, c, d, s),) = compare(p, p[:45] + words(rng, 20) + p[45:])
    assert (a, b, c, d) == (0, 200, 0, 220) and 0.86 < s < 0.88
    # Runs of 60, 3 and 55 shingles, in either order: the first is similar with both of the others, with neither alone.
    p = words(rng, 131)
    q = p[:64] + words(rng, 10) + p[64:71] + ["new"] + p[72:]
    for x, y in ((p, q), (q, p), (p[::-1], q[::-1]), (q[::-1], p[::-1])):
        ((a, b, c, d, s),) = compare(x, y)
        assert (a, b, c, d) == (0, len(x), 0, len(y)) and 0.8 <= s < 0.82


def test_planted_passages(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    near = passage[:30] + ["changed"] + passage[31:]
    rows = [(i, words(rng, rng.randrange(60, 400))) for i in range(60)]
    for i, p in ((3, passage), (17, passage), (30, near), (44, passage)):
        k = rng.randrange(len(rows[i][1]))
        rows[i][1][k:k] = p
    found = S.repeats(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert {(r.id, r.to) for r in found} >= {(17, 3), (30, 3), (44, 3)} and {r.id for r in found} == {17, 30, 44} and all(r.to < r.id for r in found)
    text = dict(rows)
    for r in found:
        assert r.to != 3 or r.end - r.start >= 60
        assert set(text[r.id][r.start : r.end]) - set(text[r.to][r.to_start : r.to_end]) <= {"changed", passage[30]}


def test_every_exact_repeat_is_covered(spark, small):
    table = {r.doc_id: r.text.encode().lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    least: dict[tuple, int] = {}
    for i in sorted(table):
        for k in range(len(table[i]) - S.PASSAGE + 1):
            least.setdefault(tuple(table[i][k : k + S.PASSAGE]), i)
    covered: dict[int, set[int]] = {}
    for r in S.op5_substring(spark, small).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.first_doc_id < r.doc_id and r.similarity >= S.SIMILAR and r.end - r.start >= S.PASSAGE
        a = {tuple(table[r.doc_id][k : k + 5]) for k in range(r.start, r.end - 4)}
        b = {tuple(table[r.first_doc_id][k : k + 5]) for k in range(r.first_start, r.first_end - 4)}
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9
    for i, w in table.items():
        for k in range(len(w) - S.PASSAGE + 1):
            if least[tuple(w[k : k + S.PASSAGE])] < i:
                assert covered.get(i, set()).issuperset(range(k, k + S.PASSAGE))


@pytest.mark.parametrize("n", (1, 5))
def test_variants_of_a_smaller_document_do_not_hide_a_passage(spark, n):
    rng = random.Random(3)
    p = words(rng, 60)
    # Smaller documents have parts of the passage, between other words; so every name of the passage is theirs too.
    rows = [(i, words(rng, 50) + p[max(0, c - 17) : c + 17] + words(rng, 50)) for i, c in enumerate(range(0, 61, 2))]
    rows += [(i, words(rng, 50) + p + words(rng, 50)) for i in (100, 101)]
    frame = docs(spark, [(i, " ".join(w)) for i, w in rows]).repartition(n)
    assert {(r.id, r.to, r.start, r.end) for r in S.repeats(frame).collect()} == {(101, 100, 50, 110)}


@pytest.mark.parametrize("n", (1, 9))
def test_a_passage_twice_in_one_document(spark, n):
    rng = random.Random(8)
    p = words(rng, 60)
    rows = [(1, words(rng, 50) + p), (2, words(rng, 30) + p + words(rng, 200) + p + words(rng, 20))]
    # Of documents 11 and 12, the smaller has a part of another passage before all of it.
    q = words(rng, 60)
    rows += [(11, words(rng, 50) + q[:34] + words(rng, 300) + q), (12, words(rng, 70) + q)]
    frame = docs(spark, [(i, " ".join(w)) for i, w in rows]).repartition(n, "doc_id")
    assert {(r.id, r.to, r.start, r.end) for r in S.repeats(frame).collect()} == {(2, 1, 30, 90), (2, 1, 290, 350), (12, 11, 70, 130)}


def test_partitions_do_not_matter(spark, medium):
    rng = random.Random(9)
    common, other = words(rng, 70), words(rng, 60)
    rows = [(i, words(rng, 50) + common + words(rng, 50) + (other if i % 3 == 0 else []) + (common if i % 5 == 0 else [])) for i in range(40)]
    for i, w in rows[20:]:  # variants, so that some links fail
        w[60 + i] = "changed"
        w[75 + i % 7] = f"own{i}"
    planted = docs(spark, [(1_000_000 + i, " ".join(w)) for i, w in rows])
    frame = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").unionByName(planted.select("doc_id", "text"))
    dealt = [frame.repartition(1), frame.repartition(7, "doc_id"), frame.orderBy(F.rand(3)).repartition(3), frame.orderBy(F.desc("doc_id"))]
    found = [sorted(map(tuple, S.repeats(x).collect())) for x in dealt]
    assert len(found[0]) > 200 and all(x == found[0] for x in found[1:])


def near_windows(mine, theirs):
    """The windows of a passage's length in mine, by first word, of which theirs has one with a Jaccard similarity of at least 0.8."""
    shingles = [[tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in (mine, theirs)]
    places = {}
    for k, s in enumerate(shingles[1]):
        places.setdefault(s, []).append(k)
    out = set()
    for i in range(len(shingles[0]) - S.WIDTH + 1):
        a = set(shingles[0][i : i + S.WIDTH])
        starts = {j - k for k in range(S.WIDTH) for j in places.get(shingles[0][i + k], ())}
        for j in {x + d for x in starts for d in range(-3, 4)}:
            if 0 <= j <= len(shingles[1]) - S.WIDTH:
                b = set(shingles[1][j : j + S.WIDTH])
                if len(a & b) >= 0.8 * len(a | b):
                    out.add(i)
                    break
    return out


def test_recall_of_near_passages(spark):
    """Of all places where a passage near to one of a smaller document lies, by brute force, at least nine in ten are found; none is made up."""
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(40, 200))) for i in range(160)]
    for _ in range(40):  # passages in two to six documents, each with changes of its own
        passage = words(rng, rng.randrange(52, 130))
        for i in rng.sample(range(160), rng.randrange(2, 7)):
            own = list(passage)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice(([], ["new"], ["two", "more"]))
            k = rng.randrange(len(rows[i][1]))
            rows[i][1][k:k] = own
    covered = {}
    for r in S.repeats(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        covered.setdefault(r.id, set()).update(range(r.start, r.end))
        a, b = ({tuple(rows[x][1][k : k + 5]) for k in range(y, z - 4)} for x, y, z in ((r.id, r.start, r.end), (r.to, r.to_start, r.to_end)))
        assert len(a & b) >= 0.8 * len(a | b) and r.end - r.start >= S.PASSAGE and r.to < r.id
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    hit = total = 0
    for i, w in rows:
        near = set()
        for j, other in rows[:i]:
            if len(sets[i] & sets[j]) >= 30:
                near |= near_windows(w, other)
        total += len(near)
        hit += sum(set(range(k + 5, k + 45)) <= covered.get(i, set()) for k in near)
    assert total > 1500 and hit >= 0.95 * total


def test_common_shingles_do_not_hide_a_passage():
    rng = random.Random(13)
    p = words(rng, 60)
    theirs = []
    for part in [p[:40]] * 9 + [p[20:]] * 9 + [p]:
        theirs += part + words(rng, 3)
    found = compare(words(rng, 10) + p + words(rng, 10), theirs)
    assert [(a, b) for a, b, *_ in found] == [(10, 70)] and found[0][4] == 1
    twins = S._Twins(*(S.shingle_hashes(S.word_hashes(" ".join(x).encode())[0]) for x in (p, theirs)))
    mine, other = (S.shingle_hashes(S.word_hashes(" ".join(x).encode())[0]) for x in (p, theirs))
    best, to = S._longest(mine, other, twins)
    for k in range(len(mine)):
        lengths = []
        for j in range(len(other)):
            n = 0
            while k + n < len(mine) and j + n < len(other) and mine[k + n] == other[j + n]:
                n += 1
            lengths.append(n)
        assert best[k] == max(lengths) == lengths[to[k]]


def test_odd_rows(spark):
    rng = random.Random(1)
    text = " ".join(words(rng, 100))
    rows = [(1, text), (None, text), (2, None), (3, ""), (4, text.upper()), (4, "other words"), (5, text), (5, text), (6, "w " * 60000), (7, "short")]
    frame = docs(spark, rows)
    found = S.repeats(frame).collect()
    assert {(r.id, r.to) for r in found} == {(4, 1), (5, 1)}
    kept = S.cut_repeats(frame)
    assert kept.schema == frame.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 2, 3, 4, 6, 7], key=str)
    assert [r.text for r in kept.collect() if r.doc_id == 4] == ["other words"]
    assert S.repeats(frame.limit(0)).count() == 0 and S.cut_repeats(frame.limit(0)).count() == 0


def test_cut(spark):
    rng = random.Random(6)
    p, a, b = words(rng, 60), words(rng, 70), words(rng, 80)
    rows = [(1, " ".join(p + a)), (2, " ".join(b[:40]) + "\n" + " ".join(p) + "\n" + " ".join(b[40:]))]
    kept = {r.doc_id: r for r in S.cut_repeats(docs(spark, rows)).collect()}
    assert kept[1].text == rows[0][1]
    assert kept[2].text == " ".join(b[:40]) + "\n" + " ".join(b[40:]) and kept[2].n_chars == len(kept[2].text)
    assert S.without(b"a b  c d", [(1, 3)]) == b"a d" and S.without(b"a b", [(0, 2)]) == b"" and S.without(b"a b c", [(0, 2), (1, 3)]) == b""
