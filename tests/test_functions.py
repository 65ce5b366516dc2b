import os
import re

import pytest
from pyspark.sql import functions as F

from kinsift.functions import measures as M, paths as P
from kinsift.operators import views as V
from kinsift.options import ScanOptions, resolve_roots
from kinsift.sources import content


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hamming_ignores_sign(spark):
    assert one(spark, M.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long"))) == 62
    assert one(spark, M.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long"))) == 64


def test_dhash_top_bit(spark):
    falling = [x for _ in range(8) for x in range(9, 0, -1)]
    assert one(spark, M.dhash(F.array(*map(F.lit, falling)))) == -1
    assert content.dhash_of(bytes(falling)) == -1
    assert content.dhash_of(bytes(72)) == 0
    some = [(i * 37) % 251 for i in range(72)]
    assert one(spark, M.dhash(F.array(*map(F.lit, some)))) == content.dhash_of(bytes(some))


@pytest.mark.parametrize("d,t,score", [(1, 8, 98), (4, 10, 92), (0, 0, 100), (1, 0, 0), (4, 4, 80), (0, 4, 100)])
def test_similarity_score(spark, d, t, score):
    assert one(spark, M.similarity_score(F.lit(d), t)) == score


@pytest.mark.parametrize("a,b,match", [(10.0, 10.5, True), (100.0, 101.0, True), (10.0, 10.51, False), (60.0, 60.3, True)])
def test_durations(spark, a, b, match):
    assert one(spark, M.durations_match(F.lit(a), F.lit(b))) is match


@pytest.mark.parametrize("size,shown", [(0, "0 B"), (1023, "1,023 B"), (1024, "1.00 KB"), (1048575, "1,024.00 KB"), (1 << 60, "1,024.00 PB"), (5 << 30, "5.00 GB")])
def test_format_bytes(spark, size, shown):
    assert one(spark, M.format_bytes(F.lit(size).cast("long"))) == shown


def test_mean_difference(spark):
    array = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, M.mean_difference(array(1, 2), array(3, 7))) == 3.5
    assert one(spark, M.mean_difference(array(1), array(3, 7))) == float("inf")
    assert one(spark, M.mean_difference(F.array().cast("array<int>"), F.array().cast("array<int>"))) == float("inf")


def test_sample_positions(spark):
    assert M.sample_ratios(1) == [0.5]
    assert M.sample_ratios(5) == [0.1 + 0.2 * i for i in range(5)]
    assert one(spark, M.sample_positions(F.lit(0.9), 3)) == [0.0, 0.0, 0.0]
    assert one(spark, M.sample_positions(F.lit(10.0), 2)) == [1.0, 9.0]


def test_probe_output(spark):
    assert content.parse_probe(b"width=1920\nheight=1080\nduration=60.5\n") == (1920, 1080, 60.5)
    assert content.parse_probe(b"\x81\nwidth= 4\nwidth=9\nheight=2\nduration=1") == (4, 2, 1.0)
    assert content.parse_probe(b"width=4\nheight=2") == (None, None, None)
    assert one(spark, M.probe_value(F.lit("a\r\nwidth = 4 \nwidth=9"), "width")) == "4"
    assert one(spark, M.probe_value(F.lit("nothing"), "width")) is None


def test_extension_is_splitext(spark):
    names = ["a.txt", ".hidden", "a.tar.gz", "a.", "..a", ".a.b", "noext", "...", "a..b", "a b.JPG"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.extension(F.col("n")).alias("e"), P.stem(F.col("n")).alias("s")).collect()
    assert [(r.s, r.e) for r in rows] == [os.path.splitext(n) for n in names]


def test_casefold_and_strip(spark):
    rows = spark.createDataFrame([("Straße",), ("ΑΣ",), (None,)], "s string").select(P.casefold(F.col("s")).alias("c")).collect()
    assert [r.c for r in rows] == ["strasse", "ας".casefold(), None]
    assert one(spark, P.strip(F.lit("\u3000 a b \u3000"))) == "a b"


@pytest.mark.parametrize("name,base", [("写真（１）", "写真"), ("photo (1)", "photo"), ("photo-02", "photo"), ("x copy 3", "x"), ("episode-123", None), ("photo", None)])
def test_copy_bases(spark, name, base):
    found = one(spark, P.copy_bases(F.lit(name)))
    assert (base in found) if base else found == []


def test_markers(spark):
    assert one(spark, P.has_marker(F.lit("/a/★/b"), ("★",)))
    assert not one(spark, P.has_marker(F.lit("/a/b"), ("",)))
    assert not one(spark, P.has_marker(F.lit("/a/b"), ()))


def test_fit():
    assert P.fit_text("abc", 5) == "abc  "
    assert P.fit_text("abcdef", 5) == "ab..."
    assert P.fit_text("写真写真", 5) == "写..."
    assert P.fit_text("abc", 2) == "ab"
    assert P.fit_text("abc", 0) == ""


def test_roots():
    asked = []
    assert resolve_roots("C:\\data", None, asked.append) == ("C:\\data", "C:\\data") and not asked
    assert resolve_roots(None, None, lambda x: asked.append(x) or x[-1]) == ("A", "B")
    assert asked == ["Directory A", "Directory B"]


def test_log_lines(spark):
    messages = ["Scan started.", "Scan started.", " \n ", "Scan started.", "2 files\nfound.", "x", "2 files\nfound."]
    rows = spark.createDataFrame(list(enumerate(messages)), "seq long, message string")
    assert [r.message for r in V.log_lines(rows).orderBy("seq").collect()] == ["Scan started.", "2 files found.", "x", "2 files found."]
    assert [r.message for r in V.log_lines(rows, most=2).orderBy("seq").collect()] == ["x", "2 files found."]


def test_time_format(spark):
    assert re.fullmatch(r"1970-01-01 00:01", one(spark, M.format_time(F.lit(60.0))))


def test_pad_frames(spark):
    longs = F.array(F.lit(1), F.lit(2)).cast("array<bigint>")
    assert one(spark, M.pad_frames(longs, 4)) == [1, 2, 2, 2]
    assert one(spark, M.pad_frames(longs, 1)) == [1]
    assert one(spark, M.pad_frames(F.array().cast("array<bigint>"), 2)) is None
