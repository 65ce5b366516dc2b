import os
import re

import pytest

from kinsift import sinks
from kinsift.engine import scan
from kinsift.options import ScanOptions
from kinsift.sources import content, filetree


def tree(base, contents):
    for name, data in contents.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(base)


def names(result):
    return sorted(tuple(sorted(os.path.basename(r.path) for r in rows)) for rows in by_group(result).values())


def by_group(result):
    out = {}
    for r in result.members.orderBy("group_id", "pos").collect():
        out.setdefault(r.group_id, []).append(r)
    return out


def test_exact(spark, tmp_path):
    root = tree(tmp_path, {"a.txt": b"same", "b.txt": b"same", "c.txt": b"different"})
    result = scan(spark, ScanOptions(root, root))
    assert result.totals().first().asDict() == {"files_scanned": 3, "bytes_scanned": 17}
    assert names(result) == [("a.txt", "b.txt")]
    assert all(re.fullmatch("[0-9a-f]{12}", r.group_hash) for r in result.groups.collect())
    assert {tuple(r.roots) for r in result.files.collect()} == {("A", "B")}
    assert {r.path[-5:]: bool(r.exact_hash) for r in result.files.collect()} == {"a.txt": True, "b.txt": True, "c.txt": False}


def test_many_and_two_groups(spark, tmp_path):
    root = tree(tmp_path, {f"{i}.bin": b"x" * 4096 for i in range(8)} | {"y.bin": b"y" * 4096, "c": b"same-c", "d": b"same-c", "e": b"same-e", "f": b"same-e"})
    result = scan(spark, ScanOptions(root, root))
    assert [len(x) for x in names(result)] == [8, 2, 2]
    assert len({r.group_hash for r in result.groups.collect()}) == 3


def test_empty_hidden_and_missing(spark, tmp_path):
    root = tree(tmp_path / "a", {"e1": b"", "sub/e2": b"", ".h": b"hid", "sub/_u": b"hid", "odd": b"12345"})
    os.symlink(tmp_path / "gone", tmp_path / "a" / "broken")
    result = scan(spark, ScanOptions(root, str(tmp_path / "none")))
    assert names(result) == [(".h", "_u"), ("e1", "e2")]
    messages = [r.message for r in result.warnings.collect()]
    assert any("folder B is missing" in m for m in messages) and any("no facts of" in m for m in messages)


def test_overlapping_roots(spark, tmp_path):
    root = tree(tmp_path, {"x": b"1", "b/y": b"1"})
    result = scan(spark, ScanOptions(root, f"{root}/b"))
    assert {r.path[-1]: tuple(r.roots) for r in result.files.collect()} == {"x": ("A",), "y": ("A", "B")}
    assert [r.id for r in result.files.orderBy("id").collect()] == [0, 1]


def test_a_tree_is_cut_below_its_top(tmp_path):
    contents = {f"top/{i}/{j}/{k}/f": b"x" for i in range(3) for j in range(20) for k in range(6)} | {"top/g": b"y", "h": b"", "top/1/i": b"zz"}
    root = tree(tmp_path, contents)
    reader = filetree.TreeReader({"root": "A", "path": root})
    parts = reader.partitions()
    assert 60 < len(parts) <= filetree.SUBTREES
    found = [os.path.relpath(row[1], root) for part in parts for row in reader.read(part)]
    assert sorted(found) == sorted(contents)


def test_missing_tools_are_warned_of(spark, tmp_path):
    root = tree(tmp_path, {"x": b"1"})
    result = scan(spark, ScanOptions(root, root))
    told = {r.stage for r in result.warnings.collect()}
    assert result.image_similarity_enabled == content.has_pillow() and ("image" in told) != content.has_pillow()
    assert result.video_similarity_enabled == content.has_ffmpeg() and ("video" in told) != content.has_ffmpeg()
    quiet = scan(spark, ScanOptions(root, root, enable_image_similarity=False, enable_video_similarity=False))
    assert quiet.warnings.count() == 0


def test_unreadable_pictures_give_nulls(spark, tmp_path):
    root = tree(tmp_path, {"x.png": b"no picture"})
    assert content.picture(f"{root}/x.png") == (None,) * 5
    assert content.probe(f"{root}/x.png") == (None,) * 3
    assert content.file_digest(f"{root}/none")[0] is None


def test_delete(spark, tmp_path):
    root = tree(tmp_path / "t", {"a": b"1", "b": b"1", "c": b"1"})
    result = scan(spark, ScanOptions(root, root))
    session = result.session(())
    plan = session.delete_plan()
    with pytest.raises(ValueError):
        sinks.delete_files(plan)
    paths = sorted(r.path for r in plan.collect())
    bin_ = str(tmp_path / "bin")
    assert sinks.quarantine(paths[0], bin_)[1] == "deleted" and os.path.exists(bin_ + paths[0])
    done = sorted((r.path, r.status, r.error) for r in sinks.delete_files(plan, permanent=True).collect())
    assert done == [(paths[0], "error", sinks.MISSING), (paths[1], "deleted", None)]
    assert os.path.exists(session.with_actions().where("action = 'KEEP'").first().path)
    sinks.write_manifest(plan, str(tmp_path / "manifest"))
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 2
