"""Pictures and videos by stand-ins for Pillow, ffprobe and ffmpeg, whose output follows from what a file begins with."""

import hashlib
import os
import sys
import types

import pytest

from kinsift.engine import scan
from kinsift.options import ScanOptions
from kinsift.sources import content

#: A file's first byte is the shade of its frames, its second one what goes wrong.
FFMPEG = """#!{python}
import sys, time
args = sys.argv[1:]
paths = [args[i + 1] for i, a in enumerate(args) if a == "-i"]
seconds = [float(args[i + 1]) for i, a in enumerate(args) if a == "-ss"]
shade, wrong = open(paths[0], "rb").read(2)
together = "-filter_complex" in args
if wrong == ord("s"):
    time.sleep(5)
if together and wrong in b"bB" or wrong == ord("x") or wrong == ord("B") and seconds[0] > 3:
    sys.exit(1)
out = b""
for s in seconds:
    k = int(s) % 9
    out += bytes(shade + 9 - c if (r + c + shade) % 3 or c == k else shade + c for r in range(8) for c in range(9))
sys.stdout.buffer.write(out[: -1 if together and wrong == ord("h") else None])
"""
FFPROBE = """#!{python}
import sys
data = open(sys.argv[-1], "rb").read(2)
if data[1] == ord("p"):
    sys.exit(1)
sys.stdout.write(f"noise\\nwidth=64\\nheight=48\\nwidth=1\\nduration={{10.0 + data[0] % 2 / 10}}\\n")
"""


@pytest.fixture
def tools(tmp_path, monkeypatch):
    folder = tmp_path / "tools"
    folder.mkdir()
    for name, text in (("ffmpeg", FFMPEG), ("ffprobe", FFPROBE)):
        (folder / name).write_text(text.format(python=sys.executable))
        (folder / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{folder}{os.pathsep}{os.environ['PATH']}")
    return folder


def video(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data + bytes(2000))
    return str(path)


def test_probe(tools, tmp_path):
    assert content.probe(video(tmp_path, "a.mp4", b"A.")) == (64, 48, 10.1)
    assert content.probe(video(tmp_path, "b.mp4", b"Bp")) == (None,) * 3


def test_frames_together_and_one_by_one(tools, tmp_path, monkeypatch):
    facts = (10.0, 64, 48, 3)
    whole = content.frame_hashes(video(tmp_path, "a", b"A."), *facts)
    assert len(whole) == 3 and len(set(whole)) > 1
    # The call for all fails, or gives too little: the same frames come one by one.
    assert content.frame_hashes(video(tmp_path, "b", b"Ab"), *facts) == whole
    assert content.frame_hashes(video(tmp_path, "h", b"Ah"), *facts) == whole
    # Those that fail are left out.
    assert content.frame_hashes(video(tmp_path, "B", b"AB"), *facts) == whole[:1]
    assert content.frame_hashes(video(tmp_path, "x", b"Ax"), *facts) is None
    assert content.frame_hashes(video(tmp_path, "z", b"A."), 0.0, 64, 48, 3) is None
    monkeypatch.setattr(content, "FRAME_SECONDS", 0.3)
    assert content.frame_hashes(video(tmp_path, "s", b"As"), *facts) is None


def test_no_tools(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    path = video(tmp_path, "a", b"A.")
    assert content.probe(path) == (None,) * 3 and content.frame_hashes(path, 10.0, 64, 48, 3) is None and not content.has_ffmpeg()


def test_videos_in_a_whole_scan(spark, tools, tmp_path, monkeypatch):
    files = tmp_path / "files"
    files.mkdir()
    for name, data in {"a.mp4": b"A.one", "a2.mp4": b"A.one", "b.mkv": b"A.two", "c.avi": b"Ebthree", "d.mp4": b"Ap", "e.txt": b"A.four", "f.mp4": b"ABfive"}.items():
        video(files, name, data)
    monkeypatch.setitem(spark.sparkContext.environment, "PATH", os.environ["PATH"])
    result = scan(spark, ScanOptions(str(files), str(files), video_workers=3, enable_image_similarity=False), progress=lambda _: None)
    assert result.video_similarity_enabled
    groups = {r.group_id: (r.kind, r.score) for r in result.groups.collect()}
    members = {}
    for r in result.members.collect():
        members.setdefault(groups[r.group_id], set()).add(os.path.basename(r.path))
    assert members == {("exact+video", 100): {"a.mp4", "a2.mp4", "b.mkv"}}


class Picture:
    def __init__(self, size, mode="RGB"):
        self.size, self.mode = size, mode

    def __enter__(self):
        return self

    def __exit__(self, *error):
        return False

    def convert(self, mode):
        return Picture(self.size, mode)

    def resize(self, size, how):
        assert how == "lanczos"
        return Picture(size, self.mode)

    def tobytes(self):
        n = self.size[0] * self.size[1] * len(self.mode)
        return bytes((7 * k) % 251 for k in range(n))


def test_picture(monkeypatch):
    def open_(path):
        if path == "broken":
            raise ValueError("no picture")
        return Picture((40, 30))

    image = types.SimpleNamespace(open=open_, Resampling=types.SimpleNamespace(LANCZOS="lanczos"))
    ops = types.SimpleNamespace(exif_transpose=lambda raw: Picture(raw.size[::-1]))
    monkeypatch.setitem(sys.modules, "PIL", types.SimpleNamespace(Image=image, ImageOps=ops))
    width, height, digest, dhash, thumbnail = content.picture("some")
    assert (width, height) == (30, 40) and digest == hashlib.sha256(Picture((30, 40)).tobytes()).hexdigest()
    assert len(thumbnail) == 32 * 32 * 3 and thumbnail[:3] == [0, 7, 14]
    gray = Picture((9, 8), "L").tobytes()
    bits = "".join("1" if gray[9 * r + c] > gray[9 * r + c + 1] else "0" for r in range(8) for c in range(8))
    assert dhash & (1 << 64) - 1 == int(bits, 2)
    assert content.picture("broken") == (None,) * 5
