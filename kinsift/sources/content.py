"""What has to open files: content hashes, pictures and videos. Each is one Arrow pass over paths, on executors.

Pillow, ffmpeg and ffprobe are optional. A file that can't be read gives null and, where asked, a reason;
it never fails a job.
"""

from __future__ import annotations

import hashlib
import importlib.util
import shutil
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinsift.functions.measures import pad_frames, sample_ratios

#: Bytes read at once.
BLOCK = 1 << 20
#: Seconds for metadata, and for each frame.
PROBE_SECONDS, FRAME_SECONDS = 10, 20
#: Pixels of a row and rows of a frame's hash.
FRAME = (9, 8)
THUMBNAIL = 32


def _over_paths(rows: DataFrame, work: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """(id and schema's columns): work(value) gives a tuple for each id and value of rows."""
    names = ["id", *(x.strip().split(" ")[0] for x in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # small batches: a row can take seconds
                part = batch.slice(i, 64)
                found = list(zip(*(work(*x) for x in zip(*(c.to_pylist() for c in part.columns[1:])))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(found, kinds))], names)

    return rows.mapInArrow(run, f"id long, {schema}")


def file_digest(path: str) -> tuple[str | None, str | None]:
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as file:
            while block := file.read(BLOCK):
                digest.update(block)
    except OSError as error:
        return None, str(error)
    return digest.hexdigest(), None


def content_hashes(files: DataFrame) -> DataFrame:
    """(id, exact_hash, error) of files (id, path), read in blocks."""
    return _over_paths(files.select("id", "path"), file_digest, "exact_hash string, error string", [pa.string()] * 2)


def dhash_of(pixels: bytes, columns: int = FRAME[0], rows: int = FRAME[1]) -> int:
    """A signed 64-bit hash: a bit for each pixel and its right neighbour, 1 where the left is lighter."""
    bits = "".join(str(int(pixels[r * columns + c] > pixels[r * columns + c + 1])) for r in range(rows) for c in range(columns - 1))
    value = int(bits, 2)
    return value - (1 << 64) if value >> 63 else value


def has_pillow() -> bool:
    return importlib.util.find_spec("PIL") is not None


def has_ffmpeg() -> bool:
    return shutil.which("ffmpeg") is not None


def picture(path: str) -> tuple:
    """(width, height, content_hash, dhash, thumbnail) of a picture turned upright, in RGB; nulls if it can't be decoded."""
    try:
        from PIL import Image, ImageOps

        with Image.open(path) as raw:
            upright = ImageOps.exif_transpose(raw).convert("RGB")
            small = upright.resize((THUMBNAIL, THUMBNAIL), Image.Resampling.LANCZOS)
            gray = upright.convert("L").resize(FRAME, Image.Resampling.LANCZOS)
            return (*upright.size, hashlib.sha256(upright.tobytes()).hexdigest(), dhash_of(gray.tobytes()), list(small.tobytes()))
    except Exception:  # whatever a decoder raises
        return (None,) * 5


def picture_prints(files: DataFrame) -> DataFrame:
    """(id, width, height, content_hash, dhash, thumbnail) of files (id, path)."""
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32())]
    return _over_paths(files.select("id", "path"), picture, "width int, height int, content_hash string, dhash long, thumbnail array<int>", kinds).where("content_hash IS NOT NULL")


def parse_probe(output: bytes) -> tuple[int | None, int | None, float | None]:
    """Width, height and duration from lines key=value, of which the first of a key counts; nulls unless all three are there."""
    seen: dict[str, str] = {}
    for line in output.decode("utf-8", "replace").splitlines():
        key, sign, value = line.partition("=")
        if sign:
            seen.setdefault(key.strip(), value.strip())
    try:
        return int(seen["width"]), int(seen["height"]), float(seen["duration"])
    except (KeyError, ValueError):
        return None, None, None


def _output(command: list[str], seconds: float) -> bytes | None:
    try:
        done = subprocess.run(command, capture_output=True, timeout=seconds, stdin=subprocess.DEVNULL)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def probe(path: str) -> tuple:
    tool = shutil.which("ffprobe")
    wanted = ["-v", "error", "-show_entries", "stream=width,height:format=duration", "-of", "default=noprint_wrappers=1"]
    output = _output([tool, *wanted, path], PROBE_SECONDS) if tool else None
    return (None,) * 3 if output is None else parse_probe(output)


def video_metadata(files: DataFrame) -> DataFrame:
    """(id, width, height, duration) of files (id, path) that can be probed."""
    kinds = [pa.int32(), pa.int32(), pa.float64()]
    return _over_paths(files.select("id", "path"), probe, "width int, height int, duration double", kinds).where("duration IS NOT NULL")


def frame_hashes(path: str, duration: float, width: int, height: int, count: int) -> list[int] | None:
    """Hashes of `count` frames. They are taken by one call; if that fails, one by one, and those that fail are left out."""
    tool = shutil.which("ffmpeg")
    if not tool or not (duration > 0 and width > 0 and height > 0):
        return None
    seconds = [max(0.0, duration * r) if duration > 1 else 0.0 for r in sample_ratios(count)]
    # What makes both ways give the same frames.
    quiet, raw = [tool, "-hide_banner", "-loglevel", "error", "-nostdin"], ["-f", "rawvideo", "-pix_fmt", "gray", "pipe:1"]
    scale, size = f"scale={FRAME[0]}:{FRAME[1]},format=gray", FRAME[0] * FRAME[1]
    inputs = [x for s in seconds for x in ("-ss", f"{s:.3f}", "-i", path)]
    chains = [f"[{i}:v]trim=end_frame=1,setpts=PTS-STARTPTS,{scale}[f{i}]" for i in range(count)]
    joined = "".join(f"[f{i}]" for i in range(count)) + f"concat=n={count}:v=1:a=0[out]"
    together = [*quiet, *inputs, "-filter_complex", ";".join([*chains, joined]), "-map", "[out]", "-vsync", "0", "-frames:v", str(count), *raw]
    output = _output(together, FRAME_SECONDS * count)
    if output is not None and len(output) >= size * count:
        frames = [output[i * size : (i + 1) * size] for i in range(count)]
    else:
        singles = [_output([*quiet, "-ss", f"{s:.3f}", "-i", path, "-frames:v", "1", "-vf", scale, *raw], FRAME_SECONDS) for s in seconds]
        frames = [x[:size] for x in singles if x is not None and len(x) >= size]
    return [dhash_of(f) for f in frames] or None


def video_frames(videos: DataFrame, count: int) -> DataFrame:
    """videos (id, path, width, height, duration) with `count` frame_hashes, those that have frames; the last one stands for those that failed."""
    rows = videos.select("id", "path", "duration", "width", "height")
    found = _over_paths(rows, lambda *x: (frame_hashes(*x, count),), "frame_hashes array<long>", [pa.list_(pa.int64())])
    found = found.withColumn("frame_hashes", pad_frames(F.col("frame_hashes"), count))
    return videos.join(found.where("frame_hashes IS NOT NULL"), "id")


def histogram(text: Column) -> Column:
    """Characters of a text by code point modulo 64: an array of 64 counts, zeros for null."""

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: np.bincount(np.frombuffer((s or "").encode("utf-32-le"), "<u4") % 64, minlength=64).astype(np.int32))

    return run(text)
