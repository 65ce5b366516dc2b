"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV files.

mu-law and A-law samples are expanded to 16 bits by tables of 256 entries. ADPCM blocks don't depend on
each other, so all blocks of a file are decoded together: one numpy step per sample position, over all
blocks and channels at once. What is decoded is resampled and stored as 16-bit PCM, again a WAV file.

The query stores every text as one of the three formats, which the text itself decides, so that all of
them are written, read back and decoded over the whole table. Media and PCM are tables of the shared
folder, written and read back round by round, so that only a part of them takes room at a time. PCM is
stored at the operator's own rate; what is read of it, brought back to the media's rate, has to be the
decoded sound.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.common import beside, pieces, read
from kinsift.storage import discard, materialize

#: Format tags of WAV files.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
RATE, TO_RATE = 8000, 16000
#: The rate of which the query's feature tells, as heard again from PCM that is stored at TO_RATE; and the rounds in which it stores.
QUERY_RATE, ROUNDS = RATE, 4
#: A payload's bytes are a multiple of UNIT, and so of the bytes of an ADPCM block.
UNIT, PAD, TAIL, BLOCK = 576, 255, 32, 36
FORMATS = {MULAW: "mulaw", ALAW: "alaw", IMA_ADPCM: "adpcm"}
#: Change of the ADPCM step index by the lower three bits of a code (fixed values).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
#: ADPCM step sizes (fixed values).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


class Wav(NamedTuple):
    tag: int
    channels: int
    rate: int
    block: int
    data: bytes


def write_wav(tag: int, data: bytes, channels: int = 1, rate: int = RATE, block: int | None = None) -> bytes:
    """A WAV file of stored samples. block: bytes that belong together, by default one sample of each channel."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA_ADPCM: 4}[tag]
    block = block or channels * bits // 8
    extra = struct.pack("<HH", 2, samples_per_block(block, channels)) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    frames = len(data) // block * (samples_per_block(block, channels) if tag == IMA_ADPCM else 1)
    second = rate * block // (samples_per_block(block, channels) if tag == IMA_ADPCM else 1)
    head = struct.pack("<HHIIHH", tag, channels, rate, second, block, bits) + extra
    parts = [(b"fmt ", head)] + ([] if tag == PCM else [(b"fact", struct.pack("<I", frames))]) + [(b"data", data)]
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(raw: bytes) -> Wav:
    """The format and the stored samples of a WAV file; raises ValueError where it isn't one."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(raw):
                raise ValueError("format chunk too short")
            head = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            if head is None:
                raise ValueError("data before the format")
            if at + 8 + size > len(raw):
                raise ValueError("data cut off")
            return Wav(head[0], head[1], head[2], head[4], raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def samples_per_block(block: int, channels: int) -> int:
    return (block // channels - 4) * 2 + 1


def decode_adpcm(data: bytes, block: int, channels: int = 1) -> np.ndarray:
    """Samples (frames, channels) of whole IMA ADPCM blocks; a last block that is cut off is left out."""
    n = len(data) // block
    raw = np.frombuffer(data, np.uint8, n * block).reshape(n, block)
    heads = raw[:, : 4 * channels].reshape(n, channels, 4).astype(np.int64)
    value = (heads[..., 0] | heads[..., 1] << 8).astype(np.uint16).view(np.int16).reshape(n, channels).astype(np.int64)
    index = np.minimum(heads[..., 2], len(STEPS) - 1)
    per = samples_per_block(block, channels)
    if not n:
        return np.zeros((0, channels), np.int16)
    # Channels take turns with four bytes each; the lower half of a byte comes first.
    words = raw[:, 4 * channels :][:, : (per - 1) // 8 * 4 * channels].reshape(n, -1, channels, 4).transpose(0, 2, 1, 3).reshape(n, channels, -1)
    codes = np.stack([words & 15, words >> 4], axis=-1).reshape(n, channels, -1)
    out = np.empty((n, 1 + codes.shape[2], channels), np.int16)
    out[:, 0] = value
    for i in range(codes.shape[2]):
        code, step = codes[:, :, i].astype(np.int64), STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, len(STEPS) - 1)
        out[:, i + 1] = value
    return out.reshape(-1, channels)


def decode(wav: Wav) -> np.ndarray:
    """Samples (frames, channels) as 16-bit numbers."""
    if wav.tag in TABLES:
        flat = TABLES[wav.tag][np.frombuffer(wav.data, np.uint8)]
    elif wav.tag == PCM:
        flat = np.frombuffer(wav.data[: len(wav.data) // 2 * 2], "<i2")
    elif wav.tag == IMA_ADPCM:
        return decode_adpcm(wav.data, wav.block, wav.channels)
    else:
        raise ValueError(f"format {wav.tag}")
    return flat[: len(flat) // wav.channels * wav.channels].reshape(-1, wav.channels)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, by linear interpolation in whole numbers; a channel's last sample is held."""
    n = len(samples)
    if not n or rate == to:
        return samples
    if rate % to == 0:  # no place lies between two samples
        return samples[:: rate // to][: n * to // rate]
    place = np.arange(n * to // rate, dtype=np.int64) * rate
    at, part = place // to, (place % to)[:, None]
    low = samples[at].astype(np.int64)
    high = samples[np.minimum(at + 1, n - 1)].astype(np.int64)
    return ((low * (to - part) + high * part) // to).astype(np.int16)


def padded(text: bytes) -> bytes:
    """A text's bytes, filled up to a positive multiple of the unit."""
    return text + bytes([PAD]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def stored(payload: bytes, tags: tuple[int, ...] = tuple(FORMATS)) -> bytes:
    """A WAV file whose samples, or whole ADPCM blocks, are the payload. Its checksum chooses among the formats."""
    tag = tags[zlib.crc32(payload) % len(tags)]
    return write_wav(tag, payload, block=BLOCK if tag == IMA_ADPCM else None)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tags: tuple[int, ...] = tuple(FORMATS)) -> DataFrame:
    """(id_col, n_bytes, media): every text's bytes, filled up, as the samples of a WAV file in one of the formats `tags`.

    Null is the empty text, which fills one unit. Equal texts give equal media. Null and repeated ids and
    repeated rows stay rows; an empty table gives an empty result. Other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            media = [stored(padded(x), tags) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _feature(wav: Wav, samples: np.ndarray, resampled: np.ndarray) -> str:
    x = samples.astype(np.int64).ravel()
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    what = f"format={FORMATS.get(wav.tag, 'pcm')};frames={len(samples)};peak={int(np.abs(x).max())};energy={int((x * x).sum())};crossings={crossings}"
    return f"{what};resampled={len(resampled)}:{zlib.crc32(resampled.astype('<i2').tobytes()):08x}"


#: What from_media() adds.
DECODED = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
    "feature": pa.string(), "pcm": pa.binary(), "error": pa.string(),
}


def decoded(raw: bytes | None, to_rate: int = TO_RATE) -> tuple:
    """The values of DECODED for one file."""
    try:
        wav = read_wav(raw or b"")
        samples = decode(wav)
        if not samples.size:
            raise ValueError("no samples")
    except ValueError as error:
        return (None,) * 7 + (str(error),)
    resampled = resample(samples, wav.rate, to_rate)
    own = (len(wav.data), hashlib.sha256(wav.data).hexdigest(), zlib.crc32(wav.data[-TAIL:]), len(raw), hashlib.sha256(raw).hexdigest())
    return (*own, _feature(wav, samples, resampled), write_wav(PCM, resampled.astype("<i2").tobytes(), wav.channels, to_rate), None)


def from_media(media: DataFrame, keep: list[str], media_col: str = "media", to_rate: int = TO_RATE) -> DataFrame:
    """The columns `keep` with what media_col holds: the stored payload's and the file's size and digests, a feature, and pcm.

    pcm is the resampled sound as a 16-bit WAV file. Files that can't be read give null in all of these but
    `error`, which says why; null media do too. Repeated rows stay rows; an empty table gives an empty
    result. A column of `keep` that has the name of one of these gives way to it.
    """
    keep = beside(keep, list(DECODED))
    inner = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 19):  # PCM is larger than what it is made of
            found = zip(*(decoded(x, to_rate) for x in batch.column(len(inner)).to_pylist())) if batch.num_rows else [[] for _ in DECODED]
            columns = [pa.array(x, k) for x, k in zip(found, DECODED.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], *columns], [*inner, *DECODED])

    schema = ", ".join(f"`{i}` {media.schema[c].dataType.simpleString()}" for i, c in zip(inner, keep))
    schema += (", " if inner else "") + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary, error string"
    made = media.select(*(F.col(c).alias(i) for i, c in zip(inner, keep)), F.col(media_col).alias("_media")).mapInArrow(run, schema)
    return made.select(*(F.col(i).alias(c) for i, c in zip(inner, keep)), *DECODED)


def heard(sound: DataFrame, rate: int = QUERY_RATE) -> DataFrame:
    """sound without `pcm` and `error`: its feature tells of the stored pcm at `rate`, and pcm_bytes and pcm_crc32 of pcm as it is stored. Without pcm both are null."""
    names = [c for c in sound.columns if c not in ("pcm", "error", "feature")]
    inner = [f"_{i}" for i in range(len(names))]

    def tell(what: str | None, raw: bytes | None) -> tuple:
        if raw is None:
            return None, None, None
        wav = read_wav(raw)
        data = resample(decode(wav), wav.rate, rate).astype("<i2").tobytes()
        pcm = write_wav(PCM, data, wav.channels, rate)
        of = f"{len(data) // 2 // wav.channels}:{zlib.crc32(data):08x};pcm={len(pcm)}:{zlib.crc32(pcm):08x}"
        return f"{what.partition(';resampled=')[0]};resampled={of}", len(raw), zlib.crc32(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 21):
            n = len(inner)
            told = zip(*map(tell, batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())) if batch.num_rows else [[]] * 3
            columns = [pa.array(x, k) for x, k in zip(told, (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], [*inner, "feature", "pcm_bytes", "pcm_crc32"])

    schema = ", ".join(f"`{i}` {sound.schema[c].dataType.simpleString()}" for i, c in zip(inner, names))
    made = sound.select(*(F.col(c).alias(i) for i, c in zip(inner, names)), "feature", "pcm").mapInArrow(run, f"{schema}, feature string, pcm_bytes long, pcm_crc32 long")
    return made.select(*(F.col(i).alias(c) for i, c in zip(inner, names)), "feature", "pcm_bytes", "pcm_crc32")


def op9_audio(spark, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), None
    for k in range(ROUNDS):
        media = materialize(to_media(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k)), "media", "zstd")
        sound = materialize(from_media(media, ["doc_id", "n_bytes"]), "sound", "zstd")
        discard(media)
        part = materialize(heard(sound), "heard")
        discard(sound)
        out = part if out is None else out.unionByName(part)
    return out
