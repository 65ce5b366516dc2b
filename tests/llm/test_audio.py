import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm import audio as A


def plain_mulaw(code):
    """Expansion as the standard's segments say it."""
    code = ~code & 255
    sign, exponent, mantissa = code >> 7, code >> 4 & 7, code & 15
    size = (mantissa * 2 + 33) * 2**exponent - 33  # in 14 bits
    return (-size if sign else size) * 4


def plain_alaw(code):
    code ^= 0x55
    sign, exponent, mantissa = code >> 7, code >> 4 & 7, code & 15
    size = mantissa * 2 + 1 if exponent == 0 else (mantissa * 2 + 33) * 2 ** (exponent - 1)  # in 13 bits
    return (size if sign else -size) * 8


def test_tables():
    assert [int(x) for x in A.TABLES[A.MULAW]] == [plain_mulaw(c) for c in range(256)]
    assert [int(x) for x in A.TABLES[A.ALAW]] == [plain_alaw(c) for c in range(256)]
    assert (len(A.STEPS), A.STEPS[0], A.STEPS[88]) == (89, 7, 32767)


def plain_adpcm(data, block, channels):
    """One sample after another."""
    out = []
    per = A.samples_per_block(block, channels)
    for k in range(len(data) // block):
        part = data[k * block : (k + 1) * block]
        tracks = []
        for c in range(channels):
            value, index = struct.unpack_from("<hB", part, 4 * c)
            index = min(index, 88)
            track = [value]
            body = part[4 * channels :]
            codes = []
            for word in range((per - 1) // 8):
                at = (word * channels + c) * 4
                for byte in body[at : at + 4]:
                    codes += [byte & 15, byte >> 4]
            for code in codes:
                step = int(A.STEPS[index])
                change = step >> 3
                if code & 4:
                    change += step
                if code & 2:
                    change += step >> 1
                if code & 1:
                    change += step >> 2
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(A.INDEX_STEP[code])))
                track.append(value)
            tracks.append(track)
        out += list(zip(*tracks))
    return out


@pytest.mark.parametrize("block,channels,blocks", [(36, 1, 5), (256, 1, 3), (72, 2, 4), (512, 2, 1), (36, 1, 0)])
def test_adpcm_brute(block, channels, blocks):
    data = np.random.default_rng(block).integers(0, 256, block * blocks, dtype=np.uint8).tobytes()
    got = A.decode_adpcm(data + b"cut off", block, channels)
    assert [tuple(map(int, x)) for x in got] == plain_adpcm(data, block, channels)


@pytest.mark.parametrize("tag,channels,data", [(A.MULAW, 1, bytes(range(256))), (A.ALAW, 2, bytes(range(10))), (A.PCM, 1, b"\1\0\2\0"), (A.IMA_ADPCM, 1, bytes(72)), (A.MULAW, 1, b"odd")])
def test_wav_round_trip(tag, channels, data):
    raw = A.write_wav(tag, data, channels, block=36 if tag == A.IMA_ADPCM else None)
    back = A.read_wav(raw)
    assert (back.tag, back.channels, back.rate, back.data) == (tag, channels, A.RATE, data)
    assert struct.unpack_from("<I", raw, 4)[0] == len(raw) - 8 and len(raw) % 2 == 0


@pytest.mark.parametrize("raw", [b"", b"RIFF", A.write_wav(A.MULAW, b"abcd")[:-2], b"RIFF\0\0\0\0WAVEdata\1\0\0\0x", b"RIFF\0\0\0\0WAVEfmt \4\0\0\0abcd"])
def test_broken_wav(raw):
    with pytest.raises(ValueError):
        A.read_wav(raw)


def test_resample():
    x = np.array([[0], [100], [-100]], np.int16)
    assert A.resample(x, 8000, 16000).ravel().tolist() == [0, 50, 100, 0, -100, -100]
    assert A.resample(x, 16000, 8000).ravel().tolist() == [0]
    assert A.resample(x, 8000, 8000) is x and len(A.resample(x[:0], 1, 2)) == 0


def plain_feature(raw, rate):
    """The feature of a file, sample by sample."""
    wav = A.read_wav(raw)
    if wav.tag == A.IMA_ADPCM:
        x = [v for (v,) in plain_adpcm(wav.data, wav.block, 1)]
    else:
        x = [(plain_mulaw if wav.tag == A.MULAW else plain_alaw)(c) for c in wav.data]
    step = A.RATE // rate
    y = x[::step][: len(x) * rate // A.RATE]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    sound = struct.pack(f"<{len(y)}h", *y)
    pcm = A.write_wav(A.PCM, sound, 1, rate)
    what = f"format={A.FORMATS[wav.tag]};frames={len(x)};peak={max(map(abs, x))};energy={sum(v * v for v in x)};crossings={crossings}"
    return f"{what};resampled={len(y)}:{zlib.crc32(sound):08x};pcm={len(pcm)}:{zlib.crc32(pcm):08x}"


def test_query(spark, small):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = A.op9_audio(spark, small).collect()
    assert len(rows) == len(texts)
    formats = set()
    for r in rows:
        full = A.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(full)) and len(full) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-32:])
        tag = list(A.FORMATS)[zlib.crc32(full) % 3]
        media = A.write_wav(tag, full, block=36 if tag == A.IMA_ADPCM else None)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == plain_feature(media, A.QUERY_RATE)
        formats.add(tag)
    assert formats == {A.MULAW, A.ALAW, A.IMA_ADPCM}


def test_columns_that_clash_give_way(spark):
    rows = A.to_media(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).withColumn("Feature", F.lit(1)).withColumn("pcm", F.lit("x"))
    out = A.from_media(rows, ["doc_id", "Feature", "pcm"])
    assert out.columns == ["doc_id", *A.DECODED] and out.first().payload_bytes == 576
    assert A.from_media(rows, []).first().media_bytes > 576


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "é"), (2, "é"), (3, "x" * 576), (4, "y" * 200_000)]
    frame = spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")
    out = A.from_media(A.to_media(frame), ["doc_id", "n_bytes"]).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in out) == [(0, 576), (0, 576), (2, 576), (2, 576), (576, 576), (200_000, 200_448)]
    assert all(r.error is None and A.read_wav(bytes(r.pcm)).rate == A.TO_RATE for r in out)
    assert A.from_media(A.to_media(frame.limit(0)), ["doc_id"]).count() == 0
    bad = A.from_media(spark.createDataFrame([(1, b"no"), (2, None)], "id long, media binary"), ["id"]).collect()
    assert all(r.error and r.payload_bytes is None for r in bad)


def test_the_query_stores_the_full_rate(spark, small):
    """Every text's PCM holds all that the operator makes of it by default, and is what the query heard again."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = {r.doc_id: r for r in A.from_media(A.to_media(docs), ["doc_id"]).collect()}
    rows = A.op9_audio(spark, small).collect()
    assert len(rows) == len(whole) and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        pcm = bytes(whole[r.doc_id].pcm)
        assert A.read_wav(pcm).rate == A.TO_RATE and (r.pcm_bytes, r.pcm_crc32) == (len(pcm), zlib.crc32(pcm))


def test_sound_that_was_not_stored(spark):
    sound = A.from_media(spark.createDataFrame([(1, b"no"), (None, A.stored(A.padded(b"x")))], "doc_id long, media binary"), ["doc_id"])
    assert [(r.doc_id, r.feature is None, r.pcm_bytes is None) for r in A.heard(sound).orderBy("doc_id").collect()] == [(None, False, False), (1, True, True)]
