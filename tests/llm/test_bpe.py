import hashlib
import random
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinsift.llm import bpe as B


@pytest.fixture(scope="module")
def both():
    return B.load(B.vocabulary()), Tokenizer.from_file(B.vocabulary())


def check(both, texts):
    mine, theirs = both
    ids, n = mine.encode(texts)
    ends = np.append(0, np.cumsum(n))
    decoded = mine.decode(ids, n)
    for k, (text, e) in enumerate(zip(texts, theirs.encode_batch(texts, add_special_tokens=False))):
        assert ids[ends[k] : ends[k + 1]].tolist() == e.ids, text
        assert decoded[k].decode() == theirs.decode(e.ids, skip_special_tokens=False), text


def test_special_cases(both):
    check(both, [
        "", "   ", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ", "École Å", "it's WE'LL 'S I'M", "a" * 50, "123 ４５６ ½", "\x1ca\x1d\x85b c᠎d﻿e​f",
        "日本語 🎉👨‍👩", "x" * 5000, "!?" * 3000, "ﬁ ŉ ẞ ſ", "ab" * 400 + " " + "abc" * 300,
    ])


def test_fuzz(both):
    rng = random.Random(1)
    letters = "abcdefgh'stREvemLLd 1 2éÉΣσ!?#<|>\n\t "
    check(both, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)])


def test_every_character(both):
    check(both, [f"a{chr(c)}B" for c in range(1, sys.maxunicode + 1, 7) if not 0xD800 <= c < 0xE000])
    check(both, [f"a{chr(c)}B" for low, high in B.LATER for c in {low, high}] + [f"x{chr(c)}" for c in B.LOWER])


def test_documents(both, spark, small):
    check(both, [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_memory_is_bounded(both, monkeypatch):
    monkeypatch.setattr(B, "WORDS", 50)
    mine = B.Bpe(B.vocabulary())
    for i in range(5):
        check((mine, both[1]), [" ".join(f"word{j}x" for j in range(i * 20, i * 20 + 20))])
        assert len(mine.index) < 100


def test_query(spark, small):
    theirs = Tokenizer.from_file(B.vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in B.op10_bpe(spark, small).collect():
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    path = B.vocabulary()
    rows = [(1, None), (None, ""), (2, "two words"), (2, "two words"), (3, "long text " * 20000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    ids = B.encode(frame, path)
    assert sorted(len(r.ids) for r in ids.collect()) == [0, 0, 2, 2, 40000]
    assert sorted(r.text for r in B.decode(ids, path).collect())[:2] == ["", ""]
    assert [r.n_tokens for r in B.round_trip(frame, path, with_ids=True).orderBy("n_tokens").collect()] == [0, 0, 2, 2, 40000]
    assert B.encode(frame.limit(0), path).count() == 0 and B.round_trip(frame.limit(0), path).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        B.Bpe(B.vocabulary("byte_bpe_50k.json"))
