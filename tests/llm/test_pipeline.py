"""run() against a plain version of each stage on the smallest tables."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from kinsift.llm import bpe, quality
from kinsift.storage import materialize
from test_simhash import plain_classes, plain_fingerprint


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        held[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and docs.count()
    original = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}

    model = quality.learn(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r.carried: r.score for r in quality.score(spark.read.parquet(f"{small}/documents.parquet"), model, F.col("doc_id")).collect()}
    good = {i for i, s in scores.items() if s >= 0.7}
    assert {r.doc_id for r in held["quality_classifier"].collect()} == good

    pairs = [(i, plain_fingerprint(original[i].text)) for i in sorted(good)]
    first = set(plain_classes(pairs))
    kept = held["simhash_near_dedup"].collect()
    assert sorted(r.doc_id for r in kept) == sorted(first) and all(r.text == original[r.doc_id].text for r in kept)

    seen: set[tuple] = set()
    for r in sorted(held["substring_dedup"].collect(), key=lambda r: r.doc_id):
        words = r.text.encode().lower().split()
        own = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        assert not own & seen and r.n_chars == len(r.text)
        seen |= own

    sizes = {r.doc_id: len(r.text.encode().split()) for r in held["substring_dedup"].collect()}
    times: dict[int, int] = {}
    for r in held["mix_sources"].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2 and abs(sum(sizes[i] * n for i, n in times.items()) / (1.5 * sum(sizes.values())) - 1) < 0.05

    theirs = Tokenizer.from_file(bpe.vocabulary())
    texts = {r.doc_id: r.text for r in held["mix_sources"].collect()}
    out = held["encode_bpe"].collect()
    assert len(out) == sum(times.values())
    for r in out:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(P.run(spark, small).collect()) == sorted(out)


def test_stages_take_odd_rows(spark, small):
    rows = [(1, None, "en", "a", None), (None, "x y z", None, None, 5), (2, "", "en", "a", 0), (2, "one two three four", "en", "a", 18), (2, "one two three four", "en", "a", 18)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (frame, frame.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, small)
            assert out.count() <= 2 * docs.count()
            if name != P.STAGES[-1][0]:
                assert out.schema.simpleString() == docs.schema.simpleString()
