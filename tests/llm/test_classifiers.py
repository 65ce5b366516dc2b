import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.llm import learning as L, quality as Q, toxicity as X
from kinsift.llm.common import held_out

ROWS = [(1, None), (2, ""), (None, "text here"), (3, "same text"), (3, "same text"), (4, "word " * 20000)]
SCHEMA = "doc_id long, text string, score int, carried string, statistics int, y string"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "c", 2, "y") for r in rows], SCHEMA)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    p = (y == 1).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def measured(spark, sf, rows, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = rows.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    return auc(table.y.to_numpy(), table.score.to_numpy()), (table.y == table.predicted).mean()


def test_held_out(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first().h is False


def test_quality_on_held_out_rows(spark, medium):
    rows = Q.op3_quality(spark, medium).cache()
    assert rows.count() == spark.read.parquet(f"{medium}/documents.parquet").count()
    area, right = measured(spark, medium, rows, "quality")
    assert area > 0.98 and right > 0.96


def test_toxicity_on_held_out_rows(spark, medium):
    rows = X.op2_toxicity(spark, medium).cache()
    assert rows.count() == spark.read.parquet(f"{medium}/documents.parquet").count()
    area, right = measured(spark, medium, rows, "toxic")
    assert area > 0.8 and right > 0.9


def test_quality_query_end_to_end(spark, small):
    """The query's scores are those of its rules, told from whole texts one by one."""
    frame = spark.read.parquet(f"{small}/documents.parquet")
    model = Q.learn(frame, spark.read.parquet(f"{small}/labels.parquet"))
    got = {r.doc_id: r for r in Q.op3_quality(spark, small).collect()}
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert got.keys() == texts.keys() and 0 < len(model.rules) <= Q.RULES
    for i, text in texts.items():
        x = Q.statistics(text.encode())
        margin = model.intercept
        for rule, weight in zip(model.rules, model.weights):
            margin += weight * all((x[j] > limit) == above for j, above, limit in rule)
        want = 1 / (1 + math.exp(-margin))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity_query_end_to_end(spark, medium):
    """The query's scores are those of its lexicon and patterns, looked for in whole texts one by one."""
    frame = spark.read.parquet(f"{medium}/documents.parquet")
    model = X.learn(frame, spark.read.parquet(f"{medium}/labels.parquet"))
    got = {r.doc_id: r for r in X.op2_toxicity(spark, medium).collect()}
    assert got.keys() == {r.doc_id for r in frame.select("doc_id").collect()} and model.entries
    for r in frame.collect():
        words = {w for w in re.findall(r"[^\W\d_]+", r.text.lower())}
        margin = model.intercept
        for entry, weight in zip(model.entries, model.weights):
            name, least = entry.rstrip("$+"), 2 if entry.endswith("+") else 1
            if entry.endswith("$+"):
                holds = False  # a word is one of its own kind: it can't be there twice
            elif entry.endswith("$"):
                holds = name in words
            else:
                holds = sum(w.startswith(name) for w in words) >= least
            margin += weight * holds
        margin += sum(w for w, (_, p) in zip(model.weights[len(model.entries) :], X.PATTERNS) if p.search(r.text))
        assert abs(got[r.doc_id].score - L.sigmoid(margin)) < 1e-9 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_known_labels_are_no_targets():
    """A row whose label contradicts all its votes gets the posterior of its votes."""
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.3).astype(float)
    cast = np.stack([np.where(rng.random(4000) < 0.95, y, 1 - y).astype(np.int8) for _ in range(3)], axis=1)
    cast[:5], y[:5] = 1, 0
    _, posterior = X.label_model(cast, y)
    assert (posterior[:5] > 0.9).all()


def test_a_kept_column_gives_way_to_the_score(spark):
    out = X.score(docs(spark), X.Classifier([], np.zeros(len(X.PATTERNS)), 0.0), ["doc_id", "score", "y"])
    assert out.columns == ["doc_id", "y", "score"] and all(r.score == 0.5 for r in out.collect())


def test_compiled_rules_equal_plain_ones(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    x = np.array([Q.statistics(r.text.encode()) for r in texts])
    y = (x[:, Q.STATISTICS.index("symbols")] < 0.2).astype(float)
    model = Q.fit(x, y)
    assert model.rules and len(model.rules) <= Q.RULES and all(model.text())
    margin = model.intercept + sum(w * Q.fires(r, x) for r, w in zip(model.rules, model.weights))
    want = dict(zip((r.doc_id for r in texts), L.sigmoid(margin)))
    got = {r.carried: r.score for r in Q.score(spark.read.parquet(f"{small}/documents.parquet"), model, F.col("doc_id")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert ((L.sigmoid(margin) > 0.5) == y).mean() > 0.99


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 12)).astype(float)
    y = (rng.random(4000) < L.sigmoid(3 * x[:, 0] - 2 * x[:, 1])).astype(float)
    w, _ = L.lasso_logistic(x, y, 0.02)
    assert w[0] > 1 and w[1] < -0.5 and np.abs(w[2:]).max() < 0.1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = (rng.random(6000) < 0.2).astype(float)
    good, copy, bad = (np.where(rng.random(6000) < a, y, 1 - y).astype(np.int8) for a in (0.9, 0.9, 0.6))
    copy = good.copy()  # says the same as the first
    third = np.where(rng.random(6000) < 0.85, y, 1 - y).astype(np.int8)
    known = np.where(rng.random(6000) < 0.3, y, np.nan)
    cast = np.stack([good, copy, bad, third], axis=1)
    model, posterior = L_and_posterior = X.label_model(cast, known)
    assert len(L_and_posterior) == 2
    accuracy = model.tables[:, 1, 1]
    assert accuracy[0] > accuracy[2] and abs(accuracy[3] - 0.85) < 0.1
    assert model.say[0] < 0.75 and model.say[3] > 0.75  # two voters that agree beyond the label count less
    unknown = np.isnan(known)
    assert ((posterior[unknown] > 0.5) == y[unknown]).mean() > 0.88


@pytest.mark.parametrize("labels,side", [([], None), ([(3, 1, 0)], 1), ([(3, 0, 1)], 0)])
def test_one_sided_labels(spark, labels, side):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.learn(docs(spark), table)
    scores = [r.score for r in Q.score(docs(spark), model, F.col("doc_id")).collect()]
    assert len(scores) == len(ROWS) and all((s > 0.5) == (side == 1) for s in scores if side is not None)
    toxic = X.score(docs(spark), X.learn(docs(spark), table), ["doc_id"])
    assert toxic.count() == len(ROWS) and all(0 <= r.score <= 1 for r in toxic.collect())


def test_rows_stay_rows(spark):
    table = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 5)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    kept = Q.keep_good(docs(spark), table, threshold=0.0)
    assert kept.schema == docs(spark).schema and kept.count() == len(ROWS)
    assert Q.keep_good(docs(spark).limit(0), table).count() == 0
    assert X.score(docs(spark).limit(0), X.learn(docs(spark), table), ["doc_id"]).count() == 0


def test_repeated_labels_and_ids(spark):
    table = spark.createDataFrame([(3, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = L.sample(docs(spark), table, "quality", 10).collect()
    assert [(r.id, r.text, r.y) for r in rows if r.id == 3] in ([(3, "same text", 1)], [])  # [] if 3 is held out
