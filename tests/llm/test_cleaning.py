import re

import pytest

from kinsift.llm import cleaning as C


def plain(text):
    """The base figures, counted the slow way."""
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(repeated),
        "base_failed": n < 20 or 100 * len(repeated) > 30 * n,
    }


TEXTS = [
    None, "", " \n \n", "one", "a b c d e f g h a b c d e f g h", "x " * 100, "Same line.\nSame line.\nsame line.\n \nSame line.",
    "Ä ö ü # * $ % & | < > \x1c z", "a b c d e f g h i " * 3 + "j k l m n o p", "w1 w2 w3 w4 w5 w6 w7 " * 2,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    found = C.assess(None if text is None else text.encode())
    assert {k: found[k] for k in plain(text)} == plain(text)


def test_query_brute(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = C.op7_quality_rules(spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        if len(texts[r.doc_id]) < 5000:
            assert {k: r[k] for k in plain("")} == plain(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


OTHER = "Another line, which shares no run of words with the first one, ends properly as well and is long enough to count."
GOOD = "This is a plain sentence of several words that ends as it should, like most of them do."


@pytest.mark.parametrize(
    "line,rule",
    [
        (GOOD, None), (GOOD[:-1] + '."', None), ("A short title", None), ("Home | News | Sports | Contact | About us", "navigation"), ("Start » Shop » Shoes", "navigation"),
        ("we had a long walk in the park and then", "punctuation"), ("one### two&&& three$$$ four%%%", "punctuation"), ("Click here to read more.", "boilerplate"),
        ("© 2020 Someone. All rights reserved.", "boilerplate"), ("First it ended. then it went on without an end", None),
    ],
)
def test_lines(line, rule):
    assert C.line_failure(line, len(line.encode().split())) == rule


def test_lines_are_removed_before_documents_are_judged():
    menu = "Home | News | Sports | Contact"
    text = "\n".join([menu, GOOD, OTHER, "", menu])
    found = C.assess(text.encode())
    assert found["kept"] and found["navigation_lines"] == 2
    assert found["cleaned"].decode() == "\n".join([GOOD, OTHER, ""])
    lost = C.assess("\n".join([f"a{i} | b{i} | c{i} | d{i}" for i in range(20)] + [GOOD]).encode())
    assert not lost["base_failed"] and not lost["kept"]


def test_clean_documents_stay(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet").where("quality = 1")
    rows = C.op7_quality_rules(spark, medium).join(labels, "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept for r in rows) / len(rows) > 0.99


def test_odd_rows(spark):
    rows = [(1, None), (None, f"{GOOD} {OTHER}"), (2, f"{OTHER} {GOOD}"), (2, f"{OTHER} {GOOD}"), (3, "word. " * 50000), (4, "")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, kept int, n_words string")
    out = C.clean(frame)
    assert out.count() == 6 and C.clean(frame.limit(0)).count() == 0
    assert {r.doc_id for r in out.where("kept").collect()} == {None, 2}
