"""Line-first cleaning of texts.

Rules look at one line at a time and remove those that fail: lines that don't end like a sentence
(punctuation), menus and link bars (navigation), and phrases of page furniture (boilerplate). Then the
document is looked at: it is rejected where it has lost too large a part of its words, or fails the base
rules, which count words and repetitions over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.common import WORD, pieces, read, texts

WINDOW = 8
#: Base rules: fewer words than this, or more than this share of words (percent) in repeated windows, fails.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Share of its words that a document may lose to the line rules.
MOST_LOST = 0.5
#: A line counts as a menu with so many separators per word, or as decoration with so many symbols per word.
MENU, DECORATED = 0.3, 0.5
#: A line without an end of sentence at its end may have one within for each so many words instead.
SENTENCE_WORDS = 40
#: Lines of at most so many words may lack an end of sentence (titles).
TITLE_WORDS = 8

# Signs and phrases, in a form that Python and SQL read alike.
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»«›‹•·>]"
TAIL = r"""[\x20\x09-\x0D"')\]”’»“」]+$"""
ENDED = "[.!?:;…。！？؟।]$"
INNER_END = r"[.!?…][\x20\x09-\x0D]|[。！？]"
PHRASES = (
    r"(?i)\b(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie (?:policy|settings)|accept (?:all )?cookies|we use cookies"
    r"|enable javascript|javascript is (?:disabled|required)|skip to (?:main )?content|click here|read more|sign (?:in|up)|log ?in"
    r"|subscribe to our newsletter|share (?:this|on)|back to top|lorem ipsum|page not found)\b"
)
#: Words that one phrase of page furniture may have around it on its line.
PHRASE_WORDS = 12

_symbols, _separators, _tail, _ended, _inner, _phrases = (re.compile(x, re.ASCII) for x in (SYMBOLS, SEPARATORS, TAIL, ENDED, INNER_END, PHRASES))


def line_failure(line: str, n_words: int) -> str | None:
    """The rule that a line with n_words words (at least one) fails, or None."""
    if len(_separators.findall(line)) >= max(2, MENU * n_words):
        return "navigation"
    if len(_symbols.findall(line)) > DECORATED * n_words:
        return "punctuation"
    if n_words > TITLE_WORDS and not _ended.search(_tail.sub("", line)) and len(_inner.findall(line)) * SENTENCE_WORDS < n_words:
        return "punctuation"
    phrases = len(_phrases.findall(line))
    if phrases and n_words <= PHRASE_WORDS * phrases:
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of `WINDOW` words found twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # Windows are compared by rank: pairs of words, then pairs of pairs, and so on, which is exact.
    size = 1
    while size < WINDOW:
        pair = number[:-size] * (int(number.max()) + 1) + number[size:]
        number = np.unique(pair, return_inverse=True)[1]
        size *= 2
    often = np.bincount(number)[number] > 1
    if not often.any():
        return 0
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(mark[:-1])))


def assess(text: bytes | None) -> dict:
    """All counts of a text, its verdict and the lines that stay. A null text is one without words."""
    raw = text or b""
    words = raw.split()
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    n_dup, lost, stay, failures = 0, 0, [], Counter()
    for line in lines:
        own = len(line.split())
        if not own:
            stay.append(line)
            continue
        if line in seen:
            n_dup += 1
        else:
            seen.add(line)
        failure = line_failure(line.decode("utf-8", "replace"), own)
        if failure:
            failures[failure] += 1
            lost += own
        else:
            stay.append(line)
    repeated = repeated_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode("utf-8", "replace")) for w in words) if not raw.isascii() else sum(map(len, words)),
        "n_symbols": sum(raw.count(x) for x in SYMBOLS[1:-1].encode()),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "n_lost_words": lost,
        "navigation_lines": failures["navigation"],
        "punctuation_lines": failures["punctuation"],
        "boilerplate_lines": failures["boilerplate"],
        "kept": not base_failed and lost <= MOST_LOST * len(words),
        "cleaned": b"\n".join(stay),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "navigation_lines", "punctuation_lines", "boilerplate_lines"]


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id_col, the counts, base_failed, kept, cleaned) for every row of docs.

    cleaned is the text without the lines that failed (null where with_text is false). Null and empty
    texts have no words, so they fail the base rules. Null and repeated ids and repeated rows stay rows.
    An empty table gives an empty result. Only the two named columns are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [assess(x) for x in texts(batch.column(1))]
            arrays = [pa.array([x[c] for x in found], pa.int64()) for c in COUNTS]
            arrays += [pa.array([x[c] for x in found], pa.bool_()) for c in ("base_failed", "kept")]
            arrays.append(pa.array([x["cleaned"] if with_text else None for x in found], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *COUNTS, "base_failed", "kept", "cleaned"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, cleaned string"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = clean(read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_quoted(pattern)}))"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_quoted(WORD)}) AS words FROM documents),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
counted AS (
  SELECT doc_id, line, {_count("line", WORD)} AS n, {_count("line", SEPARATORS)} AS bars, {_count("line", SYMBOLS)} AS symbols,
    regexp_matches(regexp_replace(line, {_quoted(TAIL)}, ''), {_quoted(ENDED)}) AS ended, {_count("line", INNER_END)} AS ends, {_count("line", PHRASES)} AS phrases
  FROM line WHERE regexp_matches(line, {_quoted(WORD)})
),
judged AS (
  SELECT *, bars >= greatest(2, {MENU}::DOUBLE * n) OR symbols > {DECORATED}::DOUBLE * n OR (n > {TITLE_WORDS} AND NOT ended AND ends * {SENTENCE_WORDS} < n)
    OR (phrases > 0 AND n <= {PHRASE_WORDS} * phrases) AS failed FROM counted
),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN failed THEN n ELSE 0 END) AS n_lost_words FROM judged GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)
),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM often) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(w) FOR w IN words]), 0) AS BIGINT) AS word_chars,
    CAST({_count("text", SYMBOLS)} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND n_lost_words <= {MOST_LOST}::DOUBLE * n_words AS kept
FROM base
"""
