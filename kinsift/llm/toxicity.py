"""Toxicity by weak supervision.

Voters. A bounded sample of labelled rows yields a lexicon: words, beginnings of words of 3 to 8
letters, and such beginnings of two words or more of one text, that occur in far more toxic texts than chance allows (a likelihood ratio test, with as many
tries as there are candidates). Entries of one length and strength form one lexicon voter, which votes
`toxic` where an entry occurs and abstains elsewhere; others vote `not toxic` where nothing of a strength
occurs. Pattern voters look at the text's form: direct address with an insult's shape, shouting,
masked words, piled exclamation marks.

Label model. Every voter has a table of how it votes for toxic and for other texts. The tables and the
posterior of each text are estimated together by expectation maximization over the sample: known labels
say which table a row's votes count for, posteriors say it for rows without one. Voters aren't
independent: what their votes have in common beyond the label is measured as the correlation of their
residuals, and a voter's say is divided by the sum of its correlations, so that a clique of voters counts
about once.

Classifier. A linear classifier (logistic regression on lexicon entries and patterns) is trained on the
posteriors of all rows of the sample, whether their labels are known or not, and scores every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.common import beside, held_out, pieces, read
from kinsift.llm.learning import sample, sigmoid, sparse_logistic
from kinsift.storage import materialize

#: Labelled rows that are learned from, at the most.
LABELLED = 20_000
BEGINNINGS = range(3, 9)
LEAST_TEXTS = 3
#: Bounds of the voters' strengths: log odds of an entry.
STRENGTHS = (2.0, 3.0, 4.0, 5.0)
ROUNDS = 30

WORD = re.compile(r"[^\W\d_]+")
#: Patterns, each with lower-case strings of which a text has to hold one for the pattern to be looked for.
PATTERNS = (
    (("you",), re.compile(r"\byou(?:'re| are)? (?:such )?(?:a|an) \w+", re.IGNORECASE)),
    (("shut up", "go away", "get lost", "hate you", "i hate"), re.compile(r"\b(?:shut up|go away|get lost|hate you|i hate)\b", re.IGNORECASE)),
    (("**", "@@", "##", "$$", "*@", "*#", "*$", "@*", "#*", "$*", "@#", "#@", "@$", "$@", "#$", "$#"), re.compile(r"\b\w+[*@#$]{2,}\w*\b")),
    (("!!",), re.compile(r"!{2,}")),
    (("",), re.compile(r"\b[A-ZÀ-Ý]{4,}(?: [A-ZÀ-Ý]{2,}){2,}")),
    (("",), re.compile(r"(.)\1{4,}")),
)


def candidates(word: str) -> list[str]:
    """A word's names in the lexicon: itself with an end mark, and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def occurring(text: str | None) -> set[str]:
    """All names that occur in a text; beginnings of two or more of its words also with a plus sign."""
    count = Counter(c for w in set(WORD.findall((text or "").lower())) for c in candidates(w))
    return count.keys() | {f"{c}+" for c, n in count.items() if n > 1}


def mine(rows: DataFrame) -> list[tuple[str, float]]:
    """(entry, log odds) of the lexicon, strongest evidence first. rows: a bounded sample (text, y); those without y don't count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by[y].update(occurring(text))
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([x[c] for c in names], pa.int64()) for x in (by[1], by[0]))], ["entry", "p", "n"])

    known = rows.where("y IS NOT NULL")
    toxic, other = (known.agg(F.coalesce(F.sum(F.col("y")), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)))).first()
    if not toxic or not other:
        return []
    counted = known.select("text", "y").mapInArrow(count, "entry string, p long, n long").groupBy("entry").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") + 0.5) / (other + 1.0))
    share = (F.col("p") + F.col("n")) / float(toxic + other)
    log = lambda k, size: F.when(k > 0, k * F.log(k / (share * size))).otherwise(0.0)
    ratio = 2 * (log(F.col("p"), float(toxic)) + log(F.col("n"), float(other)))
    strong = counted.where(F.col("p") >= LEAST_TEXTS).withColumn("odds", odds).withColumn("ratio", ratio).where(F.col("odds") > STRENGTHS[0])
    strong = materialize(strong, "entries")
    tries = max(strong.count(), 100)
    found = strong.where(F.col("ratio") > 2 * math.log(tries)).select("entry", "odds", "ratio").collect()
    return [(r.entry, r.odds) for r in sorted(found, key=lambda r: (-r.ratio, r.entry))]


class Hits:
    """Finds a lexicon's entries and the patterns in texts; columns are the entries first, then the patterns."""

    def __init__(self, entries: list[str]) -> None:
        names = sorted({e.removesuffix("+") for e in entries})
        self.index = {n: i for i, n in enumerate(names)}
        place = {e: i for i, e in enumerate(entries)}
        self.once, self.twice = ([place.get(n + sign, -1) for n in names] for sign in ("", "+"))
        self.base = len(entries)
        self.of = lru_cache(maxsize=1 << 18)(self._of)

    def _of(self, word: str) -> tuple[int, ...]:
        return tuple(self.index[c] for c in candidates(word) if c in self.index)

    def __call__(self, text: str | None) -> set[int]:
        text = text or ""
        low = text.lower()
        count = Counter(chain.from_iterable(map(self.of, set(WORD.findall(low)))))
        found = {self.once[i] for i in count} | {self.twice[i] for i, n in count.items() if n > 1}
        found.discard(-1)
        found.update(self.base + i for i, (needles, p) in enumerate(PATTERNS) if any(map(low.__contains__, needles)) and p.search(text))
        return found


def votes(hits: list[list[int]], entries: list[tuple[str, float]]) -> np.ndarray:
    """A row of votes for each text: 1 toxic, 0 other, 2 abstains."""
    band = np.array([sum(o > s for s in STRENGTHS[1:]) for _, o in entries], int)
    kind = np.array([0 if e.endswith("$") else 1 if e.endswith("+") else len(e) for e, _ in entries], int)
    kinds, bands, m = [0, 1, *BEGINNINGS], len(STRENGTHS), len(entries)
    group = {(k, b): i for i, (k, b) in enumerate((k, b) for k in kinds for b in range(bands))}
    first = len(group)
    out = np.full((len(hits), first + bands + len(PATTERNS)), 2, np.int8)
    out[:, first : first + bands] = 0
    for i, own in enumerate(hits):
        for j in own:
            if j < m:
                out[i, group[kind[j], band[j]]] = 1
                out[i, first : first + band[j] + 1] = 2  # something of at least that strength occurs
            else:
                out[i, first + bands + j - m] = 1
    return out


class LabelModel(NamedTuple):
    tables: np.ndarray  # voter, label, vote: probabilities
    say: np.ndarray  # of each voter
    prior: float

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        at = np.arange(cast.shape[1])
        evidence = np.log(self.tables[at, 1, cast]) - np.log(self.tables[at, 0, cast])
        return sigmoid(np.log(self.prior / (1 - self.prior)) + evidence @ self.say)


def label_model(cast: np.ndarray, y: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """The model of votes, and every row's posterior. y: 1, 0, or NaN where the label isn't known.

    Labels only say which of a voter's two tables a row counts for; the posterior is the votes' alone.
    """
    known = ~np.isnan(y)
    prior = float(np.clip(y[known].mean() if known.any() else 0.1, 0.01, 0.99))
    one_hot = np.stack([cast == v for v in range(3)], axis=2).astype(float)
    guess = np.clip(prior + 0.3 * ((cast == 1).sum(1) > 0) - 0.05, 0.02, 0.98)
    model, posterior = LabelModel(np.full((cast.shape[1], 2, 3), 1 / 3), np.ones(cast.shape[1]), prior), guess
    for _ in range(ROUNDS):
        q = np.where(known, np.nan_to_num(y), posterior)
        weight = np.stack([1 - q, q])
        tables = np.einsum("yi,ijv->jyv", weight, one_hot) + 0.5
        tables /= tables.sum(axis=2, keepdims=True)
        expected = np.einsum("yi,jyv->ijv", weight, tables)
        residual = one_hot[:, :, 1] - expected[:, :, 1]
        spread = np.maximum(np.sqrt((residual**2).mean(axis=0)), 1e-6)
        shared = np.abs(residual.T @ residual / len(cast) / spread / spread[:, None])
        say = 1 / np.maximum(np.where(shared > 0.1, np.minimum(shared, 1), 0).sum(axis=1), 1)
        model = LabelModel(tables, say, prior)
        new = model.posterior(cast)
        settled = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if settled:
            break
    return model, posterior


class Classifier(NamedTuple):
    entries: list[str]
    weights: np.ndarray
    intercept: float


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED) -> Classifier:
    """A classifier from at most `labelled` labelled rows, none of them held out. Without labels of both kinds: a score of 0.05 or 0.95 for all.

    Repeated ids count once, with the larger label; null ids and other labels than 0 and 1 don't count.
    """
    rows = sample(docs, labels, label, labelled)
    lexicon = mine(rows)
    entries = [e for e, _ in lexicon]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(entries)
        for batch in pieces(batches):
            found = [sorted(hits(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "hits"])

    kind = rows.schema["id"].dataType.simpleString()
    table = rows.select("id", "y", "text").mapInArrow(find, f"id {kind}, y int, hits array<int>").orderBy("id").toArrow()
    y = np.array([np.nan if v is None else v for v in table["y"].to_pylist()], float)
    known = y[~np.isnan(y)]
    if not len(known) or known.min() == known.max():
        return Classifier([], np.zeros(len(PATTERNS)), 3.0 if len(known) and known.max() else -3.0)
    hits = table["hits"].to_pylist()
    _, posterior = label_model(votes(hits, lexicon), y)
    at = np.repeat(np.arange(len(hits)), [len(x) for x in hits])
    column = np.array([j for x in hits for j in x], int)
    m = len(entries) + len(PATTERNS)
    w, b = sparse_logistic(at, column, len(hits), m, posterior)
    return Classifier(entries, w, b)


def score(docs: DataFrame, model: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and `score` (0 to 1) for every row of docs.

    Null and empty texts have no words and the score of the intercept. Null and repeated ids and repeated
    rows stay rows; an empty table gives an empty result. Only the named columns are looked at; a column
    of `keep` with the name score gives way to the score.
    """
    entries, weights, intercept = model
    keep = beside(keep, ["score"])
    inner = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(entries)
        for batch in pieces(batches):
            raw = np.array([intercept + sum(map(weights.__getitem__, sorted(hits(x)))) for x in batch.column(len(inner)).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], pa.array(sigmoid(raw))], [*inner, "score"])

    schema = ", ".join([f"{i} {docs.schema[c].dataType.simpleString()}" for i, c in zip(inner, keep)] + ["score double"])
    rows = docs.select(*(F.col(c).alias(i) for i, c in zip(inner, keep)), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, schema).select(*(F.col(i).alias(c) for i, c in zip(inner, keep)), "score")


def op2_toxicity(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
