"""Quality classifier by a sparse ensemble of rules over statistics of a text.

Statistics of the whole text are computed per document. Boosted trees of depth 3 are grown on them for a
bounded sample of labelled rows; every path from a root to one of its nodes is a conjunctive rule. A
logistic regression with an L1 penalty weighs the rules and drops most. What is left is compiled into
one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kinsift.llm.cleaning import repeated_words
from kinsift.llm.common import held_out, pieces, read, texts
from kinsift.llm.learning import lasso_logistic, sample, sigmoid

#: Labelled rows that the rules are learned from, at the most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 40, 3, 48, 0.3, 8
#: The L1 penalty's first weight; how many rules an ensemble may have to be sparse. The penalty is raised until it is.
STRENGTH, RULES = 2e-3, 120

STATISTICS = [
    "log_words", "log_bytes", "word_bytes", "distinct_words", "top_word", "repeated_windows", "repeated_neighbours", "symbols", "pipes", "exclamations",
    "double_exclamations", "upper", "digits", "stops", "commas", "wide", "log_lines", "line_words", "ended_lines", "repeated_lines", "short_lines",
    "brackets", "at_signs", "slashes", "symbol_words",
]

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_WIDE = bytes(range(128, 256))
_SYMBOLS = b"#*$%&<>^~_=+"


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; of a text without words (null, empty) they are 0."""
    raw = text or b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    lines = [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    counts = Counter(words)
    letters = sum(map(len, words))
    symbols = size - len(raw.translate(None, _SYMBOLS))
    return [
        math.log(n),
        math.log(size),
        letters / n,
        len(counts) / n,
        max(counts.values()) / n,
        repeated_words(words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        symbols / n,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        raw.count(b"!!") / n,
        (size - len(raw.translate(None, _UPPER))) / letters,
        (size - len(raw.translate(None, _DIGITS))) / letters,
        raw.count(b".") / n,
        raw.count(b",") / n,
        (size - len(raw.translate(None, _WIDE))) / letters,
        math.log(len(lines)),
        n / len(lines),
        sum(x.endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(x.count(b" ") < 3 for x in lines) / len(lines),
        (raw.count(b"(") + raw.count(b"[") + raw.count(b"{")) / n,
        raw.count(b"@") / n,
        raw.count(b"/") / n,
        sum(1 for w in words if w[-1:] in b"#*$%&|<>!") / n,
    ]


def with_statistics(docs: DataFrame, carried: Column, text_col: str = "text") -> DataFrame:
    """(carried, statistics array<double>) for every row of docs."""
    rows = docs.select(carried.alias("carried"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = np.array([statistics(x) for x in texts(batch.column(1))], float).ravel()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64()))], ["carried", "statistics"])

    schema = T.StructType([rows.schema["carried"], T.StructField("statistics", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


#: (statistic, above, threshold): above means >, else <=.
Condition = tuple[int, bool, float]


class Rules(NamedTuple):
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The score as an expression over the column `statistics`."""
        of = lambda j: F.col("statistics")[j]
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for j, above, limit in rule:
                holds &= of(j) > limit if above else of(j) <= limit
            total += F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def text(self) -> list[str]:
        """The rules to read, heaviest first."""
        say = lambda rule: " and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {limit:.4g}" for j, above, limit in rule)
        return [f"{w:+.3f} if {say(r)}" for r, w in sorted(zip(self.rules, self.weights), key=lambda x: -abs(x[1]))]


def grow(bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray) -> set[tuple[Condition, ...]]:
    """The rules of boosted trees. bins: the number of each value's bin among a statistic's edges."""
    n, m = bins.shape
    margin = np.full(n, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    rules: set[tuple[Condition, ...]] = set()
    for _ in range(TREES):
        p = sigmoid(margin)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[np.ndarray, tuple[Condition, ...]]] = [(np.arange(n), ())]
        for _ in range(DEPTH):
            below = []
            for rows, path in nodes:
                best, at = 1e-3, None
                for j in range(m):
                    own = bins[rows, j]
                    gs, hs = np.bincount(own, g[rows], BINS).cumsum(), np.bincount(own, h[rows], BINS).cumsum()
                    ns = np.bincount(own, minlength=BINS).cumsum()
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    gain[(ns < LEAST_ROWS) | (ns[-1] - ns < LEAST_ROWS)] = 0
                    k = int(np.argmax(gain[: len(edges[j])])) if len(edges[j]) else 0
                    if len(edges[j]) and gain[k] > best:
                        best, at = float(gain[k]), (j, k)
                if at is None:
                    margin[rows] -= RATE * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                j, k = at
                for above in (False, True):
                    part = rows[(bins[rows, j] > k) == above]
                    condition = tuple(sorted({*path, (j, above, float(edges[j][k]))}))
                    rules.add(condition)
                    below.append((part, condition))
            nodes = below
        for rows, _ in nodes:
            margin[rows] -= RATE * g[rows].sum() / (h[rows].sum() + 1)
    return rules


def fires(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, limit in rule:
        out &= (x[:, j] > limit) == above
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules for labels y (0 or 1) of rows x of statistics. Without both labels: no rules, and a score of the label's side."""
    if not len(y) or y.min() == y.max():
        return Rules([], [], 0.0 if not len(y) else 3.0 if y.max() else -3.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    rules = sorted(grow(bins, edges, y))
    fired = {}
    for rule in rules:  # rules that fire for the same rows are one
        f = fires(rule, x)
        if LEAST_ROWS <= f.sum() <= len(y) - LEAST_ROWS:
            fired.setdefault(f.tobytes(), (rule, f))
    rules = [r for r, _ in fired.values()]
    if not rules:
        return Rules([], [], float(np.log(y.mean() / (1 - y.mean()))))
    a = np.stack([f for _, f in fired.values()], axis=1).astype(np.float32)
    strength = STRENGTH
    while True:
        w, _ = lasso_logistic(a, y.astype(np.float32), strength)
        use = np.flatnonzero(np.abs(w) > 1e-4)
        if len(use) <= RULES:
            break
        strength *= 1.25
    w, b = lasso_logistic(a[:, use], y.astype(np.float32), strength / 10)  # the shrinkage of those that stay is taken back
    return Rules([rules[i] for i in use], [float(v) for v in w], b)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> Rules:
    """Rules from at most `rows` labelled rows that aren't held out."""
    known = with_statistics(sample(docs, labels, label, rows), F.col("y")).toArrow()  # at most `rows` rows
    x = np.array(known["statistics"].to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.array(known["carried"].to_pylist(), float)
    order = np.lexsort((y, *x.T))  # the order rows come in is not the same in every run
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Rules, carried: Column, text_col: str = "text") -> DataFrame:
    """(carried, score) for every row of docs.

    Null and empty texts have statistics of 0 and a score like any. Null and repeated ids and repeated
    rows stay rows; an empty table gives an empty result. Only `carried` and the text are looked at, so
    other columns may have any name.
    """
    return with_statistics(docs, carried, text_col).select("carried", model.score().alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold.

    Null and empty texts score like any; repeated rows and rows with null ids are each judged. An empty table
    gives an empty result, and without labels of both kinds all rows have one score. Columns may have any names.
    """
    return score(docs, learn(docs, labels), F.struct("*")).where(F.col("score") >= threshold).select("carried.*")


def op3_quality(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, read(spark, sf_dir, "labels")), F.col("doc_id"))
    scored = scored.withColumnRenamed("carried", "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
