"""Path and name expressions. Slow-path functions (Unicode case folding, display width) are Arrow UDFs, to be used once at ingest."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, functions as F

# Endings of names that copies get, as patterns whose first group is the base name.
COPY_PATTERNS = (
    r"(?U)^(.+?)\s*[\(（]\s*\d{1,3}\s*[\)）]$",
    r"(?U)^(.+?)[\s._-]+\d{1,2}$",
    r"(?Ui)^(.+?)[\s._-]+copy(?:[\s._-]*\d{1,3})?$",
)


def casefold(text: Column) -> Column:
    """Full Unicode case folding, which no built-in function does."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else s.casefold())

    return run(text)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; trim() knows the blank alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def base_name(path: Column, separator: str = "/") -> Column:
    return F.substring_index(path, separator, -1)


def extension(name: Column) -> Column:
    """From the last dot on that isn't among the leading ones; empty without such a dot."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def normalized_stem(name_cf: Column) -> Column:
    """A folded name's stem without white space around it. (Folding doesn't move the last dot.)"""
    return strip(stem(name_cf))


def copy_bases(stem_cf: Column) -> Column:
    """The base names that a stem could be a copy of: those of the patterns that match."""
    found = [F.regexp_extract(stem_cf, p, 1) for p in COPY_PATTERNS]
    return F.array_distinct(F.filter(F.transform(F.array(*found), strip), lambda b: b != ""))


def has_marker(path: Column, markers: tuple[str, ...]) -> Column:
    """The path holds one of the markers, as it is written; empty markers don't count."""
    out = F.lit(False)
    for marker in markers:
        if marker:
            out |= F.contains(path, F.lit(marker))
    return out


def root_label(roots: Column) -> Column:
    return F.array_join(F.array_sort(roots), ",")


def cells(char: str) -> int:
    """Terminal cells of a character (fixed rule): none for combining marks, two for wide ones."""
    return 0 if unicodedata.combining(char) else {"F": 2, "W": 2}.get(unicodedata.east_asian_width(char), 1)


def fit_text(text: str, width: int) -> str:
    """A text in exactly as many cells as a column has, or one less where a wide character is cut."""
    ends = [0, *accumulate(map(cells, text))]  # where each beginning of the text ends
    if ends[-1] <= width:
        return text + " " * (width - ends[-1])
    mark = "..."[: 3 * (width > 3)]
    return text[: max(0, bisect_right(ends, width - len(mark)) - 1)] + mark


def fit(text: Column, width: int) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else fit_text(s, width))

    return run(text)
