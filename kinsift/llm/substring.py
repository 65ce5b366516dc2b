"""Near-duplicate passages across documents, by compact windows.

The tokens of a document are its five-word shingles. For one hash function, the subsequences whose
minimum lies at place c form a compact window (l, c, r): all [i, j] with l <= i <= c <= j <= r. These are
the nodes of the Cartesian tree over the hash values, and only those wide enough for a passage of
`PASSAGE` words are made, about two per passage length. All subsequences of a window share one min-hash.

Windows of two hash functions that overlap in at least a passage's length are joined within a document;
such a joint interval is named by both of its minimal shingles, and there are `BANDS` independent pairs
of functions. Passages with a similarity s share the name of one pair of functions with probability s*s,
so at s = 0.8 all four miss in one of 60 cases, and identical passages are never missed. Intervals of two
documents with one name are a candidate. A document's candidates against one other document are merged
where they lie on about one diagonal, and the texts of the merged regions are compared word by word:
what is reported has at least `PASSAGE` words and a Jaccard similarity of shingles of at least `SIMILAR`.

Scale: among intervals of one name, each is compared with that of the smallest document alone, never all
with all, and every link leads to a smaller document. A name that is everywhere is met first within each
task's own documents: what a task sends through the shuffle of names are the intervals of one document, not
of all. The others are pointed to the smallest document of all afterwards, by a join of pairs of documents.
So the links are those of the table, however it is dealt over tasks. Sketches are a third of a row of three numbers per word;
they are shuffled and sorted once. Texts are shuffled by document, and only the regions to be compared go
further.

A link that fails when the texts are compared isn't the last word (`_linked_again`). The interval and all
that hold its name get finer names, by which they are linked once more: one for every passage's length of
shingles around the name's first minimum, so that identical passages always meet, and, for passages that
differ, names of four functions over windows at `LEFT` distances from that minimum. Each is again linked to
the smallest holder, so the work grows with the intervals, not with their pairs. What can be missed is a
passage that differs from its partner and that neither the four pairs nor the finer names lead to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from kinsift.llm.common import WORD, pieces, read, texts
from kinsift.storage import discard, materialize

SHINGLE, PASSAGE, SIMILAR, BANDS = 5, 50, 0.8, 4
#: Shingles of a passage.
WIDTH = PASSAGE - SHINGLE + 1
#: Bytes of text hashed at once; shingles of a part of a longer text; intervals of a task that are matched at once.
BLOCK, LONG, CHUNK = 1 << 18, 1 << 22, 1 << 18
#: Candidates lie on one diagonal if it moves by no more than this many words from one to the next.
DRIFT = 24
#: Places of a shingle in the other text above which only those of its longest match are looked at.
COMMON = 8
#: Finer names: how far before a name's minimum their windows begin, and the pairs of functions for each.
LEFT, FINER = range(0, 46, 9), 2

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse up to n."""
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n + 1, base)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and where it begins; equal words have equal hashes."""
    data = np.frombuffer(raw, np.uint8)
    power, inverse = _powers(max(1 << 19, 1 << len(raw).bit_length()))
    white = np.concatenate([[True], _WHITE[data], [True]])
    edge = np.flatnonzero(white[1:] != white[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def _cut(raw: bytes, most: int) -> Iterator[bytes]:
    """raw in parts of about `most` bytes that end with white space."""
    at = 0
    while at < len(raw):
        end = at + most
        while end < len(raw) and not _WHITE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def documents_shingles(raws: list[bytes]) -> Iterator[np.ndarray]:
    """The shingle hashes of each text."""
    return (shingles for shingles, _ in hashed(raws))


def hashed(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle hashes of each text and where its words begin. Texts are taken together as long as they are small."""
    k = 0
    while k < len(raws):
        n, size = k, 0
        while n < len(raws) and (n == k or size + len(raws[n]) < BLOCK):
            size += len(raws[n]) + 1
            n += 1
        if n == k + 1 and size > BLOCK:
            parts = [word_hashes(x) for x in _cut(raws[k], BLOCK)]
            shifts = np.cumsum([0, *(len(x) for x in _cut(raws[k], BLOCK))])
            yield shingle_hashes(np.concatenate([w for w, _ in parts])), np.concatenate([at + shift for (_, at), shift in zip(parts, shifts)])
        else:
            words, start = word_hashes(b"\n".join(raws[k:n]))
            ends = np.cumsum([len(x) + 1 for x in raws[k:n]])
            bound = np.searchsorted(start, ends).tolist()
            shingles = shingle_hashes(words)
            for a, b, end, raw in zip([0, *bound], bound, ends, raws[k:n]):
                yield shingles[a : max(a, b - SHINGLE + 1)], start[a:b] - (end - len(raw) - 1)
        k = n


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = out * _BASE + words[i : i + n]
    return mix(out)


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def nearest_smaller(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value to the left of each in the same document; less than the document's first place where there is none. Values are distinct."""
    out = np.arange(len(v)) - 1
    open_ = np.arange(len(v))
    while True:
        to = out[open_]
        more = (to >= 0) & (v[to] > v[open_]) & (doc[to] == doc[open_])
        open_ = open_[more]
        if not len(open_):
            return out
        out[open_] = out[to[more]]


class Layout(NamedTuple):
    """Documents' shingles one after another: of each place, its document's first and last place and whether a passage begins there."""

    first: np.ndarray
    last: np.ndarray
    ok: np.ndarray
    opens: np.ndarray  # where a document's first passage begins


def compact_windows(v: np.ndarray, at: Layout) -> tuple[np.ndarray, ...]:
    """(start, end, c, l, r) of the windows wide enough for a passage: [start, end] are the places where a passage of WIDTH begins whose minimum is at c.

    v: values, distinct, whose lower 24 bits are their places.
    """
    low = sliding_minimum(v, WIDTH)
    new = at.opens.copy()
    new[1:] |= low[1:] != low[:-1]
    new &= at.ok
    start = np.flatnonzero(new)
    c = (low[start] & _PLACE).astype(np.int64)
    end = np.minimum(np.append(start[1:] - 1, len(low)), at.last[start] - WIDTH + 1)
    # The Cartesian tree over the minima: a minimum's window ends at the nearest smaller minimum or the document's end.
    value, own = v[c], at.first[c]
    left = nearest_smaller(value, own)
    right = len(c) - 1 - nearest_smaller(value[::-1], own[::-1])[::-1]
    l = np.maximum(own, np.where(left >= 0, c[np.maximum(left, 0)] + 1, 0))  # noqa: E741
    r = np.minimum(at.last[c], np.where(right < len(c), c[np.minimum(right, len(c) - 1)] - 1, at.last[c]))
    return start, end, c, l, r


#: The hash functions: odd factors, whose products' upper bits order the shingles' hashes, which are mixed already.
_FACTORS = [mix(np.array([i + 1], np.uint64) * _BASE)[0] | np.uint64(1) for i in range(2 * (BANDS + FINER))]


def sketch(ids: np.ndarray, shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, id, at) of the joint intervals of documents. at: first shingle << 16 | shingles << 8 | place of the first function's minimum."""
    size = np.array([len(x) for x in shingles])
    base = np.cumsum(size) - size
    h = np.concatenate(shingles)
    doc = np.repeat(np.arange(len(size)), size)
    first, last = base[doc], (base + size - 1)[doc]
    place = np.arange(len(h), dtype=np.uint64)
    ok = (last - (WIDTH - 1) >= np.arange(len(h)))[: len(h) - WIDTH + 1]
    opens = np.zeros(len(ok), bool)
    opens[base] = True
    layout = Layout(first, last, ok, opens)
    names, owners, ats = [], [], []
    for band in range(BANDS):
        both = [compact_windows((h * factor & ~_PLACE) | place, layout) for factor in _FACTORS[2 * band : 2 * band + 2]]
        (sa, ea, ca, la, ra), (sb, eb, cb, lb, rb) = both
        start = np.union1d(sa, sb)
        i, j = np.searchsorted(sa, start, side="right") - 1, np.searchsorted(sb, start, side="right") - 1
        end = np.minimum(ea[i], eb[j])
        a = np.maximum(np.maximum(la[i], lb[j]), start - WIDTH)
        b = np.minimum(np.minimum(ra[i], rb[j]), end + 2 * WIDTH - 2) + 1
        names.append(mix(mix(h[ca[i]] + np.uint64(band)) * _BASE + h[cb[j]]))
        owners.append(doc[ca[i]])
        ats.append((a - first[ca[i]] << 16) | (b - a << 8) | (ca[i] - a))
    return np.concatenate(names), ids[np.concatenate(owners)], np.concatenate(ats)


#: Intervals, and links that a task has made between two documents, packed: numbers name, at and to_at of each, end to end.
_SKETCH = "key long, id long, at long, to long, packed binary"
_MADE = "id long, at long, to long, to_at long, name long, packed binary"
_PAIRS = "id long, to long, pairs array<struct<name: bigint, at: bigint, to_at: bigint>>"


def _first_of(name: np.ndarray) -> np.ndarray:
    """For sorted names, the place of each one's first."""
    return np.maximum.accumulate(np.where(np.append(True, name[1:] != name[:-1]), np.arange(len(name)), 0))


def _intervals(name: np.ndarray, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of _SKETCH whose key is the name."""
    n = len(name)
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(owner), pa.array(at), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], _names(_SKETCH))


def _packed(owner: np.ndarray, to: np.ndarray, name: np.ndarray, at: np.ndarray, to_at: np.ndarray) -> pa.RecordBatch:
    """Links as rows of _SKETCH, one for each two documents. Their key deals them out evenly."""
    order = np.lexsort((at, name, to, owner))
    owner, to = owner[order], to[order]
    facts = np.stack([x[order].view(np.int64) for x in (name, at, to_at)], axis=1)
    start = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(to) != 0)))
    packed = [facts[a:b].tobytes() for a, b in zip(start, np.append(start[1:], len(owner)))]
    owner, to = owner[start], to[start]
    key = mix((owner.astype(np.uint64) * _BASE) ^ to.astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.nulls(len(owner), pa.int64()), pa.array(to), pa.array(packed, pa.binary())], _names(_SKETCH))


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of a task's documents; those whose name a smaller document of the same chunk has are linked to it at once."""
    ids: list[int] = []
    held: list[np.ndarray] = []
    done: list[tuple[np.ndarray, ...]] = []
    size = rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        name, owner, at = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((at, owner, name))
        name, owner, at = name[order], owner[order], at[order]
        top = _first_of(name)
        linked = owner != owner[top]  # all of the others go on: the smallest document of a chunk needn't be the smallest of all
        yield _intervals(name[~linked], owner[~linked], at[~linked])
        if linked.any():
            yield _packed(owner[linked], owner[top[linked]], name[linked], at[linked], at[top[linked]])

    for batch in pieces(batches):
        known = [(i, (text or b"").lower()) for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))) if i is not None]
        for (i, _), s in zip(known, documents_shingles([x for _, x in known])):
            if len(s) < WIDTH:
                continue
            if len(s) > LONG:  # very long texts in overlapping parts
                for k in range(0, len(s) - WIDTH + 1, LONG):
                    name, owner, at = sketch(np.array([i], np.int64), [s[k : k + LONG + WIDTH - 1]])
                    yield _intervals(name, owner, at + (k << 16))
                continue
            ids.append(i)
            held.append(s)
            size += len(s)
            if size > BLOCK // 4:  # small enough for the processor's cache
                done.append(sketch(np.array(ids, np.int64), held))
                rows += len(done[-1][0])
                ids, held, size = [], [], 0
            if rows > CHUNK:
                yield from flush()
                done, rows = [], 0
    if held:
        done.append(sketch(np.array(ids, np.int64), held))
    if done:
        yield from flush()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of intervals, which come sorted by name, id and place, to the first of their name; those that tasks made pass.

    Further intervals of the first one's document are linked to it too, so that they are known as places of the name.
    """
    carried: tuple[int, int, int] | None = None  # the name met last, and the first interval of it
    for batch in batches:
        early = batch.filter(batch.column(3).is_valid())
        if early.num_rows:
            none = pa.nulls(early.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([early.column(1), none, early.column(3), none, none, early.column(4)], _names(_MADE))
            batch = batch.filter(batch.column(3).is_null())
        name, owner, at = (np.asarray(batch.column(i)) for i in range(3))
        if not len(name):
            continue
        if carried:
            name, owner, at = (np.append(c, x) for c, x in zip(carried, (name, owner, at)))
        top = _first_of(name)
        rest = np.arange(len(name)) != top
        new = [owner[rest], at[rest], owner[top[rest]], at[top[rest]], name[rest]]
        carried = (int(name[-1]), int(owner[top[-1]]), int(at[top[-1]]))
        yield pa.RecordBatch.from_arrays([*map(pa.array, new), pa.nulls(len(new[0]), pa.binary())], _names(_MADE))


def _lists(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Where each list of a column begins, and the end; the fields of its structs, end to end. A null list is empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return [0, *np.cumsum(sizes).tolist()], [x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten()]


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_PAIRS of what tasks have linked, led to the first of all. In: id, to, packed, and the links (name, to, to_at) of the document that `to` is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in batch.column(2).to_pylist()]
        bound = [0, *np.cumsum([len(x) for x in held]).tolist()]
        name, at, to_at = np.concatenate(held).T
        known, (k_name, k_to, k_at) = _lists(batch.column(3))
        row = np.repeat(np.arange(batch.num_rows), np.diff(bound))
        led, to_at = np.asarray(batch.column(1))[row], to_at.copy()
        for a, b, c, d in zip(bound, bound[1:], known, known[1:]):
            if d > c:
                order = np.argsort(k_name[c:d], kind="stable") + c
                place = order[np.minimum(np.searchsorted(k_name[order], name[a:b]), d - c - 1)]
                same = k_name[place] == name[a:b]
                led[a:b][same], to_at[a:b][same] = k_to[place[same]], k_at[place[same]]
        if not len(row):
            continue
        order = np.lexsort((led, row))
        row, led = row[order], led[order]
        start = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(led) != 0)))
        structs = pa.StructArray.from_arrays([pa.array(x[order]) for x in (name, at, to_at)], ["name", "at", "to_at"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), structs)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[start])), pa.array(led[start]), lists], ["id", "to", "pairs"])


def _failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, id, at, to, to_at) of the links whose interval's first minimum is in no passage found. In: _PAIRS, and the passages (start, end) found between the two."""
    for batch in batches:
        (bound, (name, at, to_at)), (known, (start, end)) = _lists(batch.column(2)), _lists(batch.column(3))
        c = (at >> 16) + (at & 255)
        held = np.zeros(len(at), bool)
        for a, b, x, y in zip(bound, bound[1:], known, known[1:]):
            if y > x:
                order = np.argsort(start[x:y]) + x
                reach = np.maximum.accumulate(end[order])
                before = np.searchsorted(start[order], c[a:b], side="right") - 1  # passages that begin at or before it
                held[a:b] = (before >= 0) & (reach[np.maximum(before, 0)] >= c[a:b] + SHINGLE)
        left = np.flatnonzero(~held)
        row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bound))[left])
        columns = [pa.array(name[left]), batch.column(0).take(row), pa.array(at[left]), batch.column(1).take(row), pa.array(to_at[left])]
        yield pa.RecordBatch.from_arrays(columns, ["name", "id", "at", "to", "to_at"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, to, a, b, to_a, to_b) in words: candidates of two documents merged along their diagonals. In: _PAIRS."""
    for batch in batches:
        bound, fields = _lists(batch.column(2))
        row = np.repeat(np.arange(batch.num_rows), np.diff(bound))
        x = np.stack(fields[1:], axis=1)
        a, size, c = x >> 16, x >> 8 & 255, x & 255
        b, slant = a + size, (a + c)[:, 0] - (a + c)[:, 1]
        order = np.lexsort((slant, row))
        row, a, b, slant = row[order], a[order], b[order], slant[order]
        cluster = np.cumsum(np.append(True, (np.diff(row) != 0) | (np.diff(slant) > DRIFT)))
        order = np.lexsort((a[:, 0], cluster))  # clusters stay where they are
        row, a, b = row[order], a[order], b[order]
        lift = cluster * (int(b.max(initial=0)) + 1)
        reach = np.maximum.accumulate(b[:, 0] + lift) - lift  # within each cluster
        start = np.flatnonzero(np.append(True, (np.diff(cluster) != 0) | (a[1:, 0] > reach[:-1])))[: len(row)]
        if not len(row):
            continue
        low, high = np.minimum.reduceat(a, start), np.maximum.reduceat(b, start) + SHINGLE - 1
        ends = [batch.column(k).take(pa.array(row[start])) for k in range(2)]
        yield pa.RecordBatch.from_arrays([*ends, *(pa.array(y) for y in (low[:, 0], high[:, 0], low[:, 1], high[:, 1]))], ["id", "to", "a", "b", "to_a", "to_b"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, a, b, words): the words [a, b) of a text, joined by blanks. In: id, text, list of (a, b)."""
    for batch in pieces(batches, 1 << 20):
        rows, held = [], 0
        for i, text, spans in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
            words = (text or b"").lower().split()
            for span in spans:
                part = b" ".join(words[span["a"] : span["b"]])
                rows.append((i, span["a"], span["b"], part))
                held += len(part)
                if held > 4 << 20:
                    yield _slice_batch(rows)
                    rows, held = [], 0
        yield _slice_batch(rows)


def _slice_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.binary())], ["id", "a", "b", "words"])


#: Places of a passage of the least length that have a match at the least.
_LEAST = math.ceil(SIMILAR * WIDTH)


def _prefix(shingles: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch follows (`_stretch`)."""
    out = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(shingles * power[: len(shingles)], out=out[1:])
    return out


def _stretch(total: np.ndarray, inverse: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n shingles from each place on."""
    return (total[at + n] - total[at]) * inverse[at]


class _Twins:
    """How far two lists of shingles agree from pairs of places on."""

    def __init__(self, mine: np.ndarray, theirs: np.ndarray) -> None:
        most = max(len(mine), len(theirs))
        power, self.inverse = _powers(max(1 << 19, 1 << most.bit_length()))
        self.size = len(mine), len(theirs)
        self.total = _prefix(mine, power), _prefix(theirs, power)

    def ahead(self, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of shingles that agree from k and at on."""
        return self._far(k, at, 1)

    def back(self, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of shingles that agree just before k and at."""
        return self._far(k, at, -1)

    def _far(self, k: np.ndarray, at: np.ndarray, way: int) -> np.ndarray:
        room = np.minimum(self.size[0] - k, self.size[1] - at) if way > 0 else np.minimum(k, at)
        far = np.zeros(len(k), np.int64)
        for j in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
            step = 1 << j
            fits = np.flatnonzero(far + step <= room)
            x, y = (v[fits] + (far[fits] if way > 0 else -far[fits] - step) for v in (k, at))
            same = _stretch(self.total[0], self.inverse, x, step) == _stretch(self.total[1], self.inverse, y, step)
            far[fits[same]] += step
        return far


def _longest(mine: np.ndarray, theirs: np.ndarray, twins: _Twins) -> tuple[np.ndarray, np.ndarray]:
    """(length, place in theirs) of the longest match from each place of mine on, by the order of all suffixes."""
    n, m = len(mine), len(theirs)
    rank = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1].astype(np.int64)
    # An end of its own behind each list, so that no match goes over it.
    rank = np.concatenate([rank[:n], [n + m], rank[n:], [n + m + 1]])
    step = 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + m + 4) + behind, return_inverse=True)[1].astype(np.int64)
        step *= 2
        if rank.max() == len(rank) - 1:
            break
    order = np.argsort(rank)
    place = np.arange(len(order))
    is_theirs = (order > n) & (order < n + 1 + m)
    before = np.maximum.accumulate(np.where(is_theirs, place, -1))
    after = len(order) - 1 - np.maximum.accumulate(np.where(is_theirs[::-1], place, -1))[::-1]
    k = np.arange(n)
    best, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for near in (before[rank[:n]], after[rank[:n]]):
        there = (near >= 0) & (near < len(order)) & is_theirs[np.clip(near, 0, len(order) - 1)]
        at = order[near[there]] - n - 1
        length = twins.ahead(k[there], at)
        longer = length > best[there]
        best[k[there][longer]], to[k[there][longer]] = length[longer], at[longer]
    return best, to


def _runs(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Rows (start, end, start in theirs) of shingles that agree, as long as they go, in order; none where there are too few for a passage.

    They are all those that have a shingle with at most COMMON places in theirs, and from every place of
    mine the longest one.
    """
    order = np.argsort(theirs, kind="stable")
    ordered = theirs[order]
    low = np.searchsorted(ordered, mine)
    n = np.searchsorted(ordered, mine, side="right") - low
    if np.count_nonzero(n) < _LEAST:
        return np.zeros((0, 3), np.int64)
    common = n > COMMON
    few = np.flatnonzero((n > 0) & ~common)
    k = np.repeat(few, n[few])
    at = order[np.repeat(low[few] - np.cumsum(n[few]) + n[few], n[few]) + np.arange(len(k))]
    by = np.lexsort((k, k - at))
    k, at = k[by], at[by]
    new = np.ones(len(k), bool)
    new[1:] = (np.diff(k) != 1) | (np.diff(at) != 1)
    start = np.flatnonzero(new)
    rows = np.stack([k[start], k[np.append(start[1:], len(k)) - 1] + 1 if len(k) else k, at[start]], axis=1)
    if common.any():
        twins = _Twins(mine, theirs)
        back = twins.back(rows[:, 0], rows[:, 2])
        ahead = twins.ahead(rows[:, 1], rows[:, 2] + rows[:, 1] - rows[:, 0])
        rows = np.stack([rows[:, 0] - back, rows[:, 1] + ahead, rows[:, 2] - back], axis=1)
        best, to = _longest(mine, theirs, twins)
        fresh = common & (best > np.append(0, best[:-1] - 1))  # not the rest of the match from the place before
        k = np.flatnonzero(fresh)
        rows = np.unique(np.concatenate([rows, np.stack([k, k + best[k], to[k]], axis=1)]), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def compare(mine: np.ndarray, theirs: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start, end, to_start, to_end, similarity) in words of the near-duplicate passages of two lists of shingle hashes, ends exclusive."""
    table = _runs(mine, theirs)
    reach = np.maximum.accumulate(table[:, 1])
    # Places without a match that a similar passage may have: a quarter of those with one.
    total = int(np.maximum(table[:, 1] - np.maximum(table[:, 0], np.append(0, reach[:-1])), 0).sum()) if len(table) else 0
    if total < _LEAST:
        return []
    gap = int(total * (1 / SIMILAR - 1) + 1e-9)
    longest = int((table[:, 1] - table[:, 0]).max())
    runs = table.tolist()
    left, right = mine.tolist(), theirs.tolist()
    ahead: tuple[int, int, int] | None = None
    starts = [r[0] for r in runs]
    used = bytearray(len(left))
    out = []

    def similarity(a: int, b: int, c: int, d: int) -> float:
        x, y = set(left[a:b]), set(right[c:d])
        both = len(x & y)
        return both / (len(x) + len(y) - both)

    for first in sorted(range(len(runs)), key=lambda k: (runs[k][0] - runs[k][1], k)):
        a, b, c = runs[first]
        if used[a] or used[b - 1]:
            continue
        d, same = c + b - a, b - a
        steps = [(a, b, c, d)]
        # Take in the next run on either side as long as the whole stays similar, by number of matching places. A run after
        # which it isn't may still be part of a passage that the runs behind it make similar again: it is tried with them.
        k = first + 1
        far = b, d, same
        while k < len(runs) and starts[k] <= max(b, far[0]) + gap:
            x, y, z = runs[k]
            k += 1
            for e, f, n in (far, (b, d, same)):
                if y > e and f - 1 <= z + max(0, e - x) and x <= e + gap and z <= f + gap and not used[y - 1]:
                    n += y - max(x, e)
                    if n >= SIMILAR * ((y - a) + (z + y - x - c) - n):
                        b, d, same = far = y, z + y - x, n
                        steps.append((a, b, c, d))
                        break
                    if (e, f) == far[:2]:
                        ahead = y, z + y - x, n
            else:
                far = ahead or far
            ahead = None
        k = first - 1
        far = a, c, same
        while k >= 0 and min(a, far[0]) - longest - gap <= starts[k]:
            x, y, z = runs[k]
            k -= 1
            for e, f, n in (far, (a, c, same)):
                if x < e <= y + gap and z + min(y, e) - x <= f + 1 and z + y - x >= f - gap and not used[x] and z <= f:
                    n += min(y, e) - x
                    if n >= SIMILAR * ((b - x) + (d - z) - n):
                        a, c, same = far = x, z, n
                        steps.append((a, b, c, d))
                        break
                    if (e, f) == far[:2]:
                        ahead = x, z, n
            else:
                far = ahead or far
            ahead = None
        if b - a < WIDTH:
            continue
        # The widest of them that is similar as a set, too; the first, a single run, is.
        for a, b, c, d in reversed(steps):
            s = similarity(a, b, c, d)
            if s >= SIMILAR or b - a < WIDTH:
                break
        if b - a >= WIDTH:
            out.append((a, b + SHINGLE - 1, c, d + SHINGLE - 1, s))
            used[a:b] = b"\1" * (b - a)
    return sorted(out)


_RESULT = "id long, start long, end long, to long, to_start long, to_end long, similarity double, digest long"


def digest(words: list[bytes]) -> int:
    """A passage's digest, as a signed number."""
    return _digest(b" ".join(words))


def _digest(passage: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(passage), "big", signed=True)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
    for batch in pieces(batches):
        ends = [batch.column(k).to_pylist() for k in range(6)]
        distinct = {text: k for k, text in enumerate(dict.fromkeys(ends[4] + ends[5]))}
        facts = list(hashed(list(distinct)))
        rows = []
        for i, to, a, to_a, left, right in zip(*ends):
            mine, start = facts[distinct[left]]
            if left == right:
                found = [(0, len(start), 0, len(start), 1.0)] if len(start) >= PASSAGE else []
            else:
                found = compare(mine, facts[distinct[right]][0])
            for s, e, ts, te, j in found:
                passage = left[start[s] : start[e] - 1 if e < len(start) else len(left)]  # words are joined by one blank
                rows.append((i, a + s, a + e, to, to_a + ts, to_a + te, j, _digest(passage)))
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["id", "start", "end", "to", "to_start", "to_end", "similarity", "digest"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, to, to_start, to_end, similarity, digest) of passages that near-duplicate one of a document with a smaller id.

    Places are numbers of words, ends exclusive; words are cut at white space and A-Z are lower-cased. The
    first document that has a passage is only named in `to`. Texts of fewer than PASSAGE words (null and
    empty ones too) have no passages, nor do rows with a null id. Rows that share an id are one document
    of several texts; digest tells whose passage it is. Passages within one document aren't looked for. An
    empty table gives an empty result. Only the two named columns are looked at. The rows are the same
    however the table is dealt over tasks.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = narrow.mapInArrow(_sketches, _SKETCH)
    made = materialize(rows.repartition("key").sortWithinPartitions("key", "id", "at").mapInArrow(_groups, _MADE), "made")
    pairs = materialize(first_pairs(made), "pairs")
    found = materialize(_verified(narrow, pairs), "found")
    again = _linked_again(narrow, made, pairs, found)
    for table in (made, pairs):
        discard(table)
    return found.unionByName(_verified(narrow, again)).distinct()


def first_pairs(made: DataFrame) -> DataFrame:
    """_PAIRS: for two documents, the intervals of the one that are linked to the other, because it is the first to have their name: by id, then by place."""
    gathered = F.collect_list(F.struct("name", "at", "to_at")).alias("pairs")
    settled = made.where("packed IS NULL AND id <> to").groupBy("id", "to").agg(gathered)
    early = made.where("packed IS NOT NULL").select("id", "to", "packed")
    # Links that tasks made lead to the smallest document of some; where others have the name too, that document's own link says which is the first.
    leaders = early.select(F.col("to").alias("k")).distinct()
    theirs = made.where("packed IS NULL").join(leaders, F.col("id") == F.col("k"), "left_semi")
    theirs = theirs.groupBy(F.col("id").alias("k")).agg(F.collect_list(F.struct("name", "to", "to_at")).alias("known")).select((F.col("k") + F.lit(0)).alias("k"), "known")
    resolved = early.join(theirs, F.col("to") == F.col("k"), "left").select("id", "to", "packed", "known").mapInArrow(_resolved, _PAIRS)
    resolved = resolved.where("id <> to").groupBy(F.col("id").alias("i"), F.col("to").alias("t")).agg(F.flatten(F.collect_list("pairs")).alias("more"))
    both = settled.join(resolved, (F.col("id") == F.col("i")) & (F.col("to") == F.col("t")), "full_outer")
    none = F.array().cast("array<struct<name: bigint, at: bigint, to_at: bigint>>")
    return both.select(F.coalesce("id", "i").alias("id"), F.coalesce("to", "t").alias("to"), F.concat(F.coalesce("pairs", none), F.coalesce("more", none)).alias("pairs"))


def _sliced(narrow: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """(id, a, b, words) of the spans (id, a, b), in words."""
    spans = spans.distinct().groupBy(F.col("id").alias("k")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    wanted = narrow.join(spans, narrow["id"] == spans["k"]).select("id", "text", "spans")
    return materialize(wanted.mapInArrow(_slices, "id long, a long, b long, words binary").distinct(), name)


def _verified(narrow: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages found between the documents of _PAIRS."""
    regions = materialize(pairs.mapInArrow(_regions, "id long, to long, a long, b long, to_a long, to_b long"), "regions")
    spans = regions.select("id", "a", "b").unionByName(regions.select(F.col("to").alias("id"), F.col("to_a").alias("a"), F.col("to_b").alias("b")))
    slices = _sliced(narrow, spans, "slices")
    left = slices.select("id", "a", "b", F.col("words").alias("mine"))
    right = slices.select(F.col("id").alias("to"), F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.col("words").alias("theirs"))
    both = regions.join(left, ["id", "a", "b"]).join(right, ["to", "to_a", "to_b"])
    return both.select("id", "to", "a", "to_a", "mine", "theirs").mapInArrow(_verify, _RESULT)


_FINER = "key long, id long, at long, failed boolean, to long, to_at long"


def _finer_of(i: int, shingles: np.ndarray, name: np.ndarray, at: np.ndarray, failed: np.ndarray, to: np.ndarray, to_at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The finer names of one document's intervals, as columns of _FINER."""
    a, end, c = at >> 16, (at >> 16) + (at >> 8 & 255), (at >> 16) + (at & 255)
    if len(shingles) < WIDTH:
        return
    # Every window of a passage's length that has an interval's first minimum.
    low, high = np.maximum(a, c - WIDTH + 1), np.minimum(np.minimum(c, end - WIDTH), len(shingles) - WIDTH) + 1
    some = high > low
    held, wanted = np.zeros(len(shingles) + 1, np.int64), np.zeros(len(shingles) + 1, np.int64)
    for count, rows in ((held, some), (wanted, some & failed)):
        np.add.at(count, low[rows], 1)
        np.add.at(count, high[rows], -1)
    p = np.flatnonzero(np.cumsum(held))
    power, inverse = _powers(max(1 << 19, 1 << len(shingles).bit_length()))
    key = mix(_stretch(_prefix(shingles, power), inverse, p, WIDTH))
    none = np.full(len(p), -1)
    yield key.view(np.int64), np.full(len(p), i), p << 16 | WIDTH << 8, np.cumsum(wanted)[p] > 0, none, none
    # Windows at some distances from the minimum, named by the interval's name and two more functions.
    factors = _FACTORS[2 * BANDS :]
    least = [sliding_minimum(shingles * f, WIDTH) for f in factors]
    for left in LEFT:
        s = c - left
        fits = np.flatnonzero((s >= a) & (s + WIDTH <= end) & (s + WIDTH <= len(shingles)))
        for k in range(FINER):
            key = mix(mix(mix(name[fits] + np.uint64(left * FINER + k + 1)) * _BASE + least[2 * k][s[fits]]) * _BASE + least[2 * k + 1][s[fits]])
            yield key.view(np.int64), np.full(len(fits), i), at[fits], failed[fits], to[fits], to_at[fits]


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: id, text, list of (name, at, failed, where a failed link led or -1). Out: _FINER."""
    names = [x.split(" ")[0] for x in _FINER.split(", ")]
    for batch in pieces(batches):
        bound = batch.column(2).offsets.to_numpy()
        bound = (bound - bound[0]).tolist()
        name, *rest = (x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten())
        raws = [(x or b"").lower() for x in texts(batch.column(1))]
        found = []
        for i, shingles, low, high in zip(batch.column(0).to_pylist(), documents_shingles(raws), bound, bound[1:]):
            found += _finer_of(i, shingles, name[low:high].view(np.uint64), *(x[low:high] for x in rest))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)


def _linked_again(narrow: DataFrame, made: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """_PAIRS of the intervals whose link failed and the first holders of finer names.

    A link holds if a passage found between its two documents has the interval's first minimum; an interval
    all of whose words are found already needs none.
    """
    spans = F.struct("start", "end")
    between = found.groupBy(F.col("id").alias("i"), F.col("to").alias("t")).agg(F.collect_list(spans).alias("spans"))
    looked = pairs.join(between, (F.col("id") == F.col("i")) & (F.col("to") == F.col("t")), "left").select("id", "to", "pairs", "spans")
    failed = looked.mapInArrow(_failed, "name long, id long, at long, to long, to_at long")
    a, b = F.shiftright("at", 16), F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(255) + SHINGLE - 1
    own = found.select(F.col("id").alias("k"), "start", "end").distinct()
    failed = materialize(failed.join(own, (F.col("id") == F.col("k")) & (F.col("start") <= a) & (F.col("end") >= b), "left_anti"), "failed")
    holders = failed.select("name", "id", "at", F.struct(F.lit(True).alias("failed"), "to", "to_at").alias("link"))
    nowhere = F.struct(F.lit(False).alias("failed"), F.lit(-1).cast("long").alias("to"), F.lit(-1).cast("long").alias("to_at")).alias("link")
    tops = failed.select("name", F.col("to").alias("id"), F.col("to_at").alias("at"), nowhere)
    further = made.where("packed IS NULL AND id = to").join(failed.select("name").distinct(), "name", "left_semi").select("name", "id", "at", nowhere)
    holders = holders.unionByName(tops).unionByName(further).groupBy("name", "id", "at").agg(F.max("link").alias("link"))
    spots = holders.groupBy(F.col("id").alias("k")).agg(F.collect_list(F.struct("name", "at", "link.failed", "link.to", "link.to_at")).alias("spots"))
    wanted = narrow.join(spots, narrow["id"] == spots["k"]).select("id", "text", "spots")
    finer = materialize(wanted.mapInArrow(_finer, _FINER), "finer")
    firsts = finer.groupBy("key").agg(F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("last"))
    firsts = firsts.where("first.id < last").select((F.col("key") + F.lit(0)).alias("k"), "first")
    again = finer.where("failed").join(firsts, F.col("key") == F.col("k")).where("first.id < id AND NOT (first.id = to AND first.at = to_at)")
    again = again.select("id", "at", F.col("first.id").alias("to"), F.col("first.at").alias("to_at")).distinct()
    gathered = F.collect_list(F.struct(F.lit(0).cast("long").alias("name"), "at", "to_at")).alias("pairs")
    again = materialize(again.groupBy("id", "to").agg(gathered), "again")
    for table in (failed, finer):
        discard(table)
    return again


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of spans [start, end) and the white space behind them."""
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out, end = [], 0
    for a, b in sorted(spans):
        start = at[a][0]
        if start > end:
            out.append(text[end:start])
        end = max(end, at[b][0] if b < len(at) else len(text))
    return b"".join(out) + text[end:]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without the passages that a document with a smaller id has too; the smallest keeps them.

    Texts without such a passage stay as they are. chars_col, where there is one, is counted again for
    texts that change. A row all of whose words go goes itself. Rows with null ids, null and empty texts and
    repeated rows stay as they are; an empty table gives an empty result. Other columns may have any names.
    """
    spans = repeats(docs, id_col, text_col).groupBy(F.col("id").alias("k")).agg(F.collect_set(F.struct("start", "end", "digest")).alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(spans, rows["id"] == spans["k"], "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            new = []
            for text, found in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                words = (text or b"").lower().split() if found else []
                own = [(x["start"], x["end"]) for x in found or [] if x["end"] <= len(words) and digest(words[x["start"] : x["end"]]) == x["digest"]]
                new.append(without(text, own) if own else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.binary()).cast(pa.string())], ["row", "new"])

    schema = T.StructType([joined.schema["row"], T.StructField("new", T.StringType())])
    changed = joined.mapInArrow(cut, schema).where(F.col("new").isNull() | F.col("new").rlike(WORD))
    fields = []
    for name in docs.columns:
        old = F.col("row").getField(name)
        value = {text_col: F.col("new"), chars_col: F.length("new").cast(docs.schema[name].dataType)}.get(name)
        fields.append((old if value is None else F.when(F.col("new").isNull(), old).otherwise(value)).alias(name))
    return changed.select(*fields)


def op5_substring(spark, sf_dir: str) -> DataFrame:
    found = repeats(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", F.col("to").alias("first_doc_id"), F.col("to_start").alias("first_start"), F.col("to_end").alias("first_end"), "similarity")
