"""BPE encoding and decoding by batched numpy merge rounds.

The words of a batch of texts that haven't been met yet are encoded together: their symbols lie in one
flat array, and in each round every pair of neighbours of one word is looked up by binary search among
the sorted keys of the mergeable pairs. In each word the pairs of the lowest rank are merged, from left
to right where they overlap, and words without a mergeable pair leave the array. A word's result is
kept in a bounded memory of the worker, since words recur; texts are then put together from their
words' ids, again as one flat array.

A vocabulary is a tokenizers JSON file, given by path, which every executor has to have. What is read
of it: the added tokens, whose strings are cut out of the raw text first; NFC, white space and lower
case as normalizers; a splitting pattern; byte-level symbols; the merges; and the end-of-word suffix.
Without a decoder in the file, decoding joins the tokens' strings by blanks. A file that asks for
anything else is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.common import pieces, read

#: Words whose ids a worker remembers at once, and their ids.
WORDS, IDS = 1 << 18, 1 << 21

# What the tokenizers library's Unicode tables (16.0) hold differently from the tables used here.
#: Ranges that are letters or numbers for the regex module (17.0), and other signs for the library.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Letters whose lower case Python's str.lower() doesn't know, and the sigma, which it treats by context.
LOWER = {
    0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{x: x + 32 for x in range(0x10D50, 0x10D66)}, **{x: x + 27 for x in range(0x16EA0, 0x16EB9)},
}


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size` values, at least twice as many as before if it grows."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        normalizers = [x["type"] for x in (spec["normalizer"] or {"normalizers": []})["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            model["type"] == "BPE" and not model["dropout"] and not model["unk_token"] and not model["continuing_subword_prefix"] and not model["ignore_merges"]
            and normalizers == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
            and level["type"] == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"] and spec["decoder"] is None
        )
        if not known:
            raise ValueError(f"{path}: a kind of tokenizer that isn't supported")
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        later = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER)
        self.later = regex.compile(f"[{later}]")
        self.strict = split["pattern"]["Regex"]
        for kind in (r"\p{L}", r"\p{N}"):
            self.strict = self.strict.replace(kind, f"[{kind}--[{later}]]")
        self.strict = regex.compile(self.strict, regex.V1)
        self.lowest = chr(min(*LOWER, LATER[0][0]))
        self.odd = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[x] for x in symbols], np.int64)
        self.last = np.array([self.vocab[x + suffix] for x in symbols], np.int64)
        self.size = max(*self.vocab.values(), *self.added.values()) + 1
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        strings = [b""] * self.size
        for text, i in [*self.vocab.items(), *self.added.items()]:
            strings[i] = text.encode()
        self.string_len = np.array([len(x) for x in strings], np.int64)
        self.string_at = np.cumsum(self.string_len) - self.string_len
        self.strings = np.frombuffer(b"".join(strings), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.length, self.held, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0
        for text, i in self.added.items():  # the first entries, under a name that no word has
            self._keep([" " + text], np.array([i], np.int32), np.array([1]))

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = len(self.index), self.used
        self.index.update(zip(words, range(n, n + len(words))))
        self.used += len(ids)
        self.start, self.length = grown(self.start, n + len(words)), grown(self.length, n + len(words))
        self.held = grown(self.held, self.used)
        self.start[n : n + len(words)] = used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.held[used : self.used] = ids

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (none of them empty), one after another, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(symbol))  # where a symbol began, to put the words in order again
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        rank, at = np.empty(len(symbol), np.int64), np.empty(len(symbol), np.int64)
        look = np.arange(len(symbol))  # symbols whose pair is new
        while len(symbol):
            after = np.minimum(look + 1, len(symbol) - 1)
            pair = symbol[look] * self.size + symbol[after]
            found = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            inside = (after > look) & (word[after] == word[look])
            rank[look], at[look] = np.where(inside & (self.keys[found] == pair), self.ranks[found], none), found
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = least == none
            if over.any():
                done.append((place[over], symbol[over], word[over]))
            hit = (rank == least) & ~over
            if not hit.any():
                break
            # In a run of overlapping pairs every other one is merged, from the first on.
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), np.arange(len(hit)), 0))
            hit &= run % 2 == 0
            symbol = np.where(hit, self.made[at], symbol)
            keep = ~over & ~np.append(False, hit[:-1])
            symbol, word, place, rank, at, hit = (x[keep] for x in (symbol, word, place, rank, at, hit))
            look = np.flatnonzero(hit | np.append(hit[1:], False)[: len(hit)])
        place, symbol, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return symbol[order], np.bincount(word, minlength=len(words))

    def words(self, text: str) -> list[str]:
        """The pieces of a text that are encoded one by one; of an added token its name in the memory."""
        if self.special is None or not any(x in text for x in self.added):
            return self._split(text)
        out, end = [], 0
        for m in self.special.finditer(text):
            out += self._split(text[end : m.start()])
            out.append(" " + m[0])
            end = m.end()
        return out + self._split(text[end:])

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if max(text) < self.lowest:
                return self.pattern.findall(text.lower())
            if self.odd.search(text):
                text = text.translate(LOWER)
            if self.later.search(text):
                return self.strict.findall(text.lower())
        return self.pattern.findall(text.lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and how many each has."""
        split = [self.words(x) for x in texts]
        met = set(chain.from_iterable(split))
        new = list(met.difference(self.index))
        if new and (len(self.index) + len(new) > WORDS or self.used > IDS):
            self._forget()
            new = list(met.difference(self.index))
        for i in range(0, len(new), 1 << 16):
            part = new[i : i + (1 << 16)]
            self._keep(part, *self.merge([w.encode() for w in part]))
        n = [len(x) for x in split]
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, sum(n))
        ids = gather(self.held, self.start[which], self.length[which])
        ends = np.append(0, np.cumsum(self.length[which]))[np.append(0, np.cumsum(n))]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of ids that lie one after another."""
        if not len(ids):
            return [b""] * len(lengths)
        size = self.string_len[ids] + 1  # a blank after each
        end = np.cumsum(size)
        flat = np.empty(end[-1], np.uint8)
        flat[end - 1] = 32
        inner = np.ones(end[-1], bool)
        inner[end - 1] = False
        flat[inner] = gather(self.strings, self.string_at[ids], self.string_len[ids])
        raw, ends = flat.tobytes(), np.append(0, end)[np.append(0, np.cumsum(lengths))]
        return [raw[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start+length] of every start and length, one after another."""
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    shift += np.arange(len(shift))
    return flat[shift]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The encoder of a file. A path that this machine hasn't stands for the public vocabulary of that name, wherever it lies here."""
    return Bpe(path if os.path.exists(path) else vocabulary(os.path.basename(path)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row of docs.

    Null and empty texts have no ids. Null and repeated ids and repeated rows stay as they are; an empty
    table gives an empty result. Only the two named columns are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches):
            ids, lengths = bpe.encode([x or "" for x in batch.column(1).to_pylist()])
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return np.asarray(column.flatten()), lengths


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of what encode() returns; null or empty ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches):
            decoded = bpe.decode(*_lists(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary()).cast(pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): the digests of a text's ids and of what these decode to; with_ids: and the ids.

    As encode() and decode() one after the other, but in one pass over the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in pieces(batches):
            ids, lengths = bpe.encode([x or "" for x in batch.column(1).to_pylist()])
            ends = np.append(0, np.cumsum(lengths))
            raw, cuts = ids.astype("<u4").tobytes(), (ends * 4).tolist()
            own = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]
            back = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, lengths)]
            columns = [batch.column(0), pa.array(lengths), pa.array(own, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), vocabulary())
