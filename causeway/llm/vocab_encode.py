"""Encoding of texts with the tokenizers library through a cache of parts.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each by
itself.  A single space between two other characters always starts a
pre-token, and so does a run of line feeds between two other characters, so
the parts that start at these can be encoded once and kept.  Texts with other
white space, or with the text of an added token, go to the library whole.

Arrow cuts the texts and numbers their distinct parts, the cache holds places
in one array of ids, and NumPy copies the ids of all texts from there at once.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that keeps a text whole: any but single spaces and line feeds, for RE2.
_ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\A | \z"

#: A letter before any of these marks ends a pre-token.  No apostrophe, which may start one with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = frozenset(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as the machine holds them: little-endian, 32 bits")


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` values at least; memory that holds none yet stays untouched."""
    if n <= len(a):
        return a
    out = np.empty(max(2 * len(a), n), a.dtype)
    out[: len(a)] = a
    return out


class _Places(dict):
    """The place of each part; parts asked for the first time get the next and are noted as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = place = len(self)
        self.new.append(part)
        return place


class ByteLevelEncoder:
    """Ids as little-endian unsigned 32-bit numbers, exactly as
    ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    #: Parts kept; beyond it the older half goes.
    LIMIT = 1_200_000

    #: Bytes of text encoded at once; a longer text comes by itself.
    SLICE = 2 << 20

    #: Parts that the library gets as one text.
    BLOCK = 1024

    #: Marks at the end of a part that are kept apart from the rest, at most.
    TAIL = 3

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_parts = bool(plain) and not spec["model"].get("dropout")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.odd = "|".join([_ODD, *(re.sub(r"([^\w\s])", r"\\\1", x, flags=re.ASCII) for x in added)])
        vocab = self.library.get_vocab()
        #: Whether an id is of a token that starts with a space or a line feed, as these bytes are written.
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.starts[[i for token, i in vocab.items() if token[:1] in ("Ġ", "Ċ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.cache = _Places()
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.at, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _drop_older(self) -> None:
        kept, drop = _Places(), len(self.cache) // 2
        kept.update((part, place - drop) for part, place in islice(self.cache.items(), drop, None))
        count = self.count[drop : len(self.cache)].copy()
        ids = self._copied(self.at[drop : len(self.cache)], count)
        self.cache, self.ids, self.used = kept, ids, len(ids)
        self.at, self.count = np.cumsum(count) - count, count

    def _copied(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The runs of ``count`` ids that lie ``at`` these positions, one after the other."""
        ends = np.cumsum(count)
        source = np.repeat(at - ends + count, count)
        source += np.arange(len(source))
        return self.ids[source]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts and how many each has."""
        ids = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids or [np.zeros(0, "<u4")]), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts, which the library gets as one text: spaces and line feeds
        start one token each and stand nowhere else."""
        texts = [x if x[0] == "\n" else " " + x for x in parts]
        text = "".join(texts)
        if not (self.added and self.added.search(text)):
            ids = self._library([text])[0]
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(parts) and first[0] == 0:
                return ids, np.diff(first, append=len(ids))
        return self._library(texts)

    def _put(self, ids: np.ndarray) -> None:
        """``ids`` behind those in use."""
        self.ids = _grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids

    def _add(self, places: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        self._put(ids)
        self.at[places], self.count[places] = self.used + np.cumsum(count) - count, count
        self.used += len(ids)

    def _learn(self) -> None:
        """Ids of the new parts.  Many differ by marks at their end alone, so these are
        parts of their own, noted after a tab, which no other part holds."""
        cache, new = self.cache, self.cache.new
        known = len(cache) - len(new)
        joined, alone, whole, stems, tails = [], [], [], [], []
        for place, part in enumerate(new, known):  # stems and tails join the list on the way
            stem = part.rstrip(_MARKS)
            if len(stem) == len(part) or len(part) - len(stem) > self.TAIL or stem[-1:] not in _LETTERS:
                (alone if part[0] == "\t" or part == "\n" or part[:2] == "\n\n" else joined).append(place)
            else:
                whole.append(place)
                stems.append(cache[stem])
                tails.append(cache["\t" + part[len(stem) :]])
        self.at, self.count = _grown(self.at, len(cache)), _grown(self.count, len(cache))
        for i in range(0, len(joined), self.BLOCK):
            places = joined[i : i + self.BLOCK]
            self._add(np.array(places), *self._joined([new[p - known] for p in places]))
        if alone:
            self._add(np.array(alone), *self._library([new[p - known].removeprefix("\t") for p in alone]))
        if whole:
            pairs = np.array([stems, tails]).T
            count = self.count[pairs]
            self._add(np.array(whole), self._copied(self.at[pairs].ravel(), count.ravel()), count.sum(axis=1))
        new.clear()

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.cache) > self.LIMIT:
            self._drop_older()
        if self.by_parts:
            odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(texts), dtype=bool)
        spaced = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        for _ in range(2):  # a run of line feeds stays together; once leaves pairs
            spaced = pc.replace_substring(spaced, "\n \n", "\n\n")
        lists = pc.split_pattern(spaced, " ")
        cuts = lists.offsets.to_numpy()
        later = np.ones(len(lists.values), dtype=bool)
        later[cuts[:-1]] = False  # the first part of a text has no space before it and goes to the library
        parts = lists.values.filter(pa.array(later)).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.cache.__getitem__, distinct), np.int64, len(distinct))
        self._learn()

        heads = np.empty(len(texts), dtype=object)
        heads[odd] = texts.filter(pa.array(odd)).to_numpy(zero_copy_only=False)
        heads[~odd] = lists.values.take(pa.array(cuts[:-1])).to_numpy(zero_copy_only=False)
        ids, count = self._library(heads.tolist())
        self._put(ids)  # for this slice alone

        runs = np.ones(len(texts), np.int64)
        runs[~odd] = np.diff(cuts)
        first = np.cumsum(runs) - runs
        at, n = np.empty(runs.sum(), np.int64), np.empty(runs.sum(), np.int64)
        rest = np.ones(len(at), dtype=bool)
        rest[first] = False
        at[first], n[first] = self.used + np.cumsum(count) - count, count
        places = places[parts.indices.to_numpy()]
        at[rest], n[rest] = self.at[places], self.count[places]
        return self._copied(at, n), np.add.reduceat(n, first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (no nulls), one after the other, and how many each has."""
        ids, counts, a, size = [], [], 0, 0
        try:
            for b, x in enumerate(pc.binary_length(texts).to_pylist()):
                if b > a and size + x > self.SLICE:
                    out = self._slice(texts.slice(a, b - a))
                    ids, counts, a, size = [*ids, out[0]], [*counts, out[1]], b, 0
                size += x
            if a < len(texts):
                out = self._slice(texts.slice(a))
                ids, counts = [*ids, out[0]], [*counts, out[1]]
        except BaseException:
            self._forget()  # places may lack their ids
            raise
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@lru_cache(maxsize=1)
def encoder_for(path: str) -> ByteLevelEncoder:
    """One encoder for a Python worker, which keeps its parts from task to task."""
    return ByteLevelEncoder(path)
