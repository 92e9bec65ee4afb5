"""Hashes of words, word n-grams and character n-grams, many texts at a time.

Everything works on the UTF-8 bytes of a batch. Words are runs of bytes other
than space and 0x09 to 0x0D; no word or n-gram crosses a text. A word's hash
is a sum of its bytes times fixed random numbers by place, modulo 2^64.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

# Longer words are hashed by digest, so that the table of places stays small.
LONG_WORD = 4096
# Bytes worked on at once, so that long texts need little more than themselves.
CHUNK = 1 << 22

_PLACES = np.random.default_rng(7).integers(1, 2**63, LONG_WORD, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    values = (values ^ (values >> np.uint64(30))) * _M1
    values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch of texts: bytes, bounds of texts, bounds of words.

    With ``fold``, hashes take A-Z in lower case.
    """

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    fold: bool = True

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray, fold: bool = True) -> Words:
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = bounds[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] = inside[cuts]
        starts = np.flatnonzero(begins)
        # A word ends where the next byte is blank or begins another text.
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        return cls(data, bounds, starts, np.flatnonzero(ends) + 1, fold)

    @cached_property
    def first_of_text(self) -> np.ndarray:
        """Number of the first word of each text, and the count at the end."""
        return np.searchsorted(self.starts, self.bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first_of_text)

    @cached_property
    def folded(self) -> np.ndarray:
        return _LOWER[self.data] if self.fold else self.data

    @cached_property
    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(self.starts), np.uint64)
        first = 0
        while first < len(sums):
            last = max(first + 1, int(np.searchsorted(self.stops, self.starts[first] + CHUNK, side="right")))
            if last > first + 1 or self.stops[first] - self.starts[first] <= LONG_WORD:
                sums[first:last] = self._short_words(first, last)
            first = last
        for word in np.flatnonzero(self.stops - self.starts > LONG_WORD):
            raw = self.folded[self.starts[word] : self.stops[word]].tobytes()
            sums[word] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        return mix(sums)

    def _short_words(self, first: int, last: int) -> np.ndarray:
        begin, end = self.starts[first], self.stops[last - 1]
        starts = self.starts[first:last] - begin
        place = np.arange(end - begin) - np.repeat(starts, np.diff(np.append(starts, end - begin)))
        terms = (self.folded[begin:end].astype(np.uint64) + np.uint64(1)) * _PLACES[np.minimum(place, LONG_WORD - 1)]
        terms[_SPACE[self.data[begin:end]]] = 0
        return np.add.reduceat(terms, starts)

    @cached_property
    def byte_counts(self) -> np.ndarray:
        """How often each byte occurs in each text."""
        counts = np.zeros((len(self.bounds) - 1, 256), np.int64)
        for text, (begin, end) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
            for at in range(begin, end, CHUNK):
                counts[text] += np.bincount(self.data[at : min(at + CHUNK, end)], minlength=256)
        return counts


def word_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words, and the bounds of the texts in
    them. A text with fewer words, but at least one, has its whole sequence."""
    hashes, first, counts = words.hashes, words.first_of_text, words.counts
    grams = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    bounds = np.append(0, np.cumsum(grams))
    text = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(bounds[-1]) - bounds[text] + first[text]
    left = np.minimum(counts[text], n)
    sums = left.astype(np.uint64)
    for step in range(n):
        inside = step < left
        sums[inside] += hashes[at[inside] + step] * _STEPS[step]
    return mix(sums), bounds


def gram_sums(words: Words, n: int, values: np.ndarray) -> np.ndarray:
    """Sum of the words' ``values`` over each window of ``word_grams``."""
    first, counts = words.first_of_text, words.counts
    grams = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    bounds = np.append(0, np.cumsum(grams))
    text = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(bounds[-1]) - bounds[text] + first[text]
    total = np.append(0, np.cumsum(values))
    return total[at + np.minimum(counts[text], n)] - total[at]


def characters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point of the batch, made of its bytes, and the
    bounds of the texts in them. ASCII characters are their own numbers."""
    data = words.folded
    if not len(data) or data.max() < 0x80:
        return data, words.bounds
    begins = (data & 0xC0) != 0x80
    begins[words.bounds[words.bounds < len(data)]] = True
    starts = np.flatnonzero(begins)
    numbers = np.empty(len(starts), np.uint32)
    for first in range(0, len(starts), CHUNK):
        here = starts[first : first + CHUNK]
        end = starts[first + CHUNK] if first + CHUNK < len(starts) else len(data)
        places = np.arange(here[0], end) - np.repeat(here, np.diff(np.append(here, end)))
        parts = data[here[0] : end].astype(np.uint32) << (8 * np.minimum(places, 3)).astype(np.uint32)
        numbers[first : first + CHUNK] = np.add.reduceat(parts, here - here[0])
    return numbers, np.searchsorted(starts, words.bounds)


def char_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` code points inside texts, blanks
    included, and the bounds of the texts in them."""
    letters, text_bounds = characters(words)
    size = len(letters) - n + 1
    lengths = np.maximum(np.diff(text_bounds) - n + 1, 0)
    bounds = np.append(0, np.cumsum(lengths))
    if size <= 0 or not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    hashes = np.zeros(size, np.uint64)
    for at in range(0, size, CHUNK):
        part = hashes[at : at + CHUNK]
        for step in range(n):
            part += (letters[at + step : at + step + len(part)].astype(np.uint64) + np.uint64(1)) * _STEPS[32 + step]
        part[:] = mix(part)
    if len(lengths) == 1:
        return hashes, bounds
    text = np.repeat(np.arange(len(lengths)), lengths)
    return hashes[np.arange(bounds[-1]) - bounds[text] + text_bounds[text]], bounds


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 for a text without any."""
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[bounds[1:]] - total[bounds[:-1]]
