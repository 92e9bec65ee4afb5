"""Counts over whole texts that quality rules and classifiers look at."""

from __future__ import annotations

import numpy as np

from contentdup.llm.hashing import Words, sums_by_text, word_grams


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SPACE = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
_SYMBOL = _table(b"#*$%&|<>")
_DIGIT = _table(b"0123456789")
_UPPER = _table(bytes(range(ord("A"), ord("Z") + 1)))
_STOP = _table(b".!?")
_MARK = _table(b"!")
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_HIGH = np.arange(256) >= 0x80
_BLANKS = " \t\n\x0b\x0c\r"


def word_chars(words: Words) -> np.ndarray:
    """Code points inside words."""
    return words.byte_counts[:, ~_SPACE & ~_CONTINUED].sum(axis=1)


def symbols(words: Words) -> np.ndarray:
    return words.byte_counts[:, _SYMBOL].sum(axis=1)


def _equal_to_another(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur twice or more in their text; which are not the first."""
    order = np.lexsort((hashes, text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    later = np.zeros(len(hashes), bool)
    later[order[1:]] = same
    shared = later.copy()
    shared[order[:-1]] |= same
    return shared, later


def repeated_words(words: Words, window: int = 3) -> np.ndarray:
    """Words that lie in windows found twice or more in their text."""
    hashes, bounds = word_grams(words, window)
    counts = words.counts
    text = np.repeat(np.arange(len(counts)), np.diff(bounds))
    shared, _ = _equal_to_another(hashes, text)
    covered = np.zeros(len(words.starts) + window, bool)
    at = np.arange(bounds[-1]) - bounds[text] + words.first_of_text[text]
    for step in range(window):
        covered[at[shared] + step] = True
    return sums_by_text(covered[: len(words.starts)], words.first_of_text).astype(np.int64)


def distinct_words(words: Words) -> np.ndarray:
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    _, later = _equal_to_another(words.hashes, text)
    return sums_by_text(~later, words.first_of_text).astype(np.int64)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return len(lines) - len(set(lines))


FEATURES = [
    "log_chars", "log_words", "word_length", "longest_word", "digits", "upper", "symbols", "bars", "marks", "stops",
    "high", "blanks", "line_ends", "distinct", "repeated", "lines_repeated", "entropy",
]


def document_features(words: Words, texts: list[str]) -> np.ndarray:
    """One row per text of the statistics in :data:`FEATURES`; all are finite,
    those of an empty text are zero."""
    n_bytes = np.diff(words.bounds)
    n_words = words.counts
    some, some_words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    lengths = words.stops - words.starts
    longest = np.zeros(len(n_words))
    full = n_words > 0
    if len(lengths):
        longest[full] = np.maximum.reduceat(lengths, words.first_of_text[:-1][full])
    shares = words.byte_counts / some[:, None]
    entropy = -(shares * np.log2(np.maximum(shares, 1e-300))).sum(axis=1)
    share = {name: shares[:, table].sum(axis=1) for name, table in
             {"digits": _DIGIT, "upper": _UPPER, "symbols": _SYMBOL, "marks": _MARK, "stops": _STOP, "high": _HIGH, "blanks": _SPACE}.items()}
    lines = np.array([repeated_lines(text) for text in texts])
    columns = {
        "log_chars": np.log1p(n_bytes),
        "log_words": np.log1p(n_words),
        "word_length": word_chars(words) / some_words,
        "longest_word": np.log1p(longest),
        **share,
        "bars": shares[:, ord("|")],
        "line_ends": shares[:, ord("\n")],
        "distinct": distinct_words(words) / some_words,
        "repeated": repeated_words(words) / some_words,
        "lines_repeated": np.log1p(lines),
        "entropy": entropy,
    }
    return np.column_stack([columns[name] for name in FEATURES])
