"""Character classes of texts that stay within Latin-1.

For these texts the word patterns of the tokenizer files can be written with
plain classes, since letters and digits of this range are the same in every
version of Unicode.
"""

import re

import numpy as np

# Letters and digits from U+0000 to U+00FF.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"

#: Finds a character that is not plain: other scripts, controls, blanks other
#: than the space and the line end.
NOT_PLAIN = re.compile("[^\n -~\xa1-\xff]")

#: The byte-level tokenizers' words of a plain text, blanks included.
BYTE_LEVEL_WORDS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"
)

#: The words of a plain text in lower case for tokenizers with word ends.
WORD_END_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")

_LETTER, _DIGIT, _BLANK, _LINE, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
for _pattern, _kind in ((LETTERS, _LETTER), (DIGITS, _DIGIT), (" ", _BLANK), ("\n", _LINE)):
    _CLASS[[code for code in range(256) if re.match(f"[{_pattern}]", chr(code))]] = _kind
_APOSTROPHE = ord("'")
_SHORT_ENDINGS = np.isin(np.arange(256), [ord(c) for c in "stmd"])
_LONG_ENDINGS = [tuple(map(ord, ending)) for ending in ("re", "ve", "ll")]


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of :data:`BYTE_LEVEL_WORDS` begin, for plain texts in
    Latin-1 that lie one after the other; ``bounds`` are those of the texts."""
    n = len(data)
    kind = _CLASS[data]
    blank = (kind == _BLANK) | (kind == _LINE)
    first = np.zeros(n + 3, bool)  # of a text; beyond the end all are
    first[bounds[:-1]] = True
    first[n:] = True
    starts = first[:n].copy()
    # A run of one kind, and a run of blanks.
    starts[1:] |= (kind[1:] != kind[:-1]) & ~blank[1:] & ~blank[:-1]
    starts[1:] |= blank[1:] & ~blank[:-1]
    # What follows a line end; a space is part of the word that follows it.
    starts[1:] |= ~blank[1:] & (kind[:-1] == _LINE)
    # The last blank before a word stands apart from those before it.
    starts[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:n]
    # Endings such as 's, where the apostrophe begins a word.
    at = np.flatnonzero(starts & (data == _APOSTROPHE) & ~first[1 : n + 1])
    following = np.append(data, [0, 0])
    short = _SHORT_ENDINGS[following[at + 1]]
    long = np.zeros(len(at), bool)
    for one, two in _LONG_ENDINGS:
        long |= (following[at + 1] == one) & (following[at + 2] == two) & ~first[at + 2]
    for ending, length in ((at[short], 2), (at[long], 3)):
        starts[ending + 1] = False
        after = ending + length
        starts[after[after < n]] = True
    return np.flatnonzero(starts)
