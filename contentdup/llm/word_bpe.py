"""Byte-pair encoding with word ends by a segment tree, and decoding.

Texts are normalised and split into words as the tokenizer file says; the
merges of a word are found here. The leaves of a segment tree hold, for every
adjacent pair of symbols, its merge rank and place as one number. The root is
then the leftmost pair of lowest rank. A merge changes three leaves and the
nodes above them. It ends when the root says that no pair can be merged.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contentdup.llm.common import slices, texts
from contentdup.llm.latin import NOT_PLAIN, WORD_END_WORDS
from contentdup.ship import ship

CACHE_ENTRIES = 800_000
CACHED_LENGTH = 48
# Words of up to this many symbols are merged many at a time.
LANE_SYMBOLS = 64

# Marks words that a tokenizer file has spelled already.
_SPELLED = "\0"
_NONE = np.iinfo(np.int64).max


class Merges:
    """Ranks of adjacent pairs, and what they become."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        # One entry behind the last, so that every search ends inside.
        self._keys = np.append(keys[order], _NONE)
        self._ranks = np.append(np.array([r for r, _ in self.ranks.values()], np.int64)[order], -1)
        self._into = np.append(np.array([i for _, i in self.ranks.values()], np.int64)[order], -1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank -1 where there is none."""
        keys = left << 32 | right
        at = np.searchsorted(self._keys, keys)
        found = (self._keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self._ranks[at], -1), self._into[at]


def merge_word(symbols: list[int], merges: Merges) -> list[int]:
    """Merge one word of any length."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [_NONE] * (2 * width)

    def leaf(place: int) -> int:
        if after[place] >= n:
            return _NONE
        rank = merges.ranks.get((ids[place], ids[after[place]]))
        return _NONE if rank is None else rank[0] << 32 | place

    def update(place: int, value: int) -> None:
        node = width + place
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low

    tree[width : width + n - 1] = [leaf(place) for place in range(n - 1)]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] != _NONE:
        place = tree[1] & 0xFFFFFFFF
        gone = after[place]
        ids[place] = merges.ranks[ids[place], ids[gone]][1]
        after[place] = after[gone]
        if after[gone] < n:
            before[after[gone]] = place
        if gone < n - 1:
            update(gone, _NONE)
        update(place, leaf(place))
        if before[place] >= 0:
            update(before[place], leaf(before[place]))
    out, place = [], 0
    while place < n:
        out.append(ids[place])
        place = after[place]
    return out


def merge_words(words: list[list[int]], merges: Merges) -> list[list[int]]:
    """Merge many words of at most ``LANE_SYMBOLS`` symbols, a tree for each
    in the rows of one array; every round does one merge in each word."""
    longest = max(map(len, words))
    width = 1 << max(longest - 2, 0).bit_length() if longest > 2 else 1
    n_words, columns = len(words), width + 1
    sizes = np.array([len(word) for word in words])
    ids = np.full((n_words, columns), -1, np.int64)
    ids[np.repeat(np.arange(n_words), sizes), np.concatenate([np.arange(k) for k in sizes])] = np.concatenate(words)
    after = np.tile(np.arange(1, columns + 1), (n_words, 1))
    before = np.tile(np.arange(-1, columns - 1), (n_words, 1))
    tree = np.full((n_words, 2 * width), _NONE, np.int64)
    ranks, _ = merges.look_up(ids[:, :-1], ids[:, 1:])
    tree[:, width:] = np.where(ranks < 0, _NONE, ranks << 32 | np.arange(width))
    for level in range(width.bit_length() - 2, -1, -1):
        node = 1 << level
        tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])

    def update(rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
        nodes = width + places
        tree[rows, nodes] = values
        for _ in range(width.bit_length() - 1):
            nodes = nodes >> 1
            tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])

    def pair_leaves(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        nexts = after[rows, places]
        right = np.where(nexts < columns, ids[rows, np.minimum(nexts, columns - 1)], -1)
        found, _ = merges.look_up(ids[rows, places], right)
        return np.where(found < 0, _NONE, found << 32 | places)

    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        places = tree[live, 1] & 0xFFFFFFFF
        gone = after[live, places]
        _, into = merges.look_up(ids[live, places], ids[live, gone])
        ids[live, places] = into
        ids[live, gone] = -1
        nexts = after[live, gone]
        after[live, places] = nexts
        inner = nexts < columns
        before[live[inner], nexts[inner]] = places[inner]
        leaves = gone < width
        update(live[leaves], gone[leaves], np.full(int(leaves.sum()), _NONE))
        update(live, places, pair_leaves(live, places))
        left = before[live, places]
        has = left >= 0
        update(live[has], left[has], pair_leaves(live[has], left[has]))
        live = live[tree[live, 1] != _NONE]
    flat = ids[ids >= 0].tolist()
    ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class WordEncoder:
    """Encode and decode texts as the tokenizer of ``path`` does.

    Each distinct word is merged once while it is held; the store is emptied
    at ``CACHE_ENTRIES`` and takes no long words. Plain texts are split here,
    others by the rules of the tokenizer file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = Merges(self.vocab, model["merges"])
        special = {token.content: i for i, token in library.get_added_tokens_decoder().items()}
        tokens = {i: token for token, i in {**self.vocab, **special}.items()}
        self.shown = {i: (f"{i} ", f"{token} ") for i, token in tokens.items()}
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        # How the file spells the bytes of a plain character.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {code: spell(chr(code))[0][0] for code in range(0x21, 0x100)}
        # Word -> number of ids, ids in decimal, tokens; texts end with a blank.
        self.known: dict[str, tuple[int, str, str]] = {}

    def _symbols(self, word: str) -> list[int]:
        spelled = [*word[:-1], word[-1] + self.suffix]
        return [self.vocab[s] for s in spelled if s in self.vocab]

    def _words(self, text: str) -> list[str]:
        """Words of a text as the file spells them, special tokens as such."""
        words = []
        for part in self.at_special.split(text):
            if part in self.special:
                words.append(part)
            else:
                words += [_SPELLED + word for word, _ in self.split(self.normalize(part))]
        return words

    def _learn(self, words: list[str]) -> None:
        lanes: dict[int, list[tuple[str, list[int]]]] = {}
        for word in words:
            if word in self.special:
                self._keep(word, [self.special[word]])
                continue
            symbols = self._symbols(word[1:] if word[0] == _SPELLED else word.translate(self.spelling))
            if 2 <= len(symbols) <= LANE_SYMBOLS:
                lanes.setdefault((len(symbols) - 2).bit_length(), []).append((word, symbols))
            else:
                self._keep(word, merge_word(symbols, self.merges))
        for lane in lanes.values():
            for start in range(0, len(lane), 8192):
                part = lane[start : start + 8192]
                for (word, _), ids in zip(part, merge_words([symbols for _, symbols in part], self.merges)):
                    self._keep(word, ids)

    def _keep(self, word: str, ids: list[int]) -> None:
        shown = [self.shown[i] for i in ids]
        self.known[word] = (len(ids), "".join([s for s, _ in shown]), "".join([t for _, t in shown]))

    def encode(self, values: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, ids in decimal, decoded text."""
        split = [
            self._words(text)
            if NOT_PLAIN.search(text) or any(token in text for token in self.special)
            else WORD_END_WORDS.findall(text.lower())
            for text in values
        ]
        if len(self.known) > CACHE_ENTRIES:
            # The older half goes.
            self.known = dict(islice(self.known.items(), CACHE_ENTRIES // 2, None))
        new = list({word for words in split for word in words} - self.known.keys())
        self._learn(new)
        look = self.known.__getitem__
        out = []
        for words in split:
            if words:
                sizes, ids, tokens = zip(*map(look, words))
                out.append((sum(sizes), "".join(ids)[:-1], "".join(tokens)[:-1]))
            else:
                out.append((0, "", ""))
        for word in new:
            if len(word) > CACHED_LENGTH:
                del self.known[word]
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, with the words it has learnt."""
    return WordEncoder(path)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_words(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Encode every whole text (null: empty) and decode it again.

    Returns ``doc_id, n_tokens, ids, decoded``: the ids in decimal with a
    space between, and the text decoded with special tokens kept. With
    ``digests`` the two are given as ``ids_sha256`` and ``decoded_sha256``,
    made in the same pass. Empty texts give no ids and an empty text. Texts of
    any length are coded whole. One row per input row, whatever ``doc_id``
    holds; an empty table gives none; further columns are ignored.
    """
    ship(docs.sparkSession)
    shown = _sha256 if digests else str

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in slices(batches):
            coded = encoder.encode(batch.column("text").to_pylist())
            columns = [
                batch.column("doc_id"),
                pa.array([n for n, _, _ in coded], pa.int64()),
                pa.array([shown(ids) for _, ids, _ in coded], pa.string()),
                pa.array([shown(decoded) for _, _, decoded in coded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    schema = f"doc_id bigint, n_tokens bigint, {names[0]} string, {names[1]} string"
    return texts(docs).mapInArrow(encode, schema)
