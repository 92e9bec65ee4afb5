"""Personal data in texts: patterns, and a skip-chain random field for more.

The patterns give the base spans. The field labels every token with a digit or
an ``@``. Its edges join neighbours in the text and, over any distance, all
tokens with the same digits or address to one node of that key, so that what is
a phone number in one place is one in another. Keys have at least 7 digits. A
run of tokens also has the key of the base span whose digits it repeats, with
or without the country code, however it is grouped. Tokens in base spans and
keys that such a span holds are observed; loopy belief propagation finds the
others, until messages rest.

The potentials maximise the conditional likelihood of each label given its
neighbours and key, from counts over all documents. Labels are the base spans.
Each phone and card number is learnt from a second time with its form masked:
as bare or grouped digits whose only hint is the key. Other tokens with the key
of a base span are no examples, as their label is what the field is to find.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.llm.common import slices
from contentdup.ship import ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
THRESHOLD = 0.9
# Keys and added phone numbers have at least so many digits; fewer name nobody.
LINK_DIGITS = 7
# After so many rounds of messages the steps shrink, so that every graph ends.
FULL_STEPS = 50
COUNTRY_DIGITS = 3

# A token is of interest only if the text has one of these.
INTEREST = "[0-9@]"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins at the start of a run of digits, or it begins nowhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_OF_INTEREST = re.compile(INTEREST)
_NOT_DIGIT = re.compile("[^0-9]+")
# Of a form that was never seen.
_NO_SHAPE = ""
_ASCII_DIGITS = frozenset("0123456789")


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _octets(match: str) -> bool:
    parts = [part.lstrip("0") or "0" for part in match.split(".")]
    return all(len(part) <= 3 and int(part) <= 255 for part in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and dotted name, found from each ``@``."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, sorted."""
    found = [(start, 0, end) for start, end in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def show_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


@dataclass
class Tokens:
    """Tokens of interest of one text.

    ``label`` is that of the base span a token touches, else 0; ``observed``
    says whether there is one. ``chain`` are pairs of neighbours, ``links``
    pairs of a token and a key; ``key_label`` is the label of the base spans
    that hold a key, else 0. ``run_end`` is the last token of the run that
    repeats a number from a token on, or -1. ``open_left`` and ``open_right`` mark tokens
    next to others or the ends.
    """

    spans: list[tuple[int, int]]
    codes: list[str]
    label: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    links: np.ndarray
    key_label: np.ndarray
    run_end: list[int]
    open_left: np.ndarray
    open_right: np.ndarray

    @property
    def skip(self) -> list[tuple[int, int]]:
        """Each token of a key with the next one, over any distance."""
        members: dict[int, list[int]] = {}
        for token, key in self.links.tolist():
            members.setdefault(key, []).append(token)
        return [pair for tokens in members.values() for pair in zip(tokens, tokens[1:])]


def _code(token: str) -> str:
    """The shape of a token: one of a fixed number."""
    digits = _digits(token)
    letters = sum(c.isalpha() for c in token)
    dots = min(token.strip(".,;:!?").count("."), 4)
    quad = _IP.search(token)
    octets = 0 if not quad else 1 if _octets(quad.group()) else 2
    flags = (
        "@" in token,
        "-" in token,
        "+" in token,
        "(" in token or ")" in token,
        12 <= len(digits) <= 19 and luhn(digits),
    )
    return f"{min(len(digits), 20)}.{min(letters, 4)}.{dots}." + "".join("01"[flag] for flag in flags) + str(octets)


def _link_key(token: str) -> str | None:
    """Tokens with one key are joined over any distance."""
    if "@" in token:
        return token.strip(".,;:!?()<>[]\"'").lower()
    digits = _digits(token)
    return digits if len(digits) >= LINK_DIGITS else None


def _forms(kind: int, digits: str) -> list[str]:
    """The digits by which a phone or card number may be repeated."""
    cuts = range(COUNTRY_DIGITS + 1) if KINDS[kind] == "phone" else range(1)
    return [digits[cut:] for cut in cuts if len(digits) - cut >= LINK_DIGITS]


def _numbers(text: str, spans: list[tuple[int, int, int]]) -> dict[str, int]:
    """Label of each form of the phone and card numbers of the base spans."""
    known: dict[str, int] = {}
    whole = [(kind, _digits(text[start:end])) for start, kind, end in spans if KINDS[kind] in ("phone", "card")]
    for kind, digits in whole:
        known.setdefault(digits, kind + 1)
    for kind, digits in whole:
        for form in _forms(kind, digits)[1:]:
            known.setdefault(form, kind + 1)
    return known


def _keys(digits: list[str], own: list[str | None], label: list[int], left: list[bool], known: dict[str, int]):
    """Links of tokens to keys, the labels of the keys, and for each token the
    end of the run that repeats a number from there (-1: none)."""
    members: dict[str, dict[int, None]] = {}
    run_end = [-1] * len(own)
    for number, key in enumerate(own):
        if key is not None:
            members.setdefault(key, {})[number] = None
    longest = max(map(len, known), default=0)
    for first in range(len(own) if known else 0):
        joined = ""
        for last in range(first, len(own)):
            # A run ends at base spans, at other tokens and past the longest number.
            if label[last] or not digits[last] or (last > first and left[last]) or len(joined) + len(digits[last]) > longest:
                break
            joined += digits[last]
            if joined in known:
                members.setdefault(joined, {}).update(dict.fromkeys(range(first, last + 1)))
                run_end[first] = last
    links, labels = [], []
    for key, tokens in members.items():
        held = Counter(label[t] for t in tokens if label[t])
        of_key = known.get(key) or (min(held, key=lambda y: (-held[y], y)) if held else 0)
        if all(label[t] for t in tokens) or (len(tokens) < 2 and not of_key):
            continue
        links += [(t, len(labels)) for t in sorted(tokens)]
        labels.append(of_key)
        if of_key:
            for token in tokens:
                if own[token] == key:
                    run_end[token] = max(run_end[token], token)
    return links, labels, run_end


def read_tokens(text: str, spans: list[tuple[int, int, int]]) -> Tokens:
    places, codes, labels, chain, left, right = [], [], [], [], [], []
    digits: list[str] = []
    own: list[str | None] = []
    previous, was_of_interest = -1, False
    at = 0
    covering: list[tuple[int, int, int]] = []
    for match in _TOKEN.finditer(text):
        token = match.group()
        if not _OF_INTEREST.search(token):
            if was_of_interest:
                right[previous] = True
            was_of_interest = False
            continue
        start, end = match.span()
        while at < len(spans) and spans[at][0] < end:
            covering.append(spans[at])
            at += 1
        covering = [s for s in covering if s[2] > start]
        number = len(places)
        places.append((start, end))
        codes.append(_code(token))
        labels.append(min((s[1] for s in covering), default=-1) + 1)
        left.append(not was_of_interest)
        right.append(False)
        if was_of_interest:
            chain.append((previous, number))
        own.append(_link_key(token))
        digits.append("" if "@" in token else _digits(token))
        previous, was_of_interest = number, True
    if was_of_interest:
        right[previous] = True
    links, key_labels, run_end = _keys(digits, own, labels, left, _numbers(text, spans))
    label = np.array(labels, np.int64)
    pairs = lambda edges: np.array(edges, np.int64).reshape(-1, 2)
    return Tokens(
        places, codes, label, label > 0, pairs(chain), pairs(links), np.array(key_labels, np.int64), run_end,
        np.array(left, bool), np.array(right, bool),
    )


@dataclass(frozen=True)
class Field:
    """Log potentials: by shape, of neighbours, of a key (row) and its tokens."""

    shapes: dict[str, np.ndarray]
    unknown: np.ndarray
    chain: np.ndarray
    key: np.ndarray

    def beliefs(self, tokens: Tokens) -> np.ndarray:
        """Probabilities of the labels of each token."""
        n = len(tokens.spans)
        local = np.stack([self.shapes.get(code, self.unknown) for code in tokens.codes])
        local = local + tokens.open_left[:, None] * self.chain[0] + tokens.open_right[:, None] * self.chain[:, 0]
        # Keys are nodes after the tokens.
        local = np.concatenate([local, np.zeros((len(tokens.key_label), len(LABELS)))])
        label = np.concatenate([tokens.label, tokens.key_label])
        clamped = np.full(local.shape, -1e4)
        clamped[np.arange(len(label)), label] = 0
        local = np.where(label[:, None] > 0, clamped, local)
        edges = np.concatenate([tokens.chain, tokens.links + np.array([0, n])])
        if len(edges):
            tables = np.concatenate(
                [np.repeat(self.chain[None], len(tokens.chain), 0), np.repeat(self.key.T[None], len(tokens.links), 0)]
            )
            # Each edge carries a message both ways.
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            messages = np.zeros((len(source), len(LABELS)))
            step, rounds, moved = 0.5, 0, 1.0
            while moved > 1e-6:
                total = local.copy()
                np.add.at(total, target, messages)
                sent = _logsum((total[source] - messages[back])[:, :, None] + tables)
                sent -= _logsum(sent[:, :, None])
                change = step * (sent - messages)
                messages += change
                moved = np.abs(change).max()
                rounds += 1
                step *= 0.9 if rounds > FULL_STEPS else 1.0
            np.add.at(local, target, messages)
        local = local[:n] - local[:n].max(axis=1, keepdims=True)
        p = np.exp(local)
        return p / p.sum(axis=1, keepdims=True)

    def more_spans(self, text: str, base: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int]]:
        """Spans outside the base spans; neighbours of one label are one span,
        but for runs that repeat a number."""
        tokens = read_tokens(text, base)
        if not len(tokens.spans) or tokens.observed.all():
            return []
        p = self.beliefs(tokens)
        label = np.where((p.max(axis=1) >= threshold) & ~tokens.observed, p.argmax(axis=1), 0)
        joined = {b for a, b in tokens.chain.tolist() if label[a] == label[b] and label[a]}
        found: list[list[int]] = []
        run, apart = -1, False
        for place in np.flatnonzero(label).tolist():
            start, end = tokens.spans[place]
            inside = place <= run
            begins = not inside and tokens.run_end[place] >= place
            if place in joined and not begins and (inside or not apart):
                found[-1][2] = end
            else:
                found.append([start, int(label[place]) - 1, end])
            run = tokens.run_end[place] if begins else run
            apart = run == place
        trimmed = (_trim(text, *span) for span in found)
        return [span for span in trimmed if _complete(text[span[0] : span[2]], KINDS[span[1]])]


def _trim(text: str, start: int, kind: int, end: int) -> tuple[int, int, int]:
    """Without the marks and letters around a number or address."""
    inner = str.isalnum if KINDS[kind] == "email" else _ASCII_DIGITS.__contains__
    while start < end and not (inner(text[start]) or (text[start] in "+(" and KINDS[kind] == "phone")):
        start += 1
    while end > start and not inner(text[end - 1]):
        end -= 1
    return start, kind, end


def _complete(text: str, kind: str) -> bool:
    """Whether an added span can stand for its kind, and is no fragment."""
    digits = _digits(text)
    if kind == "email":
        return "@" in text[1:-1]
    if kind == "ip":
        return bool(_IP.search(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return LINK_DIGITS <= len(digits) <= 15


def _logsum(values: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over axis 1."""
    top = values.max(axis=1)
    return top + np.log(np.exp(values - top[:, None]).sum(axis=1))


def _shown(docs: DataFrame) -> Column:
    """The text where it has a token of interest, else nothing: the other
    texts need not leave the JVM."""
    return F.when(docs["text"].rlike(INTEREST), docs["text"]).otherwise(F.lit(""))


def _examples(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """Shape, labels left and right, label of the key (-1: no key), label."""
    spans = base_spans(text)
    tokens = read_tokens(text, spans)
    label = tokens.label.tolist()
    key = [-1] * len(label)
    for token, number in tokens.links.tolist():
        key[token] = max(key[token], int(tokens.key_label[number]))
    left, right = [0] * len(label), [0] * len(label)
    for a, b in tokens.chain.tolist():
        left[b], right[a] = label[a], label[b]
    for place, code in enumerate(tokens.codes):
        if label[place]:
            yield code, left[place], right[place], -1, label[place]
        elif key[place] <= 0:
            yield code, left[place], right[place], key[place], 0
    for start, kind, end in spans:
        if KINDS[kind] not in ("phone", "card"):
            continue
        digits, y = _digits(text[start:end]), kind + 1
        for form in _forms(kind, digits):
            yield _code(form), 0, 0, y, y
            yield _NO_SHAPE, 0, 0, y, y
        whole = [part for part in text[start:end].split() if len(_digits(part)) >= LINK_DIGITS]
        for part in whole:
            yield _code(part), 0, 0, y, y
        for size in (3, 4):
            groups = [digits[at : at + size] for at in range(0, len(digits), size)]
            for place, group in enumerate(groups):
                yield _code(group), y * (place > 0), y * (place < len(groups) - 1), y, y


def train_field(docs: DataFrame) -> Field:
    """Potentials from counts over all documents; without any, no token gets a
    label from the field."""
    ship(docs.sparkSession)
    names = ["code", "before", "after", "mate", "label"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    totals.update(_examples(text))
        columns = list(zip(*(key + (n,) for key, n in totals.items()))) or [[]] * 6
        types = (pa.string(), *[pa.int32()] * 4, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*names, "n"])

    rows = (
        docs.select(_shown(docs).alias("text"))
        .where("text <> ''")
        .mapInArrow(count, "code string, before int, after int, mate int, label int, n bigint")
        .groupBy(*names)
        .agg(F.sum("n").alias("n"))
        # Shapes times labels of neighbours, key and token: of a fixed number,
        # some thousand rows in fact.
        .collect()
    )
    return fit_field(sorted(tuple(row) for row in rows))


def fit_field(rows: list[tuple[str, int, int, int, int, int]], steps: int = 800) -> Field:
    """Weights of highest conditional likelihood of the counted examples, drawn
    in to their start by squares: shapes to a prior for ``none``, tables to 0.
    Adam over all rows; same rows, same weights."""
    size = len(LABELS)
    doubt = np.array([1.0, *[0.05] * len(KINDS)])
    unknown = np.log(doubt / doubt.sum())
    codes = sorted({row[0] for row in rows} | {_NO_SHAPE})
    if not rows:
        return Field({}, unknown, np.zeros((size, size)), np.zeros((size, size)))
    number = {code: i for i, code in enumerate(codes)}
    shape = np.array([number[row[0]] for row in rows])
    before, after, mate, label, n = (np.array([row[i] for row in rows], np.int64) for i in range(1, 6))
    keyed = mate >= 0
    start = np.concatenate([np.repeat(unknown[None], len(codes), 0), np.zeros((2 * size, size))])
    chain, key = slice(len(codes), len(codes) + size), slice(len(codes) + size, None)
    strength = np.repeat([0.05, 0.001], [len(codes), 2 * size])[:, None]
    weights, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    wanted = np.eye(size)[label]
    for step in range(1, steps + 1):
        score = weights[shape] + weights[chain][before] + weights[chain].T[after]
        score[keyed] += weights[key][mate[keyed]]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = n[:, None] * (p / p.sum(axis=1, keepdims=True) - wanted)
        gradient = strength * (weights - start)
        np.add.at(gradient, shape, error)
        np.add.at(gradient[chain], before, error)
        np.add.at(gradient[chain].T, after, error)
        np.add.at(gradient[key], mate[keyed], error[keyed])
        gradient[number[_NO_SHAPE]] = 0  # stays at the prior
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.2 * min(1.0, 2 * (1 - step / (steps + 1)))
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Field(dict(zip(codes, weights)), unknown, weights[chain], weights[key])


def find_spans(text: str, field: Field, threshold: float) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + field.more_spans(text, base, threshold))


_NAMES = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added"]
_SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
)


def find_personal_data(docs: DataFrame, field: Field | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of every whole text (null: empty), one row per input row.

    ``n_email`` to ``n_phone`` count base spans, ``base_sha256`` is the digest
    of their list, ``spans`` lists base and added ones as ``kind:start:end``
    by start and kind (code points, end exclusive), ``n_added`` counts those
    of the field. Added spans are whole numbers or addresses: phone numbers of
    7 to 15 digits, card numbers of 12 to 19 that pass Luhn. Without ``field``
    one is trained on ``docs``. Texts of any length are read whole, one at a
    time; ``doc_id`` may be null or repeated, each row is judged on its own;
    further columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    field = field or train_field(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                if not text:
                    rows.append(nothing)
                    continue
                base, spans = find_spans(text, field, threshold)
                counts = [sum(kind == k for _, k, _ in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(show_spans(base).encode()).hexdigest()
                rows.append((*counts, digest, show_spans(spans), len(spans) - len(base)))
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], _NAMES)

    return docs.select("doc_id", _shown(docs).alias("text")).mapInArrow(find, _SCHEMA)


def mask_personal_data(docs: DataFrame, field: Field | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets,
    as ``[EMAIL]``; overlapping spans count as one of the first kind. Other
    columns and null texts stay as they are."""
    ship(docs.sparkSession)
    field = field or train_field(docs)

    def mask(text: str) -> str:
        _, spans = find_spans(text, field, threshold)
        parts, end = [], 0
        for start, kind, stop in spans:
            if start >= end:
                parts += [text[end:start], f"[{KINDS[kind].upper()}]"]
            end = max(end, stop)
        return "".join([*parts, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            masked = [mask(t) if t and _OF_INTEREST.search(t) else t for t in column.to_pylist()]
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, batch.schema.field(place), pa.array(masked, column.type))

    return docs.mapInArrow(run, docs.schema)
