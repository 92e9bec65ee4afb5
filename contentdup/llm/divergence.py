"""How far the sources of a language differ in their words.

Every (language, source) group is a sorted array of (term id, count) per block
of term ids. The arrays of two groups meet once per unordered pair and block;
a galloping intersection finds the terms that both use. These are priced
alone, those that one side uses against the other's price of an absent term,
and all further terms of the block at once. Everything is exact in integers.

Counting combines in the tasks before the one shuffle by term. Blocks bound the arrays, so
neither a large vocabulary nor a group with most of the text ends in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.llm.common import slices
from contentdup.llm.ordering import number_within
from contentdup.operators.settle import settle
from contentdup.ship import ship

_TERM = re.compile(rb"[a-z\x80-\xff]+")
# Bytes of a text that are split into terms at once.
CHUNK = 1 << 20
_GAP = re.compile(rb"[^a-z\x80-\xff]")
# Terms that a task holds before it hands its counts on (some 200 bytes each).
HELD_TERMS = 500_000
# Terms of a language in one block.
BLOCK = 4096
MIN_DOCS = 10
SCALE = 1_000_000_000


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        gap = _GAP.search(data, min(at + CHUNK, len(data)))
        end = gap.start() if gap else len(data)
        yield _TERM.findall(data, at, end)
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences, and documents with the
    term, per group. Each task adds up its own rows first."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Occurrences and documents of each term, by group.
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def handed_on():
            for (lang, source), (n, n_docs) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                counts = [np.fromiter(values, np.int64, len(n)) for values in (n.values(), map(n_docs.__getitem__, n))]
                names = [pa.repeat(pa.scalar(name, pa.string()), len(n)) for name in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, terms, *map(pa.array, counts)], ["lang", "source", "term", "n", "n_docs"])

        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                seen: set[bytes] = set()
                for words in _pieces(text.encode().lower()):
                    if (lang, source) not in held:
                        held[lang, source] = Counter(), Counter()
                    n, n_docs = held[lang, source]
                    size -= len(n)
                    n.update(words)
                    size += len(n)
                    seen.update(words)
                if seen:
                    n_docs.update(seen)
                if size >= HELD_TERMS:
                    yield from handed_on()
                    held, size = {}, 0
        yield from handed_on()

    named = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = named.mapInArrow(count, "lang string, source string, term string, n bigint, n_docs bigint")
    # All groups of a term come together, so that what a language has of it is
    # known without a further shuffle.
    return partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def price(n: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 n_terms)), beyond 64 bits inside."""
    over = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total + 2 * n_terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", over, under)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def prices(n: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """As :func:`price`; long division in three steps stays inside 64 bits up
    to 9 * 10^15 occurrences in a group."""
    left, under, quotient = n + 2, total + 2 * n_terms, 0
    for _ in range(3):
        left = left * 1000
        quotient = quotient * 1000 + left // under
        left = left % under
    return 1 + quotient


def differences(p, q):
    return (p - q) * (p - q) // (p + q)


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where each of the sorted numbers ``few`` stands in the sorted ``many``,
    or would stand.

    All searches run at once. Each starts at the place of the same share of
    ``many``, doubles its steps until it has passed the number, and then
    halves what lies between.
    """
    n = len(many)
    if not n:
        return np.zeros(len(few), np.int64)
    guess = np.arange(len(few)) * n // max(len(few), 1)
    rising = many[guess] < few
    low, high = np.where(rising, guess + 1, 0), np.where(rising, n, guess)
    moving, step = np.arange(len(few)), 1
    while len(moving):
        probe = guess[moving] + np.where(rising[moving], step, -step)
        inside = (probe >= 0) & (probe < n)
        moving, probe = moving[inside], probe[inside]
        smaller = many[probe] < few[moving]
        low[moving[smaller]] = probe[smaller] + 1
        high[moving[~smaller]] = probe[~smaller]
        moving, step = moving[smaller == rising[moving]], step * 2
    while len(moving := np.flatnonzero(low < high)):
        middle = (low[moving] + high[moving]) // 2
        smaller = many[middle] < few[moving]
        low[moving[smaller]] = middle[smaller] + 1
        high[moving[~smaller]] = middle[~smaller]
    return low


def pair_value(a: tuple, b: tuple, n_block: int, n_terms: int) -> int:
    """Sum of the differences over all terms of a block, for two groups given
    as sorted term ids, counts and total count."""
    if not n_block:
        return 0
    (ids_a, n_a, total_a), (ids_b, n_b, total_b) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    p, q = prices(n_a, total_a, n_terms), prices(n_b, total_b, n_terms)
    nothing = np.zeros(1, np.int64)
    p0, q0 = int(prices(nothing, total_a, n_terms)[0]), int(prices(nothing, total_b, n_terms)[0])
    at = gallop(ids_a, ids_b)
    shared = at < len(ids_b)
    shared[shared] = ids_b[at[shared]] == ids_a[shared]
    only_b = np.ones(len(ids_b), bool)
    only_b[at[shared]] = False
    value = int(differences(p[shared], q[at[shared]]).sum())
    value += int(differences(p[~shared], q0).sum()) + int(differences(p0, q[only_b]).sum())
    absent = n_block - len(ids_a) - int(only_b.sum())
    return value + absent * differences(p0, q0)


def _pair_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def arrays(column):
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        return [flat[i:j].astype(np.int64) for i, j in zip(offsets[:-1], offsets[1:])]

    for batch in batches:
        sides = []
        for side in "ab":
            totals = batch.column(f"{side}_total").to_pylist()
            sides.append(list(zip(arrays(batch.column(f"{side}_ids")), arrays(batch.column(f"{side}_counts")), totals)))
        sizes = zip(batch.column("n_block").to_pylist(), batch.column("n_terms").to_pylist())
        values = [pair_value(a, b, *size) for a, b, size in zip(*sides, sizes)]
        keys = ["lang", "a_source", "b_source"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(values, pa.int64())], [*keys, "value"])


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = 10, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: for each group all other sources of its language, by falling
    divergence. Part ``term``: the ``top_terms`` terms that the group uses more
    than its language does, by falling divergence; ties by item.

    Null texts, languages and sources count as empty ones. A group without
    terms is compared all the same; a language whose terms are all rare has the
    value 0 everywhere. Rows that repeat count as often as they are there, very
    long texts are counted piece by piece. Further columns are ignored; an
    empty table gives no rows.
    """
    in_lang = W.partitionBy("lang", "term")
    counted = count_terms(docs).select(
        "lang", "source", "term", "n", F.sum("n").over(in_lang).alias("lang_n"), F.sum("n_docs").over(in_lang).alias("lang_docs")
    )
    frequent = settle(counted.where(F.col("lang_docs") >= min_docs).drop("lang_docs"), "frequent-terms").df
    kept = settle(frequent.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")), "kept-terms").df
    numbered = number_within(kept, "lang", ["term"], "numbered-terms")
    vocabulary = settle(numbered.select("lang", "term", "lang_n", (F.col("pos") - 1).alias("id")), "vocabulary").df
    used = settle(frequent.join(vocabulary.drop("lang_n"), ["lang", "term"]), "used-terms").df

    # One row per language, one per group.
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    occurring = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = settle(groups.na.fill(0, ["total", "n_terms", "lang_total"]), "source-groups").df

    pairs = _pairs(used, groups, block)
    terms = _terms(used, groups, top_terms)
    return pairs.unionByName(terms)


def _pairs(used: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    number = F.floor(F.col("id") / block).cast("bigint")
    entry = F.struct((F.col("id") - number * block).cast("int").alias("id"), "n")
    arrays = used.groupBy("lang", "source", number.alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    # Every group has every block, so that absent terms are priced as well.
    zero = F.lit(0).cast("bigint")
    blocks = F.explode(F.sequence(zero, F.greatest(F.ceil(F.col("n_terms") / block) - 1, zero)))
    sides = groups.select("lang", "source", "total", "n_terms", blocks.alias("block")).join(arrays, ["lang", "source", "block"], "left")
    sides = settle(
        sides.select(
            "lang",
            "block",
            "source",
            "total",
            "n_terms",
            F.coalesce(F.col("entries.id"), F.array().cast("array<int>")).alias("ids"),
            F.coalesce(F.col("entries.n"), F.array().cast("array<bigint>")).alias("counts"),
        ),
        "term-arrays",
    ).df
    size = F.least(F.col("n_terms") - F.col("block") * block, F.lit(block)).cast("bigint")

    def side(name: str, *more: Column) -> DataFrame:
        return sides.select("lang", "block", *(F.col(c).alias(f"{name}_{c}") for c in ("source", "total", "ids", "counts")), *more)

    # The arrays of a block lie in one task and meet there once per pair.
    met = side("a", F.col("n_terms"), size.alias("n_block")).join(side("b"), ["lang", "block"]).where("a_source < b_source").drop("block")
    ship(groups.sparkSession)
    valued = met.mapInArrow(_pair_values, "lang string, a_source string, b_source string, value bigint")
    summed = settle(valued.groupBy("lang", "a_source", "b_source").agg(F.sum("value").alias("value")), "pair-values").df
    both = summed.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "value").unionByName(
        summed.select("lang", F.col("b_source").alias("source"), F.col("a_source").alias("item"), "value")
    )
    return _ranked(both, "pair")


def _terms(used: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    priced = used.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        F.col("term").alias("item"),
        price(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"),
        price(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).alias("q"),
    )
    more = priced.where("p > q").select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))
    return _ranked(more, "term").where(F.col("rank") <= top_terms)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))
