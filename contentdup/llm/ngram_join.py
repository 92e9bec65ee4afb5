"""Near-duplicate texts by the Jaccard similarity of their word n-grams.

Exact in its links, and linear in the number of copies:

1. All n-grams are ordered by two tables of fixed size that count the hashes of
   n-grams and of words, rare ones first. Two sets that are similar enough
   share one of the first elements of each (prefix filter).
2. Texts with equal sets count once. The first element that two sets share has
   a place in each; what lies before it in either is not shared, which bounds
   the overlap. Sets whose place leaves no room for any other set of that
   element are left out. Of the rest, pairs of sets that share a prefix element
   are tested by size, places and a bitmap, which bounds the overlap too: as
   rows if the element has few sets, inside a task if it has more. Only the sets
   of an element with more than a task should compare are chained by size. All
   give clusters, and all links lie inside clusters.
3. A cluster is cut into blocks of bounded size. In a block the sets form a
   trie, which is walked for links between sets that are not yet connected.
4. All blocks of a larger cluster hold some of its sets in common, which
   joins what is alike across blocks. Then every set outside the cluster's
   largest component is compared with all its blocks.

Sets are held as 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.llm.common import slices, text_bytes, texts
from contentdup.llm.components import connected_components
from contentdup.llm.hashing import Words, gram_sums, word_grams
from contentdup.llm.trie_join import Forest, Trie
from contentdup.operators.settle import settle
from contentdup.operators.among import among, filter_bits
from contentdup.ship import ship

# Slots of the tables of n-grams and of words, and how many go in one row while
# they are summed.
FREQUENCY_BITS = 19
WORD_BITS = 18
ROW_SLOTS = 2048
# A slot counts as that of a frequent n-gram so many standard deviations above
# the others; scores are logarithms in so many steps per doubling.
DEVIATIONS = 6
STEPS = 16
# Prefix elements of up to so many sets give pairs, those of more sets and
# elements are compared in a task, others give a chain.
PAIRED_SETS = 16
COMPARED_SETS = 2048
COMPARED_ELEMENTS = 1 << 26
# Sets and elements that one block may hold (a larger set is a block's only one).
BLOCK_SETS = 512
BLOCK_ELEMENTS = 1_000_000
PROBE_SETS = 256
# Sets (about) that all blocks of one cluster have in common.
COMMON_SETS = 32
# Most bits of the filter that keeps elements of one set only out of the shuffle.
ELEMENT_BITS = 1 << 28
# Bits of the filter that keeps texts without a partner out of the shuffle.
FILTER_BITS = 24


def _grams(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """Distinct n-gram hashes of each text, ascending."""
    hashes, bounds = word_grams(Words.of(*text_bytes(batch.column("text"))), n)
    for start, stop in zip(bounds[:-1], bounds[1:]):
        yield np.unique(hashes[start:stop])


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _name(elements: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def gram_frequencies(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all n-grams, and of all words, by slot of their hash: the same
    size for any input."""
    n_slots = (1 << FREQUENCY_BITS) + (1 << WORD_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_slots, np.int64)
        grams, singles = total[: 1 << FREQUENCY_BITS], total[1 << FREQUENCY_BITS :]
        for batch in slices(batches):
            words = Words.of(*text_bytes(batch.column("text")))
            hashes, _ = word_grams(words, n)
            grams += np.bincount(_slot(hashes, FREQUENCY_BITS), minlength=len(grams))
            singles += np.bincount(_slot(words.hashes, WORD_BITS), minlength=len(singles))
        rows = total.astype("<u4").reshape(-1, ROW_SLOTS)
        places = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(places.astype(np.int32)), pa.array([rows[p].tobytes() for p in places], pa.binary())], ["place", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, counts in zip(batch.column("place").to_pylist(), batch.column("counts")):
                held = total.setdefault(place, np.zeros(ROW_SLOTS, np.int64))
                held += np.frombuffer(counts.as_buffer(), "<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["place", "counts"]
        )

    schema = "place int, counts binary"
    added = texts(docs).select("text").mapInArrow(count, schema).repartition("place").mapInArrow(add, schema)
    out = np.zeros((n_slots // ROW_SLOTS, ROW_SLOTS), np.int64)
    for row in added.collect():  # one row for each place, so a table of fixed size
        out[row.place] = np.frombuffer(row.counts, np.int64)
    return out.ravel()[: 1 << FREQUENCY_BITS], out.ravel()[1 << FREQUENCY_BITS :]


def score_tables(grams: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores by slot of n-grams and of words, and that of all words together.

    In a large corpus every slot of the n-grams is full of rare ones. Only what
    stands out from the others is known to be frequent; all else is estimated by
    its words, which are far fewer.
    """

    def score(counts: np.ndarray) -> np.ndarray:
        return np.rint(STEPS * np.log2(np.maximum(counts, 1))).astype(np.int32)

    usual = float(np.median(grams))
    known = grams - usual > DEVIATIONS * usual**0.5 + 1
    return np.where(known, score(grams - usual), np.iinfo(np.int32).min), score(words), int(score(words.sum()))


def gram_scores(words: Words, hashes: np.ndarray, n: int, tables: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Estimated frequency of each n-gram, as a logarithm: what its words give
    if they occur independently, or what its own slot tells. Equal n-grams have
    equal scores."""
    of_grams, of_words, of_all = tables
    by_words = gram_sums(words, n, of_words[_slot(words.hashes, WORD_BITS)].astype(np.int64)) - (n - 1) * of_all
    return np.maximum(by_words, of_grams[_slot(hashes, FREQUENCY_BITS)])


def gram_signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_grams, name, prefix, bits``: size and name of the set, the
    elements of which a similar set must share one, and a bitmap of the set.
    No name without words."""
    tables = docs.sparkSession.sparkContext.broadcast(score_tables(*gram_frequencies(docs, n)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, names, prefixes, bits = [], [], [], []
            words = Words.of(*text_bytes(batch.column("text")))
            hashes, bounds = word_grams(words, n)
            scores = gram_scores(words, hashes, n, tables.value)
            for start, stop in zip(bounds[:-1], bounds[1:]):
                elements, at = np.unique(hashes[start:stop], return_index=True)
                size = len(elements)
                sizes.append(size)
                names.append(_name(elements) if size else None)
                kept = size - -(-num * size // den) + 1 if size else 0
                order = np.argsort(scores[start:stop][at], kind="stable")[:kept]
                prefixes.append(elements[order].view(np.int64))
                bits.append(bitmap(elements))
            ends = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "n_grams", "name", "prefix", "bits"],
            )

    return texts(docs).mapInArrow(sign, "doc_id bigint, n_grams bigint, name bigint, prefix array<bigint>, bits binary")


def bitmap(elements: np.ndarray) -> bytes:
    """One to two bits per element, at least 64 in all."""
    size = 1 << max(6, int(len(elements) - 1).bit_length()) if len(elements) else 64
    marks = np.zeros(size, np.uint8)
    marks[(elements & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def overlap_bound(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """No overlap is larger: every bit of one set only is an element less."""
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose bitmaps leave room for the overlap needed."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")]
            kept = []
            for n_a, bits_a, n_b, bits_b in zip(*columns):
                bound = overlap_bound(n_a, bits_a, n_b, bits_b)
                kept.append(den * bound >= num * (n_a + n_b - bound))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    for side in ("a", "b"):
        one = sets.select(F.col("name").alias(side), F.col("n_grams").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.join(one, side)
    return pairs.mapInArrow(test, "a bigint, b bigint")


def _fold(bits: np.ndarray, length: int) -> np.ndarray:
    while bits.shape[1] > length:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def possible_links(sizes: np.ndarray, places: np.ndarray, bits: list[bytes], parts: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Of sets in order of size that share an element, pairs that may be linked
    and connect what ``parts`` (labels, changed here) has not connected yet.
    ``places`` are those of the element, taken as the first that they share."""
    lengths = np.array([len(b) // 8 for b in bits])
    levels, found = {}, []
    for length in np.unique(lengths):  # a larger set has no shorter bitmap
        first, last = np.searchsorted(lengths, length), np.searchsorted(lengths, length, side="right")
        levels[int(length)] = int(first), np.frombuffer(b"".join(bits[first:last]), "<u8").reshape(-1, length)
    folded = {}
    ends = np.searchsorted(sizes, den * sizes // num, side="right")
    for i in range(len(sizes) - 1):
        others = np.flatnonzero(parts[i + 1 : ends[i]] != parts[i]) + i + 1
        if not len(others):
            continue
        length = int(lengths[i])
        own = levels[length][1][i - levels[length][0]]
        for longer in np.unique(lengths[others]).tolist():
            j = others[lengths[others] == longer]
            first, rows = levels[longer]
            if (longer, length) not in folded:
                folded[longer, length] = _fold(rows, length)
            theirs = folded[longer, length][j - first]
            most = np.minimum(
                sizes[i] - np.maximum(np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64), places[i]),
                sizes[j] - np.maximum(np.bitwise_count(theirs & ~own).sum(axis=1, dtype=np.int64), places[j]),
            )
            for other in j[den * most >= num * (sizes[i] + sizes[j] - most)].tolist():
                if parts[other] != parts[i]:
                    found.append((i, other))
                    parts[parts == parts[other]] = parts[i]
    return found


def _compared(shared: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the sets of an element that may be linked, without those
    that others of the same task make needless. All sets of an element are in
    one task, so they are of bounded number and size."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, number, key, held = Forest(0), {}, None, []

        def links() -> pa.RecordBatch:
            names, sizes, places, bits = zip(*held)
            for name in names:
                if number.setdefault(name, len(number)) == len(forest.parent):
                    forest.parent.append(len(forest.parent))
            parts = np.array([forest.find(number[name]) for name in names])
            found = possible_links(np.array(sizes, np.int64), np.array(places, np.int64), bits, parts, num, den)
            for i, j in found:
                forest.union(number[names[i]], number[names[j]])
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[j] for _, j in found], pa.int64())], ["a", "b"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("element", "name", "n_grams", "place", "bits")]
            for element, *row in zip(*columns):
                if element != key:
                    if len(held) > 1:
                        yield links()
                    key, held = element, []
                held.append(row)
        if len(held) > 1:
            yield links()

    rows = shared.select("element", "name", "n_grams", "place").join(sets.select("name", "bits"), "name")
    return rows.repartition("element").sortWithinPartitions("element", "n_grams", "name").mapInArrow(link, "a bigint, b bigint")


def _chained(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Link the sets of an element, in order of size, as long as each is close
    enough in size to the one before: sets that could be linked stay
    connected, whatever lies between them.

    Rows are range-partitioned, so a frequent element spreads over pieces. In
    a piece such a run is linked to its first row; a piece's first row is
    linked to the last row of the piece before.
    """
    order = ["element", "n_grams", "name"]
    ranged = shared.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(ranged.withColumn("row_slot", F.monotonically_increasing_id()), "frequent-elements").df
    rows = rows.withColumn("piece", F.shiftright("row_slot", 33))
    last = rows.groupBy("piece").agg(F.max_by(F.struct(*order), "row_slot").alias("last"))
    before = last.select("piece", F.lag("last").over(W.orderBy("piece")).alias("before"))  # one row per piece
    in_piece = W.partitionBy("piece").orderBy("row_slot")
    goes_on = (F.col("p.element") == F.col("element")) & (F.lit(den) * F.col("p.n_grams") >= F.lit(num) * F.col("n_grams"))
    inside = rows.select("piece", "row_slot", *order, F.lag(F.struct(*order)).over(in_piece).alias("p"))
    runs = inside.withColumn("run", F.count_if(~F.coalesce(goes_on, F.lit(False))).over(in_piece))
    first = F.first("name").over(W.partitionBy("piece", "run").orderBy("row_slot"))
    to_first = runs.select(F.col("name").alias("a"), first.alias("b")).where("a <> b")
    heads = rows.groupBy("piece").agg(F.min_by(F.struct(*order), "row_slot").alias("h")).select("piece", "h.*")
    across = heads.join(before, "piece").withColumnRenamed("before", "p").where(goes_on)
    return to_first.union(across.select("name", "p.name"))


def _has_room(num: int, den: int) -> F.Column:
    """Whether a set may be linked with one whose first element in common with
    it this is. All ``place`` elements before it are not shared, nor are the
    other set's, which has at least ``least_place`` of them."""
    n_grams, place, least = (F.col(c).cast("bigint") for c in ("n_grams", "place", "least_place"))
    return F.lit(den) * (n_grams - place) >= F.lit(num) * (n_grams + least)


def _have_room(num: int, den: int) -> F.Column:
    """The same for two sets, of which all is known."""
    n_a, n_b, place_a, place_b = (F.col(c).cast("bigint") for c in ("n_a", "n_b", "place_a", "place_b"))
    most = F.least(n_a - place_a, n_b - place_b)
    return F.lit(den) * most >= F.lit(num) * (n_a + n_b - most)


def _clusters(signed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``name, root``: sets that may be linked, directly or by others."""
    elements = signed.where("name IS NOT NULL AND doc_id IS NOT NULL").select(
        "name", F.col("n_grams").cast("int").alias("n_grams"), F.posexplode("prefix").alias("place", "element")
    )
    several = elements.groupBy("element").agg(F.min("name").alias("lowest"), F.max("name").alias("highest"))
    several = settle(several.where("lowest <> highest").select("element"), "several-sets")
    # The bit filter leaves few rows to shuffle; copies of a text count once. A
    # semi-join would be moved below the filter, and all rows with it.
    bits = min(filter_bits(several.n_rows), ELEMENT_BITS)
    found = among(elements, several.df, bits, "element").join(several.df, "element").select(*elements.columns).distinct()
    near = settle(found, "near-elements")
    several.drop()
    counted = near.df.groupBy("element").agg(
        F.count(F.lit(1)).alias("n_sets"), F.sum("n_grams").alias("n_elements"), F.min("place").alias("least_place")
    )
    shared = settle(near.df.join(counted, "element").where(_has_room(num, den)), "shared-elements")
    near.drop()
    few, more = (shared.df.where(F.col("n_sets") <= PAIRED_SETS), shared.df.where(F.col("n_sets") > PAIRED_SETS))
    in_task = (F.col("n_sets") <= COMPARED_SETS) & (F.col("n_elements") <= COMPARED_ELEMENTS)
    first, second = (
        few.select("element", F.col("name").alias(n), F.col("n_grams").alias(f"n_{n}"), F.col("place").alias(f"place_{n}"))
        for n in ("a", "b")
    )
    pairs = first.join(second, "element").where((F.col("a") < F.col("b")) & _have_room(num, den)).select("a", "b").distinct()
    links = _possible(pairs, sets, num, den).union(_compared(more.where(in_task), sets, num, den))
    links = links.union(_chained(more.where(~in_task), num, den))
    components = connected_components(links)
    shared.drop()
    return components.select(F.col("node").alias("name"), "root")


def _filter_slot() -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))


def _with_elements(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Members with ``elements``, computed from their texts again.

    A bit table of fixed size keeps most other texts out; the join is exact.
    Of rows that repeat a text under one ``doc_id`` one counts.
    """
    bits = (
        members.select(_filter_slot().alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()  # at most 2^FILTER_BITS bits
    )
    table = np.zeros(((1 << FILTER_BITS) // 8) + 8192, np.uint8)
    for row in bits:
        if row.bucket == 0:  # slot 0, whose rows all pass below
            continue
        at = (row.bucket - 1) * len(row.bits)
        table[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(table)
    # Slot 0 has bucket 0 for its own; all others count from 1.
    place = F.when(F.bitmap_bucket_number("slot") == 0, F.lit(-1)).otherwise(
        (F.bitmap_bucket_number("slot") - 1) * 32768 + F.bitmap_bit_position("slot")
    )

    def collect_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column("place").to_numpy()
            hit = np.flatnonzero((at < 0) | (held.value[np.maximum(at, 0) >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
            if not len(hit):
                continue
            kept = batch.take(pa.array(hit))
            sets = [e.tobytes() for e in _grams(kept, n)]
            names = [_name(np.frombuffer(e, np.uint64)) for e in sets]
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "name", "elements"]
            )

    rows = texts(docs).where("doc_id IS NOT NULL").withColumn("slot", _filter_slot()).select("doc_id", "text", place.alias("place"))
    found = rows.mapInArrow(collect_elements, "doc_id bigint, name bigint, elements binary")
    return found.join(members, ["name", "doc_id"]).dropDuplicates(["name", "doc_id"])


def _linked(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of linked sets in rows ``root, part, name, elements, component,
    probe``; a block is one (root, part)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets, components, probes in _blocks(batches):
            forest, first = Forest(len(names)), {}
            for place, component in enumerate(components):
                forest.union(first.setdefault(component, place), place)
            found = Trie(sets).link(num, den, forest, None if probes.all() else probes)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[j] for _, j in found], pa.int64())],
                    ["a", "b"],
                )

    rows = blocks.select("root", "part", "name", "component", "probe", "elements")
    return (
        rows.repartition("root", "part").sortWithinPartitions("root", "part", "name", F.desc("probe")).mapInArrow(walk, "a bigint, b bigint")
    )


def _blocks(batches: Iterator[pa.RecordBatch]):
    """The sets of one block at a time; of rows that repeat a set one counts,
    if there is one, that probes."""
    key, held = None, []

    def block():
        names, components, probes, sets = zip(*held)
        return names, [np.frombuffer(s, np.uint64) for s in sets], components, np.array(probes)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("root", "part", "name", "component", "probe", "elements")]
        for root, part, *row in zip(*columns):
            if (root, part) != key:
                if held:
                    yield block()
                key, held = (root, part), []
            if not held or held[-1][0] != row[0]:
                held.append(row)
    if held:
        yield block()


def _part(pieces: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), "name"), F.col(pieces)).cast("bigint")


def _every(count: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def set_components(docs: DataFrame, signed: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``name, root`` of all sets that are linked; ``sets`` has ``name,
    doc_id, n_grams, bits``, one row per set."""
    clustered = sets.select("name", "doc_id", "n_grams").join(_clusters(signed, sets, num, den), "name")
    clustered = settle(clustered, "clustered")
    sizes = clustered.df.groupBy("root").agg(
        F.count(F.lit(1)).alias("n_sets"),
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)), F.ceil(F.sum("n_grams") / F.lit(BLOCK_ELEMENTS))).cast("int").alias("pieces"),
    )
    members = clustered.df.join(sizes, "root")
    elements = settle(_with_elements(docs, members, n), "cluster-sets")
    clustered.drop()
    whole = elements.df
    home = whole.select("*", _part("pieces", 1).alias("part"))
    is_common = F.pmod(F.xxhash64(F.lit(2), "name"), F.col("n_sets")) < COMMON_SETS
    guests = whole.where((F.col("pieces") > 1) & is_common).select("*", _every("pieces").alias("part"))
    blocks = home.union(guests).withColumns({"component": F.col("name"), "probe": F.lit(True)})
    links = settle(_linked(blocks, num, den), "links-in-blocks").df
    found = connected_components(links)

    # What lies outside the largest component is compared with every block.
    wide = whole.where("pieces > 1").select("root", "name", "pieces")
    if wide.isEmpty():
        elements.drop()
        return found
    placed = wide.join(found.select(F.col("node").alias("name"), F.col("root").alias("component")), "name", "left")
    placed = settle(placed.withColumn("component", F.coalesce("component", "name")), "wide-components").df
    counts = placed.groupBy("root", "component").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("root").agg(F.max_by("component", F.struct("n", "component")).alias("major"))
    outside = placed.join(major, "root").where("component <> major").drop("major")
    chunks = outside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(PROBE_SETS)).cast("int").alias("chunks"))
    columns = ["root", "name", "component", "piece", "chunk"]
    probes = outside.join(chunks, "root").select("*", _part("chunks", 3).alias("chunk"), _every("pieces").alias("piece"))
    others = placed.join(chunks, "root").select("*", _part("pieces", 1).alias("piece"), _every("chunks").alias("chunk"))
    both = probes.select(*columns, F.lit(True).alias("probe")).union(others.select(*columns, F.lit(False).alias("probe")))
    blocks = both.withColumn("part", F.col("piece").cast("bigint") * F.lit(1 << 31) + F.col("chunk"))
    more = settle(_linked(blocks.join(whole.select("name", "elements"), "name"), num, den), "links-outside").df
    elements.drop()
    return found if more.isEmpty() else connected_components(links.union(more))


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Group texts that are linked: ``den * |x & y| >= num * |x | y|`` over
    their sets of ``n``-word shingles (A-Z in lower case; words are runs of
    characters other than space and 0x09 to 0x0D).

    Returns ``doc_id, n_shingles, component_id``, one row per input row; the
    component is the smallest ``doc_id`` that links reach. A text with fewer
    than ``n`` words has its whole sequence as its only shingle. A text without
    words (or null) has an empty set and is linked with nothing. Rows without
    ``doc_id`` have no component and link nothing. Rows that repeat a
    ``doc_id`` with another text are placed by their own texts. Further columns
    are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    signed = settle(gram_signatures(docs, n, num, den), "signatures").df
    sets = settle(
        signed.where("name IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("name")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.count(F.lit(1)).alias("copies"),
            F.min("n_grams").alias("n_grams"),
            F.first("bits").alias("bits"),
        ),
        "sets",
    ).df
    placed = set_components(docs, signed, sets, n, num, den).select(F.col("node").alias("name"), "root")
    grouped = settle(sets.select("name", "doc_id", "copies").join(placed, "name", "left"), "grouped-sets").df
    smallest = grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # Sets of one text without links need no look-up.
    known = (
        grouped.where("root IS NOT NULL OR copies > 1")
        .join(smallest, "root", "left")
        .select("name", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
    return (
        signed.select("doc_id", "n_grams", "name")
        .join(known, "name", "left")
        .select(
            "doc_id",
            F.col("n_grams").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )
