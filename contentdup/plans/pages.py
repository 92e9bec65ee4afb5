"""Looking through large results: pages in any order, and paths that hold a text.

Both read a written table that lies in pieces, one folder each, and a small
index with what is in which piece. A page is found by its offset, so it reads
the one piece that holds it (two where it goes over an edge); many pages are one
read of all pieces that hold any of them. A search goes by
the three-letter parts of paths: only pieces that have all parts of the wanted
text are read, and the text itself is looked for there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.operators.filters import path_contains
from contentdup.operators.groups import KEYS
from contentdup.operators.settle import Settled, settle
from contentdup.plans.report import SORT_VALUES

# Rows of a piece, and bounds of the number of pieces.
ROWS_PER_PIECE = 100_000
MOST_PIECES = 100_000
# A page is found by offset in a piece of any size, and a file costs more than
# few rows: of pieces with fewer than ROWS_PER_PIECE rows a result has so many.
SMALL_PIECES = 128
PART = 3

# monotonically_increasing_id() puts the partition above the low 33 bits.
_ROW_BITS = 33


def piece_count(n_rows: int, rows_per_piece: int = ROWS_PER_PIECE) -> int:
    return max(1, min(MOST_PIECES, -(-n_rows // rows_per_piece)))


def page_piece_count(n_rows: int, rows_per_piece: int = ROWS_PER_PIECE) -> int:
    """Pieces of a result to page through: of ``rows_per_piece`` rows, or larger
    ones where those would be many small files."""
    return min(piece_count(n_rows, rows_per_piece), max(SMALL_PIECES, piece_count(n_rows)))


def _in_pieces(rows: DataFrame, order: list[Column], n_pieces: int, label: str) -> Settled:
    """Rows in order, with ``_piece`` and their ``_row`` (from 0) in it; pieces
    follow each other in that order."""
    slot = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(n_pieces, *order).sortWithinPartitions(*order).withColumn("_slot", slot)
    placed = ranged.withColumns(
        {"_row": F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)), "_piece": F.shiftright("_slot", _ROW_BITS).cast("int")}
    )
    return settle(placed.drop("_slot"), label, parts="_piece")


@dataclass
class _Order:
    table: Settled
    # Piece, first position and the position after its last row, in order.
    places: list[tuple[int, int, int]]
    # The same as rows.
    index: DataFrame
    n_rows: int


@dataclass
class ResultPages:
    """A result table (see :func:`contentdup.plans.report.result_table`) to page
    through by any displayed column, up or down.

    An order is written when a page in it is first asked for, and stays; the
    orders are those of :func:`contentdup.plans.report.sort_rows`.
    """

    rows: Settled
    rows_per_piece: int = ROWS_PER_PIECE
    _orders: dict[tuple[str, bool], _Order] = field(default_factory=dict)

    def _order(self, column: str, ascending: bool) -> _Order:
        if (column, ascending) not in self._orders:
            first = F.col(SORT_VALUES[column])
            order = [first.asc() if ascending else first.desc(), *(F.col(c).asc() for c in (*KEYS, "path"))]
            table = _in_pieces(self.rows.df, order, page_piece_count(self.rows.n_rows, self.rows_per_piece), "pages")
            counts = sorted(tuple(row) for row in table.df.groupBy("_piece").count().collect())
            ends = list(accumulate(n for _, n in counts))
            places = [(piece, end - n, end) for (piece, n), end in zip(counts, ends)]
            index = self.rows.df.sparkSession.createDataFrame(places, "_piece int, _start bigint, _end bigint")
            self._orders[column, ascending] = _Order(table, places, index, ends[-1] if ends else 0)
        return self._orders[column, ascending]

    def page(self, number: int | range, size: int = 100, column: str = "group", ascending: bool = True) -> DataFrame:
        """Rows ``number * size`` up to the next ``size``, in order, with their
        ``position`` in the whole result. Beyond the end there are none.

        A range of numbers gives all its pages by one read of the pieces that
        hold them, however many they are.
        """
        numbers = number if isinstance(number, range) else range(number, number + 1)
        if numbers.start < 0 or numbers.step < 1 or size < 1:
            raise ValueError("a page has a number from 0 and at least one row, a range of them goes up")
        order = self._order(column, ascending)
        n_pages = -(-order.n_rows // size)
        numbers = range(numbers.start, min(numbers.stop, n_pages), numbers.step)
        low, high = (numbers[0] * size, min((numbers[-1] + 1) * size, order.n_rows)) if numbers else (0, 0)
        size = max(1, min(size, order.n_rows))
        # From the start of a page to that of the next one in the range.
        period = min(numbers.step, n_pages or 1) * size
        # Pieces from the first to the last page; the index leaves out those between two pages.
        near = [piece for piece, start, end in order.places if start < high and end > low]
        start = F.greatest("_start", F.lit(low))
        into = F.pmod(start - low, F.lit(period))
        next_row = F.when(into < size, start).otherwise(start - into + period)
        hit = order.index.where(next_row < F.least("_end", F.lit(high))).drop("_end")
        read = order.table.df.where(F.col("_piece").between(near[0], near[-1]) if near else F.lit(False))
        placed = read.join(F.broadcast(hit), "_piece").withColumn("position", F.col("_row") + F.col("_start"))
        position = F.col("position")
        wanted = placed.where((position >= low) & (position < high) & (F.pmod(position - low, F.lit(period)) < size))
        return wanted.orderBy("position").drop("_piece", "_row", "_start")

    def drop(self) -> None:
        for order in self._orders.values():
            order.table.drop()
        self._orders.clear()


def _parts(text: Column) -> Column:
    """The distinct three-letter parts; none of a text that is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - (PART - 1))
    parts = F.array_distinct(F.transform(places, lambda at: F.substring(text, at, F.lit(PART))))
    return F.when(F.length(text) >= PART, parts).otherwise(F.array().cast("array<string>"))


@dataclass
class PathIndex:
    """Rows with a ``path``, to search for paths that hold a text in any case.

    The index has one row per part and piece: rows of a piece lie next to each
    other by path, so they share most of their parts.
    """

    table: Settled
    parts: Settled

    @classmethod
    def write(cls, rows: Settled, rows_per_piece: int = ROWS_PER_PIECE) -> PathIndex:
        table = _in_pieces(rows.df, [F.col("path").asc()], piece_count(rows.n_rows, rows_per_piece), "by-path")
        named = table.df.select("_piece", F.explode(_parts(F.lower("path"))).alias("part")).distinct()
        by_part = named.repartitionByRange("part", "_piece").sortWithinPartitions("part", "_piece")
        return cls(table, settle(by_part, "path-parts"))

    def pieces(self, keyword: str) -> list[int] | None:
        """Pieces that have all parts of the keyword; None: it is too short to say."""
        text = keyword.lower()
        wanted = sorted({text[at : at + PART] for at in range(len(text) - PART + 1)})
        if not wanted:
            return None
        hit = self.parts.df.where(F.col("part").isin(wanted)).groupBy("_piece").agg(F.count(F.lit(1)).alias("n"))
        return sorted(row._piece for row in hit.where(F.col("n") == len(wanted)).collect())

    def search(self, keyword: str) -> DataFrame:
        """Rows whose path holds the keyword; the empty one is in every path."""
        pieces = self.pieces(keyword)
        rows = self.table.df if pieces is None else self.table.df.where(F.col("_piece").isin(pieces))
        return path_contains(rows, keyword).drop("_piece", "_row")

    def drop(self) -> None:
        self.table.drop()
        self.parts.drop()
