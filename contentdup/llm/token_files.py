"""Token ids of a corpus as blobs of bit or byte planes, in document order.

Texts are range-partitioned by document id, encoded, and written as blobs in
the rows of a Parquet table, so Spark's own commit protocol covers lost
executors and any store that Spark can write. Reading the blobs back gives
every document's place in the whole id sequence.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.llm.common import slices, texts
from contentdup.llm.latin import NOT_PLAIN, piece_starts
from contentdup.llm.planes import BYTE_PLANES, Blob, write_blob
from contentdup.operators.settle import Settled, settle
from contentdup.ship import ship

IDS_PER_BLOB = 1 << 20
CACHE_ENTRIES = 1_500_000
CACHED_LENGTH = 48
# Text bytes encoded at once; repeated pieces among them cost little.
ENCODED_BYTES = 4 << 20

# The letters that stand for bytes in byte-level vocabularies.
# Printable bytes of Latin-1 stand for themselves, the others follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [byte for byte in range(256) if byte not in _SELF]
BYTE_LETTERS = {**{byte: byte for byte in _SELF}, **{byte: 256 + place for place, byte in enumerate(_OTHERS)}}


def _values(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a whole column without nulls, cut from its one buffer."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[: len(column) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class PieceEncoder:
    """Encode texts with a byte-level tokenizer, each distinct piece once.

    The pieces of plain texts are the words into which the tokenizer itself
    splits them. Their places come from the bytes of many texts at once, the
    distinct ones from Arrow's dictionary, and the ids of all occurrences are
    gathered from those of the distinct pieces. Pieces that were not seen go
    to the tokenizer's own model. The store has two halves: when the newer one
    is full the older one goes, except for what was used meanwhile; long pieces
    are not kept. Texts with other characters or special tokens go to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _is_plain(self, text: str) -> bool:
        return not NOT_PLAIN.search(text) and not any(token in text for token in self.special)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a piece in Latin-1; the model takes bytes as letters."""
        letters = piece.decode("latin-1").encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [token.id for token in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        found = []
        for piece in pieces:
            ids = self.newer.get(piece)
            if ids is None:
                ids = self.older.get(piece) or self._piece(piece)
                if len(piece) <= CACHED_LENGTH:
                    self.newer[piece] = ids
            found.append(ids)
        if len(self.newer) > CACHE_ENTRIES // 2:
            self.older, self.newer = self.newer, {}
        return found

    def _plain(self, values: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, none of them empty."""
        parts = [text.encode("latin-1") for text in values]
        raw = b"".join(parts)
        bounds = np.append(0, np.cumsum([len(part) for part in parts]))
        starts = piece_starts(np.frombuffer(raw, np.uint8), bounds)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        ids = self._ids_of(_values(coded.dictionary))
        number = coded.indices.to_numpy()
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(lengths) - lengths
        sizes = lengths[number]
        ends = np.append(0, np.cumsum(sizes))
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(first[number] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(starts, bounds)]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode_arrays(self, values: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        plain = [bool(text) and self._is_plain(text) for text in values]
        coded = iter(self._plain([text for text, is_plain in zip(values, plain) if is_plain]) if any(plain) else [])
        return [next(coded) if is_plain else self._whole(text) for text, is_plain in zip(values, plain)]

    def encode(self, values: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [ids.tobytes() for ids in self.encode_arrays(values)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, so that tasks share what it has seen."""
    return PieceEncoder(path)


_BLOB_SCHEMA = "piece int, seq int, n_ids bigint, n_docs bigint, blob binary"


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 0, planes: int = BYTE_PLANES, pieces: int | None = None
) -> Settled:
    """Encode every whole text (null: empty), append ``end_id`` and write the
    ids as blobs of whole documents in ascending ``doc_id``.

    Rows that repeat a ``doc_id`` are kept, ordered by text; rows without one
    come first and are stored under the smallest 64-bit number. Further
    columns are ignored. An empty table gives no blobs.
    """
    spark = docs.sparkSession
    ship(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        piece, seq = TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4")
        ids: list[np.ndarray] = []
        doc_ids: list[int] = []
        held = 0

        def blob():
            lengths = [len(part) + 1 for part in ids]
            joined = np.concatenate([part for document in ids for part in (document, end)])
            data = write_blob(joined, doc_ids, lengths, planes=planes)
            row = [[piece], [seq], [held], [len(doc_ids)], [data]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                ["piece", "seq", "n_ids", "n_docs", "blob"],
            )

        for batch in slices(batches, limit=ENCODED_BYTES):
            coded_texts = encoder.encode_arrays(batch.column("text").to_pylist())
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), coded_texts):
                ids.append(coded)
                doc_ids.append(doc_id)
                held += len(coded) + 1
                if held >= IDS_PER_BLOB:
                    yield blob()
                    ids, doc_ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield blob()

    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    # Rows that repeat a doc_id spread by how their text begins, which is in line
    # with the order of whole texts.
    order = ["doc_id", F.substring("text", 1, 32)]
    ranged = rows.repartitionByRange(pieces, *order) if pieces else rows.repartitionByRange(*order)
    return settle(ranged.sortWithinPartitions("doc_id", "text").mapInArrow(encode, _BLOB_SCHEMA), "token-blobs")


_DOC_SCHEMA = "piece int, seq int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(blobs: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the blobs.

    ``start`` counts the ids of all documents before it. Running sums see the
    blobs of one piece, and one row per piece.
    """
    ship(blobs.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, seq, data in zip(*(batch.column(c) for c in ("piece", "seq", "blob"))):
                blob = Blob(data.as_py())
                raw = memoryview(blob.read_all().tobytes())
                ends = np.cumsum(blob.lengths)
                starts = ends - blob.lengths
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                n = len(ends)
                columns = [np.full(n, piece.as_py(), np.int32), np.full(n, seq.as_py(), np.int32), blob.doc_ids, starts]
                arrays = [pa.array(c) for c in (*columns, blob.lengths, np.asarray(sums, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["piece", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])

    # Sums inside a piece, and over one row per piece.
    blobs_of = blobs.select("piece", "seq", "n_ids")
    earlier = W.partitionBy("piece").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    pieces = W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    totals = blobs_of.groupBy("piece").agg(F.sum("n_ids").alias("total"))
    offsets = totals.select("piece", F.coalesce(F.sum("total").over(pieces), F.lit(0)).alias("offset"))
    inside = blobs_of.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    places = inside.join(F.broadcast(offsets), "piece").select("piece", "seq", (F.col("inside") + F.col("offset")).alias("before"))
    found = blobs.select("piece", "seq", "blob").mapInArrow(decode, _DOC_SCHEMA)
    return found.join(places, ["piece", "seq"]).select(
        F.nullif("doc_id", F.lit(-(2**63))).alias("doc_id"),
        (F.col("start") + F.col("before")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
