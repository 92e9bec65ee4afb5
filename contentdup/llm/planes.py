"""A container for token ids whose blocks are stored as byte or bit planes.

A blob holds whole documents. Their ids are cut into blocks of a fixed number
of ids; a block is transposed into planes, and every plane is compressed on
its own (a plane of zeros takes no bytes). The chunk index behind the planes
gives the place of every plane, so one block can be read without the others.

Layout: header, planes, index (one row of lengths per block), document ids,
document lengths, trailer. All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"CDPLANE1"
_HEADER = struct.Struct("<8sIIQ")  # magic, planes per block, ids per block, number of ids
_TRAILER = struct.Struct("<QQQQ")  # number of documents, bytes of index, of document ids, of lengths
BYTE_PLANES, BIT_PLANES = 4, 32


def _to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    parts = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == BIT_PLANES:
        bits = np.unpackbits(parts, axis=1, bitorder="little")
        return [plane.tobytes() for plane in np.packbits(bits.T, axis=1, bitorder="little")]
    return [np.ascontiguousarray(plane).tobytes() for plane in parts.T]


def _from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == BIT_PLANES:
        width = -(-n // 8)
        packed = np.frombuffer(b"".join(p or bytes(width) for p in planes), np.uint8).reshape(BIT_PLANES, width)
        bits = np.unpackbits(packed, axis=1, count=n, bitorder="little")
        parts = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        parts = np.empty((n, BYTE_PLANES), np.uint8)
        for place, plane in enumerate(planes):
            parts[:, place] = np.frombuffer(plane, np.uint8) if plane else 0
    return np.ascontiguousarray(parts).view("<u4").reshape(-1)


def write_blob(
    ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, block: int = 1 << 16, planes: int = BYTE_PLANES, level: int = 1
) -> bytes:
    """The blob of ``ids``; document ``i`` has ``doc_ids[i]`` and ``lengths[i]`` ids."""
    packer = zstandard.ZstdCompressor(level=level)
    body, index = [], []
    for start in range(0, len(ids), block):
        packed = [packer.compress(plane) if any(plane) else b"" for plane in _to_planes(ids[start : start + block], planes)]
        body += packed
        index.append([len(part) for part in packed])
    tail = [np.asarray(part, "<i8").tobytes() for part in (index, doc_ids, lengths)]
    tail = [tail[0], packer.compress(tail[1]), packer.compress(tail[2])]
    header = _HEADER.pack(MAGIC, planes, block, len(ids))
    return b"".join([header, *body, *tail, _TRAILER.pack(len(doc_ids), *map(len, tail))])


class Blob:
    """Reader of one blob."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.planes, self.block, self.n_ids = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a blob of token ids")
        n_docs, *sizes = _TRAILER.unpack_from(data, len(data) - _TRAILER.size)
        ends = len(data) - _TRAILER.size - np.cumsum([0, *sizes[::-1]])[::-1]
        index, docs, lengths = (self.data[a:b] for a, b in zip(ends[:-1], ends[1:]))
        unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids = np.frombuffer(unpack(docs), "<i8")[:n_docs]
        self.lengths = np.frombuffer(unpack(lengths), "<i8")[:n_docs]
        self._sizes = np.frombuffer(index, "<i8").reshape(-1, self.planes)
        self._starts = _HEADER.size + np.cumsum(self._sizes.ravel()) - self._sizes.ravel()

    def read_block(self, number: int) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        n = min(self.block, self.n_ids - number * self.block)
        first = number * self.planes
        parts = [
            unpack(self.data[start : start + size]) if size else b""
            for start, size in zip(self._starts[first : first + self.planes], self._sizes[number])
        ]
        return _from_planes(parts, n)

    def read_all(self) -> np.ndarray:
        blocks = [self.read_block(number) for number in range(len(self._sizes))]
        return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")
