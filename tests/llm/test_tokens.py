"""Token files and word BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contentdup.llm.latin import BYTE_LEVEL_WORDS, piece_starts
from contentdup.llm.planes import BIT_PLANES, BYTE_PLANES, Blob, write_blob
from contentdup.llm.token_files import PieceEncoder, read_token_files, write_token_files
from contentdup.llm.word_bpe import LANE_SYMBOLS, WordEncoder, encode_words, merge_word, merge_words
from tests.llm.cases import TEXTS, documents, rows_of

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab'sS \n\tµªÀÞß²¼×ẗéΣσ1,.<|>\x1c\xa0  \U0001f600"


def odd_texts():
    source = random.Random(3)
    made = ["".join(source.choice(ALPHABET) for _ in range(source.randint(0, 50))) for _ in range(1500)]
    return made + [text or "" for _, text in TEXTS] + ["<|startoftext|>a<|endoftext|>", "a" * 5000, "'s'll 't"]


@pytest.mark.parametrize("planes", [BYTE_PLANES, BIT_PLANES])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_blob_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    blob = Blob(write_blob(ids, [5, -1], [n, 0], block=64, planes=planes))
    assert (blob.read_all() == ids).all()
    assert blob.doc_ids.tolist() == [5, -1] and blob.lengths.tolist() == [n, 0]
    if n > 64:
        assert (blob.read_block(1) == ids[64:128]).all()


def test_zero_planes_take_no_bytes():
    small = write_blob(np.arange(200, dtype="<u4"), [1], [200], block=100)
    assert (Blob(small)._sizes[:, 1:] == 0).all()


def test_pieces_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    texts = odd_texts()
    wanted = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert PieceEncoder(BYTES).encode(texts) == wanted


def test_pieces_begin_where_the_pattern_says():
    """Places from classes of bytes, for texts that lie one after the other."""
    source = random.Random(6)
    alphabet = "aZ'stmdrevl  \n19\xb2.,-\xe9\xdf'"
    texts = ["".join(source.choice(alphabet) for _ in range(source.randint(1, 12))) for _ in range(20_000)]
    texts += ["'", "'s", "x's", "x'S", "x're", "x'r", " 's", "\n's", "  's", "''s", "'s's", "'ll'", "x'rex", "   ", "a  \n b", "'t\n"]
    raw = "".join(texts).encode("latin-1")
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    starts = piece_starts(np.frombuffer(raw, np.uint8), bounds)
    wanted, at = [], 0
    for text in texts:
        for piece in BYTE_LEVEL_WORDS.findall(text):
            wanted.append(at)
            at += len(piece)
    assert starts.tolist() == wanted


def test_a_small_store_changes_nothing(monkeypatch):
    """Pieces that were let go are encoded again."""
    monkeypatch.setattr("contentdup.llm.token_files.CACHE_ENTRIES", 10)
    texts = odd_texts()
    small = PieceEncoder(BYTES)
    found = [ids for at in range(0, len(texts), 7) for ids in small.encode(texts[at : at + 7])]
    monkeypatch.undo()
    assert found == PieceEncoder(BYTES).encode(texts) and len(small.newer) + len(small.older) < 2000


def test_repeated_ids_in_order_of_text(spark):
    """One id for most rows: they spread over pieces and keep their order."""
    rows = [(7, f"text {i % 40:03d}") for i in range(200)] + [(1, "first"), (9, "last"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    written = write_token_files(docs, BYTES, pieces=6)
    assert written.df.select("piece").distinct().count() > 3
    library, wanted, start = Tokenizer.from_file(BYTES), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = library.encode(text).ids + [0]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(read_token_files(written.df)) == sorted(wanted, key=repr)


def test_words_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    texts = odd_texts()
    coded = [library.encode(t, add_special_tokens=False).ids for t in texts]
    wanted = [(len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)) for ids in coded]
    assert WordEncoder(WORDS).encode(texts) == wanted


def test_merging_many_words_equals_one_by_one():
    encoder = WordEncoder(WORDS)
    source = random.Random(8)
    words = ["".join(source.choice("theinanr") for _ in range(source.randint(2, LANE_SYMBOLS))) for _ in range(300)]
    symbols = [encoder._symbols(word) for word in words]
    assert merge_words(symbols, encoder.merges) == [merge_word(s, encoder.merges) for s in symbols]


@pytest.mark.parametrize("pieces", [None, 5])
def test_token_files(spark, pieces):
    library = Tokenizer.from_file(BYTES)
    written = write_token_files(documents(spark), BYTES, end_id=0, pieces=pieces)
    wanted, start = [], 0
    for doc_id, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(read_token_files(written.df)) == sorted(wanted, key=repr)


def test_word_digests(spark):
    library = Tokenizer.from_file(WORDS)
    wanted = []
    for doc_id, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        wanted.append((doc_id, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in shown)))
    assert rows_of(encode_words(documents(spark), WORDS, digests=True)) == sorted(wanted, key=repr)
    plain = {row.doc_id: row for row in encode_words(documents(spark), WORDS).collect()}
    assert plain[1].decoded.startswith("the</w> quick</w>") and plain[3].ids == ""


def test_empty_tables(spark):
    none = documents(spark).where("false")
    assert read_token_files(write_token_files(none, BYTES).df).count() == 0
    assert encode_words(none, WORDS).count() == 0
