"""The manifest against a plain tree built row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from contentdup.llm.merkle import merkle_manifest
from contentdup.llm.queries import op12_slot_pivot
from tests.llm.cases import TEXTS, documents

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return None if text is None else "".join(c.lower() if c.isascii() else c for c in text)


def proofs(nodes):
    """The top, and for each node its (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            paths[i].append((run[: place % 8], run[place % 8 + 1 :]))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], paths


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (mine, *proofs([leaf_of(r) for r in mine]))
    root, above = proofs([trees[lang][1] for lang in langs])
    out = []
    for lang, tops in zip(langs, above):
        mine, subroot, paths = trees[lang]
        for row, path in zip(mine, paths):
            path = path + tops
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf_of((*row[:4], lowered(row[4]))) if altered else leaf_of(row)
            for left, right in path:
                folded = H(*left, folded, *right)
            proof = H(*(h for left, right in path for h in left + right))
            out.append((row[0], leaf_of(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(partitions).withColumns({c: F.lit("x") for c in ("key", "place", "digest", "slot1", "is_top")})
    found = merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return sorted((tuple(r[c] for c in NAMES) for r in found.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 9, 73])
def test_equals_plain_tree(spark, n):
    rows = [(i, f"S{i % 3}", None if i % 11 == 5 else "en" if i % 5 else "dé", i, f"Text Ä {i}") for i in range(n)]
    assert manifest(spark, rows) == plain_manifest(rows)


def test_many_groups_and_one_large(spark):
    """More groups than one run holds; most rows in one of them."""
    rows = [(i, "s", "en", i, "Word " * (i % 4)) for i in range(600)]
    rows += [(1000 + i, "s", f"l{i}", i, f"T{i}") for i in range(20)]
    found = manifest(spark, rows, 7)
    assert found == plain_manifest(rows)
    assert {row[6] for row in found} == {True, False}


def test_edge_rows(spark):
    docs = documents(spark)
    rows = [(d, "s", "en", 1, t) for d, t in TEXTS] + [(None, None, None, None, None)] * 2 + [(9, "s", "", 1, "A"), (9, "s", "", 1, "a")]
    assert manifest(spark, rows) == plain_manifest(rows)
    found = merkle_manifest(docs, F.lit(False))
    assert found.count() == docs.count() and found.where("NOT verified").isEmpty()
    assert merkle_manifest(docs.limit(0), F.lit(True)).count() == 0


def test_a_change_of_a_neighbour_changes_the_root(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(20)]
    changed = rows[:7] + [(7, "s", "en", 1, "text 7.")] + rows[8:]
    first, second = manifest(spark, rows), manifest(spark, changed)
    assert first[0][3] != second[0][3]
    assert [a[1] == b[1] for a, b in zip(first, second)].count(False) == 1


def test_levels_have_an_eighth_of_the_rows(spark):
    """No level joins or groups by the key alone: every exchange holds the place."""
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(100)]
    plan = merkle_manifest(spark.createDataFrame(rows, COLUMNS), F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query(spark):
    found = op12_slot_pivot(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r[c] for c in NAMES) for r in found.collect()), key=repr) == plain_manifest(rows)
