"""Top products and length buckets against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from contentdup.llm import top_products as search
from contentdup.llm.packing import best_boundaries, pack_documents
from tests.llm.cases import TEXTS, documents, rows_of


def brute(rows, every, k, scale):
    good = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        query = max(v for i, v in good if i == q)
        scored = sorted((-min(sum(a * b for a, b in zip(query, v)), 2**63 - 1), i) for i, v in good if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS slot", "'x' AS norm", "2 AS bucket")


@pytest.mark.parametrize("seed", [1, 2])
def test_top_products(spark, seed):
    source = np.random.default_rng(seed)
    made = source.normal(size=(400, 8)) * source.choice([0.05, 1, 3], size=(400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (500, rows[3][1]), (501, [float("nan")] * 8), (502, None), (503, [1.0, None])]
    rows += [(504, [float("inf")] * 8), (505, []), (506, [1.0]), (550, [2.0] * 9), (None, [1.0] * 8), (600, [0.0] * 8)]
    got = search.top_products(vectors(spark, rows), 50, 5, 256, bucket_rows=30, query_rows=4)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 50, 5, 256)


def test_numbers_beyond_double_precision(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**15, 3.0]), (2, [2.0**15, 4.0]), (3, [-1.0, 0.0])]
    got = search.top_products(vectors(spark, rows), 50, 5, 256)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 50, 5, 256)


def test_few_or_no_vectors(spark):
    assert search.top_products(vectors(spark, [(0, [1.0])]), 50, 5).count() == 0
    assert search.top_products(vectors(spark, [(0, [1.0])]).where("false"), 50, 5).count() == 0
    assert rows_of(search.top_products(vectors(spark, [(0, [1.0]), (1, [1.0])]), 50, 5)) == [(0, 1, 1, 65536)]


def test_many_buckets_and_slots(spark):
    """Lengths over several octaves, so that phases end early for most queries."""
    source = np.random.default_rng(8)
    made = source.normal(size=(3000, 6)) * np.exp2(source.integers(0, 9, size=(3000, 1)) / 2)
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    got = search.top_products(vectors(spark, rows), 30, 4, 256, bucket_rows=50, query_rows=8)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 30, 4, 256)


def test_buckets_go_where_they_are_needed(spark):
    """Of 20 buckets each of 4 slots reaches its share, and gets no other rows."""
    rows = spark.range(2000).selectExpr("id AS vec_id", "id div 100 AS bucket", "array(1.0D) AS embedding")
    lengths = spark.range(20).selectExpr("id AS bucket", "pow(2.0D, -id) AS longest")
    asked = spark.range(40).selectExpr("id AS vec_id", "id div 10 AS slot", "1.0D AS threshold", "pow(2.0D, -(id div 10)) AS reach")
    searches = search._searches(asked, lengths)
    assert searches.count() == 10 * (1 + 2 + 3 + 4)
    blocks = search._blocks_of(rows, asked.selectExpr("vec_id", "array(1.0D) AS embedding"), searches, 4)
    assert blocks.where("NOT is_query").count() == 100 * (1 + 2 + 3 + 4)
    assert blocks.where("is_query").count() == searches.count()


def test_pruning_never_loses_a_result():
    source = np.random.default_rng(5)
    ids, matrix = np.arange(2000), np.floor(source.normal(size=(2000, 16)) * 256)
    bucket = search.Bucket(ids, matrix)
    for query in matrix[:50]:
        scores = matrix @ query
        threshold = float(np.sort(scores)[-6])
        rows = bucket.candidates(query, float(np.sqrt(query @ query)), threshold)
        assert set(ids[scores >= threshold]) <= set(bucket.ids[rows])


def padded(lengths, counts, boundaries):
    return sum(c * min(b for b in boundaries if b >= n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    source = random.Random(4)
    for _ in range(60):
        lengths = sorted(source.sample(range(0, 60), source.randint(1, 8)))
        counts = [source.randint(1, 9) for _ in lengths]
        buckets = source.randint(1, 5)
        found = best_boundaries(np.array(lengths), np.array(counts), buckets)
        sets = (
            (*inner, lengths[-1])
            for k in range(min(buckets, len(lengths)))
            for inner in itertools.combinations(lengths[:-1], k)
        )
        assert len(found) <= buckets and found[-1] == lengths[-1]
        assert padded(lengths, counts, found) == min(padded(lengths, counts, s) for s in sets)
    assert best_boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def plain_boundaries(lengths, counts, buckets):
    """Every beginning of every bucket tried, the lowest of equal ones taken."""
    n, before = len(lengths), np.append(0, np.cumsum(counts))
    best, choices, totals = np.append(0, lengths * before[1:]), [np.zeros(n + 1, int)], [lengths[-1] * before[-1]]
    for _ in range(1, min(buckets, n)):
        costs = [[best[i] + lengths[j - 1] * (before[j] - before[i]) for i in range(j)] for j in range(1, n + 1)]
        choices.append(np.array([0, *(int(np.argmin(c)) for c in costs)]))
        best = np.array([0, *(min(c) for c in costs)])
        totals.append(best[n])
    found, j = [], n
    for level in range(int(np.argmin(totals)), -1, -1):
        if j:
            found.append(int(lengths[j - 1]))
            j = choices[level][j]
    return sorted(set(found))


def test_boundaries_equal_the_plain_program():
    """Also with many equal totals, where the lowest beginning counts."""
    source = random.Random(12)
    for turn in range(40):
        most = source.choice([12, 200, 10**6])
        lengths = np.array(sorted(source.sample(range(most), source.randint(1, min(60, most)))))
        counts = np.array([source.randint(1, source.choice([1, 3, 10**6])) for _ in lengths])
        buckets = source.randint(1, 9)
        assert best_boundaries(lengths, counts, buckets) == plain_boundaries(lengths, counts, buckets), turn


def test_long_texts_are_their_own_boundaries(spark):
    """Beyond any length a bucket ends at its longest text."""
    source = random.Random(5)
    rows = [(i, "w " * source.choice([3, 4099, 5129, 20020, 20021, 20333, 64001])) for i in range(120)]
    got = pack_documents(documents(spark, rows), buckets=4).collect()
    edges = {r.padded_to for r in got}
    counts = Counter(len(t.split()) for _, t in rows)
    lengths = sorted(counts)
    assert sorted(edges) == plain_boundaries(np.array(lengths), np.array([counts[n] for n in lengths]), 4)
    assert all(edge == max(r.n_tokens for r in got if r.padded_to == edge) for edge in edges)


def test_packing(spark):
    source = random.Random(9)
    rows = [(i, "w " * source.choice([0, 1, 5, 5, 40, 41, 300])) for i in range(400)] + [(3, "a b"), (None, "a")]
    got = pack_documents(documents(spark, rows), buckets=3, batch_tokens=600).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is None, i or 0, len(t.split())) for i, t in rows)
    by_bucket = {}
    for r in got:
        by_bucket.setdefault((r.bucket, r.padded_to), []).append(r)
    assert len(by_bucket) == 3
    for (_, edge), members in by_bucket.items():
        size = max(600 // max(edge, 1), 1)
        members.sort(key=lambda r: (r.batch, r.place))
        assert [(r.batch, r.place) for r in members] == [(i // size, i % size) for i in range(len(members))]
        ids = [(r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in members]
        assert ids == sorted(ids) and max(r.n_tokens for r in members) <= edge


def test_packing_edge_cases(spark):
    assert pack_documents(documents(spark).where("false")).count() == 0
    assert pack_documents(documents(spark)).count() == len(TEXTS)
