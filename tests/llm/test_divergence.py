"""Divergence of sources against plain counting, in Python integers."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from contentdup.llm import divergence
from contentdup.llm.divergence import audit_sources, count_terms, gallop, pair_value, prices
from tests.llm.cases import documents, rows_of

COLUMNS = "doc_id bigint, lang string, source string, text string"


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for _, lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs, total = Counter(t for d in mine for t in set(d[2])), Counter(t for d in mine for t in d[2])
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)
        sources = sorted({d[1] for d in mine}, key=str.encode)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in sources}

        def priced(counter):
            under = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // under for t in kept}

        p, q = {s: priced(counts[s]) for s in sources}, priced(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda v: (-v[0], v[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out, key=repr)


NAMES = ["lang", "source", "part", "item", "value", "rank"]


def made(n=120, seed=5):
    draw = random.Random(seed)
    vocabulary = ["der", "Über", "x", "alpha", "BETA", "βήτα", "co-op", "3d", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [
        (i, draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "é", None]), " ".join(draw.choices(vocabulary, k=draw.randrange(30))))
        for i in range(n)
    ]
    return rows + [(n, "en", "empty", None), (n + 1, "en", "empty", "12 34"), (n + 2, "xx", "a", "rare"), (n + 3, "xx", "b", "rare"), (0, "en", "a", "x")]


def test_equals_plain_counting(spark):
    rows = made()
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("c") for c in ("term", "n", "id", "block", "value", "rank")})
    wanted = plain_audit(rows, 10, 10)
    assert rows_of(audit_sources(docs), *NAMES) == wanted
    # Many blocks of terms, some without a term of a group.
    assert rows_of(audit_sources(docs, block=3), *NAMES) == wanted
    assert rows_of(audit_sources(docs, min_docs=3, top_terms=2), *NAMES) == plain_audit(rows, 3, 2)


def test_edge_rows(spark):
    docs = documents(spark)
    found = rows_of(audit_sources(docs, min_docs=1), *NAMES)
    from tests.llm.cases import TEXTS

    assert found == plain_audit([(d, "en", "s", t) for d, t in TEXTS], 1, 10)
    assert audit_sources(docs.limit(0)).count() == 0


def test_counts_do_not_depend_on_pieces(spark, monkeypatch):
    docs = spark.createDataFrame(made(40), COLUMNS)
    wanted = rows_of(count_terms(docs))
    monkeypatch.setattr(divergence, "HELD_TERMS", 1)
    assert rows_of(count_terms(docs)) == wanted
    text = "Ab cd, éa"
    monkeypatch.setattr(divergence, "CHUNK", 1)
    assert [t for piece in divergence._pieces(text.encode().lower()) for t in piece] == [b"ab", b"cd", "éa".encode()]


def test_gallop():
    draw = np.random.default_rng(2)
    for few, many in product((0, 1, 3, 50), (0, 1, 7, 200)):
        a, b = (np.sort(draw.choice(400, n, replace=False)) for n in (few, many))
        assert gallop(a, b).tolist() == np.searchsorted(b, a).tolist()


def test_prices_of_large_counts():
    counts = np.array([0, 1, 10**12, 8 * 10**15])
    under = int(counts.sum()) + 2 * 7
    assert prices(counts, int(counts.sum()), 7).tolist() == [1 + 10**9 * (n + 2) // under for n in counts.tolist()]


def test_pair_is_the_same_both_ways():
    a = (np.array([1, 4, 9]), np.array([5, 1, 7]), 13)
    b = (np.array([0, 4]), np.array([2, 90]), 92)
    assert pair_value(a, b, 12, 12) == pair_value(b, a, 12, 12) > 0


def test_arrays_are_shuffled_once(spark):
    """The two sides of the meeting share the exchange by language and block."""
    docs = spark.createDataFrame(made(40), COLUMNS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(audit_sources(docs), *NAMES) == plain_audit(made(40), 10, 10)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
