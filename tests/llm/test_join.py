"""N-gram similarity against all pairs, and the parts it is made of."""

import random

import numpy as np
import pytest

from contentdup.llm import hashing, ngram_join
from contentdup.llm.components import connected_components
from contentdup.llm.hashing import Words, char_grams, word_grams
from contentdup.llm.trie_join import Forest, Trie
from contentdup.operators.among import without
from tests.llm.cases import TEXTS, documents, rows_of


def shingles(text, n):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, num, den):
    sets = [shingles(text, n) for _, text in rows]
    forest = Forest(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]) and None not in (rows[a][0], rows[b][0]):
                forest.union(a, b)
    groups = {}
    for a, (doc_id, _) in enumerate(rows):
        groups.setdefault(forest.find(a), []).append(doc_id)
    return sorted(
        ((i, len(sets[a]), None if i is None else min(groups[forest.find(a)])) for a, (i, _) in enumerate(rows)), key=repr
    )


def near_copies(seed, n_docs=120):
    source = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    bases = [[source.choice(vocabulary) for _ in range(source.randint(3, 80))] for _ in range(4)]
    rows = []
    for i in range(n_docs):
        words = list(source.choice(bases))
        for _ in range(source.randint(0, 3)):
            words[source.randrange(len(words))] = source.choice(vocabulary)
        rows.append((i, source.choice([" ", "\n", "  "]).join(words)))
    return rows + [TEXT for TEXT in TEXTS if TEXT[0] not in (5, 7)] + [(1004, "zz yy"), (1004, rows[0][1]), (9, rows[9][1])]


@pytest.mark.parametrize("paired,block", [(16, 512), (2, 8)])
def test_components_equal_all_pairs(spark, monkeypatch, paired, block):
    monkeypatch.setattr(ngram_join, "PAIRED_SETS", paired)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    monkeypatch.setattr(ngram_join, "PROBE_SETS", 5)
    rows = near_copies(block)
    got = ngram_join.ngram_components(documents(spark, rows), 4, 85, 100)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85, 100)


def test_one_large_group(spark):
    rows = [(i, " ".join(f"a{j}" for j in range(60)) + (f" x{i}" if i % 2 else "")) for i in range(1200)]
    got = ngram_join.ngram_components(documents(spark, rows), 5, 80, 100)
    assert {row.component_id for row in got.collect()} == {0}


def test_a_common_passage_makes_no_cluster(spark):
    """Texts that share a passage and are not alike: no rows but their own."""
    passage = " ".join(f"p{j}" for j in range(100))
    rows = [(i, passage + "".join(f" o{i}x{j}" for j in range(14))) for i in range(3000)]
    docs = documents(spark, rows)
    signed = ngram_join.gram_signatures(docs, 4, 85, 100)
    sets = signed.select("name", "doc_id", "n_grams", "bits")
    assert ngram_join._clusters(signed, sets, 85, 100).count() == 0
    got = ngram_join.ngram_components(docs, 4, 85, 100)
    assert {(row.doc_id, row.component_id) for row in got.collect()} == {(i, i) for i in range(3000)}


def test_common_passages_lose_no_link(spark):
    """The same with own words few enough that some texts are linked."""
    source = random.Random(11)
    passage = [f"p{j}" for j in range(60)]
    rows = []
    for i in range(150):
        words = list(passage[source.choice([0, 0, 3, 20]) :])
        for j in range(source.randint(0, 9)):
            words.insert(source.choice([0, len(words), source.randrange(len(words))]), f"o{i}x{j}")
        rows.append((i, " ".join(words)))
    got = ngram_join.ngram_components(documents(spark, rows), 4, 85, 100)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85, 100)


def test_filter_slot_zero(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 0)
    rows = near_copies(3, 40)
    got = ngram_join.ngram_components(documents(spark, rows), 4, 85, 100)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85, 100)


def test_one_row_of_elements_per_set(spark):
    docs = documents(spark, [(1, "a b c d e")] * 5 + [(1, "A b c d e"), (2, "a b c d e"), (3, "other words than those")])
    signed = ngram_join.gram_signatures(docs, 4, 85, 100)
    members = signed.where("doc_id <> 2").select("name", "doc_id").distinct()
    assert ngram_join._with_elements(docs, members, 4).groupBy("name").count().where("count > 1").isEmpty()


def test_no_documents(spark):
    assert ngram_join.ngram_components(documents(spark).where("false")).count() == 0
    assert ngram_join.ngram_components(documents(spark, [(1, None), (2, "")])).count() == 2


def test_bound_is_never_below_the_overlap():
    source = np.random.default_rng(1)
    for _ in range(300):
        pool = source.integers(0, 2**63, 60).astype(np.uint64)
        a, b = (np.unique(source.choice(pool, source.integers(1, 60))) for _ in range(2))
        bound = ngram_join.overlap_bound(len(a), ngram_join.bitmap(a), len(b), ngram_join.bitmap(b))
        assert bound >= len(np.intersect1d(a, b))


def test_trie_links_what_pairs_link():
    for seed in range(80):
        source = random.Random(seed)
        bases = [[source.randrange(10**6) for _ in range(source.randint(1, 40))] for _ in range(3)]
        sets = []
        for _ in range(source.randint(1, 25)):
            made = set(source.choice(bases))
            for _ in range(source.choice([0, 1, 2, 5])):
                made.add(source.randrange(10**6))
                made.discard(source.choice(sorted(made)))
            if made:
                sets.append(np.array(sorted(made)))
        forest, wanted = Forest(len(sets)), Forest(len(sets))
        Trie(sets).link(85, 100, forest)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    wanted.union(a, b)
        assert [forest.find(i) for i in range(len(sets))] == [wanted.find(i) for i in range(len(sets))]


def test_connected_components(spark):
    source = random.Random(7)
    links = [(source.randrange(200), source.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    forest = Forest(400)
    for a, b in links:
        forest.union(a, b)
    nodes = {n for pair in links if pair[0] != pair[1] for n in pair}
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert rows_of(got) == sorted(((n, forest.find(n)) for n in nodes), key=repr)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_star_of_many_links(spark):
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 300)] + [(5000, 5001)]
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(got) == 701 and {row.root for row in got if row.node < 5000} == {0}


def test_a_star_around_its_largest_node(spark):
    links = [(900, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 300)]
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(got) == 699 and {row.root for row in got} == {1}


def test_grams_stay_inside_texts():
    texts = [b"", b" ", b"a b", b"A\tB\nc d e", b"b c d e", b"x" * 5000 + b" y", b"c d e"]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    words = Words.of(data, bounds)
    assert words.counts.tolist() == [0, 0, 2, 5, 4, 2, 3]
    grams, at = word_grams(words, 4)
    assert np.diff(at).tolist() == [0, 0, 1, 2, 1, 1, 1]
    assert grams[at[3] + 1] == grams[at[4]] and len(set(grams.tolist())) == 5
    letters, at = char_grams(words, 3)
    assert np.diff(at).tolist() == [max(len(t) - 2, 0) for t in texts]
    assert letters[at[6]] == letters[at[4] + 2]  # "c d" in two texts


def test_character_grams_are_of_code_points():
    texts = ["", "é", "añb", "日本語のテキスト", "a日é😀b", "plain", "ño日é😀", "x" * 30 + "本語"]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))
    for chunk in (hashing.CHUNK, 5):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(hashing, "CHUNK", chunk)
            grams, at = char_grams(Words.of(data, bounds, fold=False), 2)
        windows = [t[i : i + 2] for t in texts for i in range(len(t) - 1)]
        assert np.diff(at).tolist() == [max(len(t) - 1, 0) for t in texts]
        # Equal windows have equal hashes, others different ones.
        assert len(grams) == len(windows) and len(set(zip(windows, grams.tolist()))) == len(set(windows)) == len(set(grams.tolist()))
    plain = np.frombuffer(b"plain", np.uint8)
    assert char_grams(Words.of(plain, np.array([0, 5])), 2)[0].tolist() == grams[at[5] : at[6]].tolist()


def test_rare_words_come_before_common_ones():
    """With every slot full of rare n-grams, words tell which are common."""
    source = np.random.default_rng(5)
    common = " ".join(f"c{j}" for j in source.integers(0, 6, 40_000)).encode()
    text = b"c1 c2 c3 c4 c5 c0 r1 r2 r3 r4 r5 c1 c2 c3"
    batch = [Words.of(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (common + b" " + text, text)]
    counts = np.bincount(ngram_join._slot(batch[0].hashes, ngram_join.WORD_BITS), minlength=1 << ngram_join.WORD_BITS)
    full = np.full(1 << ngram_join.FREQUENCY_BITS, 1000)
    grams = word_grams(batch[1], 4)[0]
    full[ngram_join._slot(grams[-1:], ngram_join.FREQUENCY_BITS)] = 5000
    tables = ngram_join.score_tables(full, counts)
    scores = ngram_join.gram_scores(batch[1], grams, 4, tables)
    assert set(np.argsort(scores, kind="stable")[:2].tolist()) == {6, 7}  # r1 to r4, r2 to r5
    assert scores[-1] == scores.max()
    assert len(scores) == len(grams) and scores[0] > scores[4] > scores[6]


def test_possible_links_connect_what_pairs_do():
    for seed in range(60):
        source = np.random.default_rng(seed)
        bases = [source.integers(0, 2**63, source.integers(2, 150)).astype(np.uint64) for _ in range(3)]
        sets = []
        for _ in range(25):
            own = np.append(bases[source.integers(0, 3)], source.integers(0, 2**63, source.integers(0, 30)).astype(np.uint64))
            sets.append(np.unique(own[source.integers(0, 4) :]))
        sets.sort(key=len)
        sizes, bits = np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets]
        forest, wanted = Forest(25), Forest(25)
        for a, b in ngram_join.possible_links(sizes, np.zeros(25, np.int64), bits, np.arange(25), 70, 100):
            assert forest.find(a) != forest.find(b)
            forest.union(a, b)
        for a in range(25):
            for b in range(a):
                most = ngram_join.overlap_bound(sizes[a], bits[a], sizes[b], bits[b])
                if 100 * most >= 70 * (sizes[a] + sizes[b] - most):
                    wanted.union(a, b)
        assert [forest.find(i) for i in range(25)] == [wanted.find(i) for i in range(25)]


def test_texts_with_one_passage_are_no_chain(spark, monkeypatch):
    """Each shares one of two passages with 48 others and is like none of them."""
    passage = lambda name: [f"{name}x{j}" for j in range(40)]
    rows = [(i, " ".join([*passage(f"p{i // 25}"), *passage(f"q{i % 25}"), *(f"w{i}x{j}" for j in range(4))])) for i in range(600)]
    docs = documents(spark, rows)
    signed = ngram_join.gram_signatures(docs, 4, 80, 100)
    sets = signed.select("name", "doc_id", "n_grams", "bits")
    assert ngram_join._clusters(signed, sets, 80, 100).count() == 0
    monkeypatch.setattr(ngram_join, "COMPARED_SETS", 16)
    assert ngram_join._clusters(signed, sets, 80, 100).count() == 600


def test_only_rows_of_several_sets_are_shuffled(spark):
    """The bit table comes before the shuffle, not after it."""
    items = spark.range(1000).selectExpr("id AS path", "cast(id AS string) AS text")
    keys = spark.createDataFrame([(7,), (7,), (None,)], "path bigint")
    kept = without(items.union(spark.sql("SELECT cast(null AS bigint), 'x'")), keys, 3)
    assert kept.count() == 1000 and kept.where("path IS NULL").count() == 1 and kept.where("path = 7").isEmpty()
    assert "LeftAnti" not in kept._jdf.queryExecution().optimizedPlan().toString()
