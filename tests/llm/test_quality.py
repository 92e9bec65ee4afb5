"""Both quality operators: counts against plain Python, held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from contentdup.llm import quality, rules
from contentdup.llm.stats import FEATURES
from tests.llm.cases import LONG, TEXTS, documents, labels, rows_of


def corpus(seed, n=500):
    """Prose, and three kinds of junk."""
    source = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(source.choice("aeinrstl") for _ in range(source.randint(1, 9))) for _ in range(source.randint(60, 200))]
        good = source.random() < 0.7
        if not good:
            kind = source.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + source.choice(["***", "$$$"]) for w in words] if kind == 1 else words[:4] * 30
        rows.append((i, " ".join(words)))
        marks.append((i, int(good)))
    return rows, marks


@pytest.fixture(scope="module")
def data():
    return corpus(1)


def test_kernel_scores_unseen_rows(spark, data):
    rows, marks = data
    known = [m for m in marks if m[0] % 4 != 2]
    docs = documents(spark, rows + TEXTS[1:4])
    scored = quality.score_quality(docs, labels(spark, known + known[:5] + [(None, 1), (7, None)])).collect()
    truth = dict(marks)
    unseen = [r for r in scored if r.doc_id % 4 == 2 and r.doc_id > 7]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored) and len(scored) == len(rows) + 3


def test_kernel_without_labels(spark):
    scored = quality.score_quality(documents(spark), labels(spark, []))
    assert rows_of(scored, "score", "predicted") == [(0.5, 0)] * len(TEXTS)
    assert quality.score_quality(documents(spark).where("false"), labels(spark, [(1, 1)])).count() == 0


def test_labels_of_one_class(spark):
    scored = quality.score_quality(documents(spark), labels(spark, [(i, 1) for i in range(1, 8)]))
    assert all(np.isfinite(row.score) for row in scored.collect())


def test_sums_equal_one_matrix(spark, data):
    rows, marks = data
    table = quality.feature_table(documents(spark, rows)).join(labels(spark, marks).select("doc_id", "quality"), "doc_id")
    table = table.withColumn("quality", table.quality.cast("double"))
    model = quality.QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(quality.COMPONENTS + 1), np.zeros(1), np.zeros(1))
    gram, right = quality._summed(table.repartition(7), model)
    frame = table.toPandas()
    z = model.components(frame[FEATURES].to_numpy())
    assert np.allclose(gram, z.T @ z) and np.allclose(right, z.T @ frame["quality"])


def test_isotonic_is_the_best_monotone_fit():
    source = np.random.default_rng(3)
    for _ in range(30):
        values, weights = source.random(12), source.integers(1, 5, 12).astype(float)
        fit = quality._isotonic(values, weights)
        assert (np.diff(fit) >= -1e-12).all()
        # Largest over starts of smallest over ends of the mean of a stretch.
        best = [max(min(np.average(values[a : b + 1], weights=weights[a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(fit, best)


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_rule_counts(spark, data):
    rows, marks = data
    source = random.Random(4)
    made = [(10_000 + i, "".join(source.choice("a aB\n#é\t\x85| ") for _ in range(source.randint(0, 150)))) for i in range(200)]
    every = rows[:100] + made + TEXTS
    model = rules.train_rule_model(documents(spark, rows), labels(spark, marks))
    got = rules.apply_rules(documents(spark, every), model)
    wanted = [(i, *counted(text or "")) for i, text in every]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(got, *names) == sorted(wanted, key=repr)
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    kept = rules.keep_by_rules(documents(spark, every), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.where("kept").collect())
    assert kept.columns == documents(spark).columns


def test_rules_on_unseen_rows(spark, data):
    rows, marks = data
    model = rules.train_rule_model(documents(spark, rows), labels(spark, [m for m in marks if m[0] % 4 != 2] + [(None, 1)]))
    again = rules.train_rule_model(documents(spark, rows).repartition(5), labels(spark, [m for m in marks if m[0] % 4 != 2]))
    assert np.allclose(model.weights, again.weights) and model.slope == pytest.approx(again.slope)
    fresh, truth = corpus(2, 200)
    verdicts = {r.doc_id: r.kept for r in rules.apply_rules(documents(spark, fresh), model).collect()}
    assert np.mean([verdicts[i] == bool(q) for i, q in truth]) > 0.95


def test_rules_take_one_row_of_a_repeated_id(spark, data):
    rows, marks = data
    once = rules.train_rule_model(documents(spark, rows[:100]), labels(spark, marks[:100]))
    more = rows[:100] + [(i, text + " ~") for i, text in rows[:40]] + rows[:40]
    again = rules.train_rule_model(documents(spark, more), labels(spark, marks[:100]))
    assert np.allclose(once.weights, again.weights) and once.slope == pytest.approx(again.slope)


def test_rules_without_labels(spark):
    model = rules.train_rule_model(documents(spark), labels(spark, []))
    got = rules.apply_rules(documents(spark), model).collect()
    assert {r.p_quality for r in got} == {0.5} and len(got) == len(TEXTS)
    assert rules.apply_rules(documents(spark).where("false"), model).count() == 0
    assert counted(LONG)[0] == 30_001
