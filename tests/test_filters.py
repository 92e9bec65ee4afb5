import pytest
from pyspark.sql import functions as F

from contentdup.operators.filters import audit, audit_counts, keep_items, path_contains
from contentdup.operators.groups import distinct_paths, scan_difference
from contentdup.spec import ScanSpec

FILES = {
    "/a.txt": b"12345",
    "/b.log": b"x" * 1400,
    "/.hidden.txt": b"h",
    "/.git/deep/c.txt": b"g",
    "/skip/deep/d.txt": b"s" * 13000,
    "/keep/skip.txt": b"",
}


@pytest.mark.parametrize(
    "spec, dropped",
    [
        (ScanSpec(), set()),
        (ScanSpec(exclude=("*.log",)), {"/b.log"}),
        (ScanSpec(exclude_hidden=True), {"/.hidden.txt", "/.git/deep/c.txt"}),
        (ScanSpec(exclude_dirs=("skip", "deep")), {"/skip/deep/d.txt", "/.git/deep/c.txt"}),
        (ScanSpec(min_bytes=5, max_bytes=1400), set(FILES) - {"/a.txt", "/b.log"}),
        (ScanSpec(min_bytes=5, max_bytes=1401, inclusive=False), set(FILES) - {"/b.log"}),
        (ScanSpec(min_bytes=1), {"/keep/skip.txt"}),
    ],
)
def test_each_rule(corpus, spec, dropped):
    items = corpus(FILES)
    kept = {r.path for r in keep_items(items, spec).select("path").collect()}
    assert kept == set(FILES) - dropped
    audited = {r.path: r.reason for r in audit(items, spec).collect()}
    assert {path for path, reason in audited.items() if reason == "kept"} == kept
    assert len(audited) == len(FILES)


def test_audit_names_the_first_rule(corpus, spark):
    spec = ScanSpec(min_bytes=1, max_bytes=1000, exclude=("*.log", "d*"), exclude_dirs=("skip", ".git"), exclude_hidden=True)
    items = corpus(FILES).withColumn("is_symlink", F.col("path") == "/a.txt").withColumn(
        "size_bytes", F.when(F.col("path") != "/keep/skip.txt", F.col("size_bytes"))
    )
    assert {r.path: r.reason for r in audit(items, spec).collect()} == {
        "/a.txt": "symlink",
        "/b.log": "excluded_file",
        "/.hidden.txt": "hidden",
        "/.git/deep/c.txt": "hidden",
        "/skip/deep/d.txt": "excluded_dir",
        "/keep/skip.txt": "unreadable",
    }
    counts = {r.reason: (r.n_files, r.total_bytes) for r in audit_counts(audit(items, spec)).collect()}
    assert counts["hidden"] == (2, 2) and counts["unreadable"] == (1, 0)


def test_rows_without_content_drop_out(spark, corpus):
    assert keep_items(corpus({"/a": None, "/b": b""}), ScanSpec()).count() == 1


def test_keyword(corpus):
    items = corpus(FILES)
    assert path_contains(items, "").count() == len(FILES)
    assert {r.path for r in path_contains(items, "SKIP").collect()} == {"/skip/deep/d.txt", "/keep/skip.txt"}


def test_overlapping_inventories(corpus):
    items = corpus(FILES).select("path", "size_bytes")
    both = items.unionByName(items)
    assert distinct_paths(both).count() == len(FILES)
    assert tuple(scan_difference(items, items).first()) == (0, 0)
    assert tuple(scan_difference(both, items.where("size_bytes > 0")).first()) == (len(FILES) + 1, 0)
