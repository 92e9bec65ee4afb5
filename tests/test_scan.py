import random

import pytest
from pyspark.sql import functions as F

from contentdup.operators import groups as g
from contentdup.operators.filters import audit, keep_items
from contentdup.operators.settle import settle
from contentdup.operators.summary import corpus_stats, scan_funnel, scan_summary, space_savings
from contentdup.plans.scan import (
    candidates_by_size,
    digest_items,
    digest_stages,
    quick_false_positives,
    scan_groups,
    scan_items,
)
from contentdup.sources.synthetic import plant_copies
from contentdup.sources.tables import table_items
from contentdup.spec import ScanSpec
from tests.conftest import expected_groups, flat
from tests.llm.cases import rows_of

QUICK, FULL, REGIONS = (ScanSpec(mode=m) for m in ("quick", "full", "multi_region"))
REGIONS_ONLY = ScanSpec(mode="multi_region", verify=False)


def demo():
    text, image, config, large = b"t" * 700, b"i" * 4500, b"c" * 170, b"l" * 32000
    return {
        "/d/report.txt": text, "/d/report_copy.txt": text, "/b/report.txt": text,
        "/p/a.jpg": image, "/p/b.jpg": image, "/d/s.conf": config, "/b/s.conf": config,
        "/d/large.txt": large, "/b/large.txt": large,
        "/d/u.txt": b"u" * 49, "/p/u.png": b"v" * 47, "/b/u.dat": b"w" * 42,
    }


@pytest.mark.parametrize("spec", [QUICK, FULL, REGIONS, REGIONS_ONLY, ScanSpec(algorithm="blake2b")])
def test_demo_corpus(corpus, spec):
    scan = scan_items(corpus(demo()), spec)
    assert flat(scan.member_rows) == expected_groups(demo())
    summary = scan_summary(scan.groups).first()
    assert tuple(summary) == (4, 9, 75440, 38070, "73.7 KB", "37.2 KB")


def test_modes_differ_only_where_they_should(corpus):
    base = bytes(random.Random(1).randbytes(20001))

    def changed(at, size=20001):
        return base[:at] + bytes([base[at] ^ 1]) + base[at + 1 : size]

    files = {"/base": base, "/copy": base, "/prefix": changed(10), "/gap": changed(5000), "/tail": changed(20000)}
    files |= {f"/{n}{k}": (base[:n] if k else changed(n - 1, n)) for n in (8192, 8193, 16384, 16385) for k in (0, 1)}
    files |= {"/empty1": b"", "/empty2": b""}
    items = corpus(files)
    exact = expected_groups(files)

    def three_parts(c):
        starts = (0, len(c) // 2 - 2048, len(c) - 4096) if len(c) > 12288 else (0, 4096, 8192)
        return b"".join(c[p : p + 4096] for p in starts)

    regions = expected_groups(files, three_parts)
    assert flat(scan_items(items, FULL).member_rows) == exact
    assert flat(scan_items(items, REGIONS).member_rows) == exact
    assert flat(scan_items(items, REGIONS_ONLY).member_rows) == regions != exact
    quick = expected_groups(files, lambda c: c[:4096])
    assert flat(scan_items(items, QUICK).member_rows) == quick
    cleared = {p for _, paths in quick for p in paths} - {p for _, paths in exact for p in paths}
    assert {r.path for r in quick_false_positives(items, QUICK).collect()} == cleared
    adaptive = expected_groups(files, lambda c: c if len(c) <= 8192 else c[:16384])
    stages = digest_stages(items, FULL)
    candidates = sum(len(paths) for _, paths in adaptive)
    funnel = scan_funnel(stages).first()
    assert (funnel.found_files, funnel.candidate_files, funnel.duplicate_files, funnel.duplicate_groups) == (
        len(files), candidates, sum(len(p) for _, p in exact), len(exact),
    )
    assert {r.path for r in candidates_by_size(items).collect()} == {
        p for p, c in files.items() if sum(len(c) == len(d) for d in files.values()) > 1
    }


def test_no_duplicates_and_empty(corpus):
    files = {"/a": b"1", "/b": b"2"}
    assert scan_items(corpus(files)).member_rows.count() == 0
    nothing = ScanSpec(max_bytes=-1)
    scan = scan_items(corpus(files), nothing)
    assert scan.member_rows.count() == 0
    assert tuple(space_savings(scan_groups(corpus(files), nothing)).first()) == (0, 0)


def test_space_savings_rows(spark):
    groups = spark.createDataFrame([(1024, "h1", 2), (2048, "h2", 3)], "size_bytes bigint, digest string, n_files bigint")
    assert tuple(space_savings(groups).first()) == (8192, 5120)
    single = spark.createDataFrame([(1024, "h1", 1), (2048, "h2", 1)], groups.schema)
    assert tuple(space_savings(single).first()) == (3072, 0)


def test_corpus_statistics(spark, corpus):
    items = plant_copies(corpus({f"/{n % 5}/{n}": bytes([n]) * n for n in range(1, 11)}))
    digests = digest_items(items)
    stats = corpus_stats(digests).first()
    assert tuple(stats) == (10, 10, 20, 110, 10)
    assert scan_groups(items).count() == 10
    assert tuple(corpus_stats(digests.where("false")).first()) == (0, 0, 0, 0, 0)
    assert "Expand" not in corpus_stats(digests)._jdf.queryExecution().executedPlan().toString()


def test_rows_without_content_are_listed(spark):
    rows = spark.createDataFrame([("/a", b"x", 1), ("/b", b"x", 1), ("/c", None, 1), ("/d", None, 9)], "p string, c binary, n bigint")
    items = table_items(rows, F.col("p"), F.col("c"), size=F.col("n"))
    scan = scan_items(items, ScanSpec(max_bytes=5))
    assert [r.path for r in scan.unreadable.collect()] == ["/c"] and scan.members.n_rows == 2
    reasons = {r.path: r.reason for r in audit(items, ScanSpec(max_bytes=5)).collect()}
    assert reasons == {"/a": "kept", "/b": "kept", "/c": "unreadable", "/d": "unreadable"}


def test_rows_without_content_or_size_are_listed(spark):
    rows = spark.createDataFrame([("/a", b"x", 1), ("/b", b"x", None), ("/c", None, None), ("/d.tmp", None, None)], "p string, c binary, n bigint")
    spec = ScanSpec(max_bytes=5, exclude=("*.tmp",))
    unsized = table_items(rows, F.col("p"), F.col("c"))
    scan = scan_items(unsized, spec)
    assert rows_of(scan.unreadable) == [("/c", "no content")] and scan.members.n_rows == 2
    sized = table_items(rows, F.col("p"), F.col("c"), size=F.col("n"))
    assert rows_of(scan_items(sized, spec).unreadable) == [("/b", "no size"), ("/c", "no content")]
    for items in (unsized, sized):
        lost = audit(items, spec).where("reason = 'unreadable'").select("path")
        assert rows_of(lost) == rows_of(scan_items(items, spec).unreadable.select("path"))


def test_verified_regions_digest_once(corpus):
    plan = scan_items(corpus(demo()), REGIONS).digests.df
    assert plan.columns == ["path", "size_bytes", "digest"]


def skewed(spark):
    """A third of the rows in one group, many pairs, many singles."""
    return spark.range(3000).selectExpr(
        "concat('/p', id) AS path",
        "CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS size_bytes",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('pair', id DIV 6) ELSE 'x' END AS digest",
    ).selectExpr("path", "CASE WHEN digest LIKE 'pair%' THEN 9L ELSE size_bytes END AS size_bytes", "digest")


@pytest.mark.parametrize("floor", [1, 2, 100, None])
def test_hot_groups_give_the_same_rows(spark, floor):
    rows = settle(skewed(spark), "skewed")
    found = {r.path: r.n_files for r in g.shared_rows(rows, floor=floor).collect()}
    counts = {}
    for r in skewed(spark).collect():
        counts.setdefault((r.size_bytes, r.digest), []).append(r.path)
    assert found == {p: len(paths) for paths in counts.values() if len(paths) > 1 for p in paths}


def test_hot_limit_bounds_the_broadcast():
    for n in (1, 10**6, 10**9, 10**12):
        assert n // g.hot_limit(n) <= g.HOT_KEYS


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_groups_are_not_shuffled_and_counted_once(spark):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = settle(skewed(spark), "skewed")
        plan = final_plan(g.shared_rows(rows, floor=100))
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    # The counts, the cold rows, and nothing else.
    assert sum("+- Exchange hashpartitioning" in line for line in lines) == 2
    assert sum("ReusedExchange" in line for line in lines) == 2
    assert sum("BroadcastHashJoin" in line for line in lines) == 2
    assert sum("SortMergeJoin" in line for line in lines) == 1


def test_content_is_read_once_and_never_shuffled(corpus, spark, tmp_path):
    source = str(tmp_path / "items")
    corpus(demo()).select("path", "content").write.parquet(source)
    items = table_items(spark.read.parquet(source), F.col("path"), F.col("content"))
    digested = digest_items(items).hint("rebalance", "path")
    plan = digested._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert plan.count("FileScan") == 1 and plan.count("sha2") == 1
    assert below.index("sha2") < below.index("FileScan")
    assert "IsNotNull(content)" in plan
    groups = scan_groups(items)._jdf.queryExecution().executedPlan().toString()
    assert groups.count("FileScan") == 1 and groups.count("Exchange") == 1
    members = scan_items(items).member_rows._jdf.queryExecution().executedPlan().toString()
    assert "content" not in members.replace("contentdup", "")


def test_stored_sizes_spare_the_content(spark, tmp_path):
    source = str(tmp_path / "sized")
    rows = [(path, content, len(content)) for path, content in demo().items()]
    spark.createDataFrame(rows, "path string, content binary, n_bytes bigint").write.parquet(source)
    items = table_items(spark.read.parquet(source), F.col("path"), F.col("content"), size=F.col("n_bytes"))
    spec = ScanSpec(min_bytes=100, max_bytes=5000)
    plan = keep_items(items, spec).select("path", "size_bytes")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_bytes,100)" in plan and "LessThanOrEqual(n_bytes,5000)" in plan
    assert "ReadSchema: struct<path:string,n_bytes:bigint>" in plan
    assert flat(scan_items(items, spec).member_rows) == expected_groups(
        {path: content for path, content in demo().items() if 100 <= len(content) <= 5000}
    )


def test_one_pass_tells_everything(spark, corpus, tmp_path):
    """Digests, audit and unreadable rows are folders of one written table; the
    content is read by one job, whose figures are the funnel."""
    rows = [("/a", "same"), ("/b", "same"), ("/c", None), ("/d.tmp", "x"), ("/e", "longer text"), ("/f", "samf")]
    source = str(tmp_path / "rows")
    spark.createDataFrame(rows, "path string, text string").coalesce(1).write.parquet(source)
    items = table_items(spark.read.parquet(source), F.col("path"), F.col("text"))
    spec = ScanSpec(max_bytes=8, exclude=("*.tmp",), mode="quick", prefix_bytes=3)
    scan = scan_items(items, spec, staged=True, audited=True)
    for frame in (scan.digests.df, scan.unreadable, scan.audit, scan.groups):
        assert not any(file.startswith("file://" + source) or source in file for file in frame.inputFiles())
    assert rows_of(scan.audit.select("path", "reason")) == [
        ("/a", "kept"), ("/b", "kept"), ("/c", "unreadable"), ("/d.tmp", "excluded_file"), ("/e", "size_out_of_range"), ("/f", "kept"),
    ]
    assert rows_of(scan.unreadable) == [("/c", "no content")]
    assert scan.digests.figures == {"n_rows": 3, "n_bytes": 12} and scan.digests.n_rows == scan.digests.df.count()
    wanted = scan_funnel(digest_stages(items, spec)).first().asDict()
    assert scan.funnel == wanted == {
        "found_files": 3, "found_bytes": 12, "candidate_files": 3, "candidate_bytes": 12,
        "duplicate_files": 2, "duplicate_bytes": 8, "duplicate_groups": 1,
    }
    assert sorted(r.path for r in scan.members.df.collect()) == ["/a", "/b"]
    empty = scan_items(items.limit(0), spec, staged=True, audited=True)
    assert set(empty.funnel.values()) == {0} and empty.audit.isEmpty() and empty.unreadable.isEmpty()
