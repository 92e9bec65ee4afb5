"""Pages of a result and searches in it read only the pieces they need."""

import random

import pytest
from pyspark.sql import functions as F

from contentdup.catalogue import QUERIES
from contentdup.operators.filters import path_contains
from contentdup.operators.numbering import number_members
from contentdup.operators.settle import settle
from contentdup.plans import pages as pages_module
from contentdup.plans.pages import PathIndex, ResultPages, page_piece_count, piece_count
from contentdup.plans.report import result_table, sort_rows
from contentdup.plans.scan import scan_items


@pytest.fixture(scope="module")
def results(spark):
    source = random.Random(3)
    sizes = [source.choice([1, 1, 1, 20, 300]) for _ in range(30)]
    rows = [
        (sizes[group], f"{group % 7:02d}digest{group:056d}", f"/Dir{source.randrange(9)}/Ünder{group}/{number}.TXT", 5)
        for group in range(30)
        for number in range(2 + group % 6)
    ]
    members = spark.createDataFrame(rows, "size_bytes bigint, digest string, path string, n_files bigint")
    return settle(result_table(members), "results")


@pytest.fixture()
def pieces_read(spark):
    """How many pieces a frame has read, by the figures of its own run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def count(frame):
        frame.collect()
        leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return sum(scan.metrics().apply("numPartitions").value() for scan in scans if scan.nodeName().startswith("Scan parquet"))

    yield count
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("column", ["group", "size", "hash", "path"])
@pytest.mark.parametrize("ascending", [True, False])
def test_pages_are_the_sorted_table(results, column, ascending):
    pages = ResultPages(results, rows_per_piece=20)
    wanted = [r.path for r in sort_rows(results.df, column, ascending).collect()]
    found = []
    for number in range(-(-len(wanted) // 17) + 1):
        page = pages.page(number, 17, column, ascending).collect()
        assert [r.position for r in page] == list(range(number * 17, min((number + 1) * 17, len(wanted))))
        found += [r.path for r in page]
    assert found == wanted
    pages.drop()


def test_a_page_reads_its_piece(results, pieces_read):
    pages = ResultPages(results, rows_per_piece=10)
    assert pieces_read(pages._order("size", True).table.df) > 5
    assert {pieces_read(pages.page(n, 3, "size")) for n in range(10)} <= {1, 2}
    with pytest.raises(ValueError):
        pages.page(-1)


@pytest.mark.parametrize("rows_per_piece", [9, 1000])
def test_a_range_of_pages_is_these_pages(results, rows_per_piece):
    wanted = [r.path for r in sort_rows(results.df, "size", False).collect()]
    pages = ResultPages(results, rows_per_piece)
    for numbers in (range(0, 99), range(1, 12, 3), range(2, 9, 5), range(4, 5, 10**20), range(40, 90), range(3, 3)):
        places = [at for number in numbers for at in range(number * 7, number * 7 + 7) if at < len(wanted)]
        found = pages.page(numbers, 7, "size", ascending=False).collect()
        assert [(r.position, r.path) for r in found] == [(at, wanted[at]) for at in places]
    pages.drop()


def test_a_range_reads_its_pieces(results, pieces_read):
    """Not those before, after or between its pages."""
    pages = ResultPages(results, rows_per_piece=5)
    every = pieces_read(pages._order("size", True).table.df)
    assert pieces_read(pages.page(range(1, 8, 6), 5, "size")) <= 4 < every / 2
    assert pieces_read(pages.page(range(0, 3), 5, "size")) <= 6 < every / 2
    for numbers in (range(-1, 3), range(5, 0, -1)):
        with pytest.raises(ValueError):
            pages.page(numbers)


def test_pages_read_the_order_once_however_many(spark, tmp_path, pieces_read):
    """Every third page of 40 rows and of 400: the plan has one read of them."""
    for n_rows in (40, 400):
        rows = spark.range(n_rows).selectExpr("id AS doc_id", "repeat('x', cast(id div 2 AS int)) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
        folder = f"{tmp_path}/{n_rows}"
        rows.write.parquet(f"{folder}/documents.parquet")
        wanted = QUERIES["result_pages"](spark, folder)
        leaves = wanted._jdf.queryExecution().optimizedPlan().collectLeaves()
        names = [leaves.apply(i).nodeName() for i in range(leaves.size())]
        assert sum(name.startswith("LogicalRelation") or "parquet" in name for name in names) == 1, names
        # Two of each size, the largest first, by path.
        order = sorted(range(n_rows), key=lambda n: (-(n // 2), f"/s/en/{n}.txt"))
        expected = [(at, n // 2) for at, n in enumerate(order) if at // 10 % 3 == 0]
        assert [(r.position, r.size_bytes) for r in wanted.collect()] == expected


def test_small_pieces_are_few(results, pieces_read, monkeypatch):
    """Small pieces grow with the result, up to the usual rows of a piece."""
    assert [page_piece_count(n, 50) for n in (0, 120, 10**6, 10**8, 10**12)] == [1, 3, 128, 1000, 100_000]
    assert page_piece_count(10**7, 10**6) == 10
    monkeypatch.setattr(pages_module, "SMALL_PIECES", 3)
    pages = ResultPages(results, rows_per_piece=2)
    assert pieces_read(pages._order("size", True).table.df) <= 3
    assert [r.position for r in pages.page(11, 4, "size").collect()] == [44, 45, 46, 47]


def test_search_reads_hit_pieces_only(results, pieces_read):
    index = PathIndex.write(results, rows_per_piece=10)
    every = pieces_read(index.table.df)
    for keyword in ("dir3/", "DIR1/üNDER", "under", "nder2", "4.txt", "ä", "", "r8", "nothing like it", "/dir8/ünder29/1.txt"):
        found = sorted(tuple(r) for r in index.search(keyword).collect())
        assert found == sorted(tuple(r) for r in path_contains(results.df, keyword).collect()), keyword
        if len(keyword) >= 3:
            assert pieces_read(index.search(keyword)) <= len(index.pieces(keyword))
    assert len(index.pieces("dir3/")) < every and index.pieces("nothing like it") == []
    index.drop()


def test_empty_results(spark, results):
    empty = settle(results.df.limit(0), "empty")
    assert ResultPages(empty).page(0).isEmpty() and PathIndex.write(empty).search("abc").isEmpty()
    assert [piece_count(n) for n in (0, 1, 100_001, 10**12)] == [1, 1, 2, 100_000]


def test_members_are_shuffled_once(spark, corpus):
    """Numbers come with the written rows; joining the table of pieces moves none."""
    members = scan_items(corpus({f"/{n}": b"%d" % (n // 2) for n in range(20)})).members
    plan = number_members(members.df, pieces=5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
    # The one exchange of rows by piece is that of one row per piece.
    numbered = number_members(members.df, pieces=5)
    assert sorted((r.group_no, r.member_no) for r in numbered.collect()) == [(g, m) for g in range(1, 11) for m in (0, 1)]


def test_survivors_leave_content_where_it_is(spark, corpus, monkeypatch):
    """Of rows with content only those that the bit table lets through go into a
    join, however large the manifest is."""
    from contentdup.operators.removal import survivors

    items = corpus({f"/{n}": b"x" * 100 for n in range(300)})
    manifest = items.where("path LIKE '%7'").select("path")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = survivors(items, manifest)
        initial = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        clear = initial.split("Union")[1].split("SortMergeJoin")[0]
        assert "BroadcastHashJoin" in clear and "Exchange hashpartitioning(path" not in clear
        assert sorted(r.path for r in left.collect()) == sorted(f"/{n}" for n in range(300) if n % 10 != 7)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert items.join(F.broadcast(manifest), "path", "left_semi").count() == 30
