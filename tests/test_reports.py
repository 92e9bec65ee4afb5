import csv
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contentdup.operators.numbering import number_members
from contentdup.plans.export import read_csv, write_csv, write_json
from contentdup.plans.report import detail_report, nested_groups, report, result_table, sort_groups, sort_rows
from contentdup.plans.scan import scan_items
from tests.test_scan import demo

MEMBERS = "size_bytes bigint, digest string, path string"


def with_counts(members):
    return members.join(members.groupBy("size_bytes", "digest").agg(F.count("path").alias("n_files")), ["size_bytes", "digest"])


def brute(rows):
    groups = {}
    for size, digest, path in sorted(rows):
        groups.setdefault((size, digest), []).append(path)
    return {
        path: (number, member)
        for number, (_, paths) in enumerate(sorted(groups.items()), 1)
        for member, path in enumerate(paths)
    }


@pytest.mark.parametrize("pieces", [None, 1, 3, 40])
def test_numbers_match_a_global_sort(spark, pieces):
    rng = random.Random(5)
    rows = [(1, "a", f"/hot{n}") for n in range(700)]
    rows += [(rng.randrange(4), rng.choice("abcdef"), f"/x{n}") for n in range(600)]
    rows += [(5 + n, "z", f"/single{n}") for n in range(20)]
    rng.shuffle(rows)
    numbered = number_members(spark.createDataFrame(rows, MEMBERS), pieces=pieces)
    assert {r.path: (r.group_no, r.member_no) for r in numbered.collect()} == brute(rows)


def test_numbers_of_nothing(spark):
    assert number_members(spark.createDataFrame([], MEMBERS)).count() == 0


def test_nested_groups_split_long_lists(spark):
    rows = [(1, "a", f"/{n:03}") for n in range(25)] + [(2, "b", "/x"), (2, "b", "/y")]
    found = sorted(nested_groups(with_counts(spark.createDataFrame(rows, MEMBERS)), 10).collect())
    assert [(r.hash, r.part, r.n_files, len(r.paths)) for r in found] == [
        ("a", 0, 25, 10), ("a", 1, 25, 10), ("a", 2, 25, 5), ("b", 0, 2, 2),
    ]
    assert [p for r in found[:3] for p in r.paths] == [f"/{n:03}" for n in range(25)]


def test_details_and_table(corpus):
    scan = scan_items(corpus(demo()))
    details = {r.path: r for r in detail_report(scan.member_rows, "/d").collect()}
    assert len(details) == 9 and details["report.txt"].size_text == "700.0 bytes"
    assert details["/b/report.txt"].member_no == 0 and details["report_copy.txt"].member_no == 2
    table = result_table(scan.member_rows)
    by_size = [r.size_bytes for r in sort_rows(table, "size", ascending=False).collect()]
    assert by_size == sorted(by_size, reverse=True)
    rows = sort_rows(table).collect()
    assert [r.group_no for r in rows] == sorted(r.group_no for r in rows)
    assert all(r.display_digest == f"{r.digest[:8]}...{r.digest[-8:]}" for r in rows)
    keys = [(r.size_bytes, r.digest) for r in sort_groups(scan.groups).collect()]
    assert keys == sorted(keys)


def test_exports(spark, tmp_path):
    rows = [(1024, "hash1", "/f1"), (1024, "hash1", "/f2"), (2048, "hash2", "/f3")]
    members = spark.createDataFrame(rows, MEMBERS)
    write_json(nested_groups(with_counts(members)), str(tmp_path / "json"))
    records = [json.loads(line) for part in (tmp_path / "json").glob("part*") for line in part.read_text().splitlines()]
    assert {(r["size_bytes"], r["hash"], tuple(r["paths"])) for r in records} == {
        (1024, "hash1", ("/f1", "/f2")), (2048, "hash2", ("/f3",)),
    }
    write_csv(members, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["size_bytes", "hash", "path"] and back.count() == 3
    write_csv(members.where("false"), str(tmp_path / "none"))
    assert [p.read_text() for p in (tmp_path / "none").glob("part*")] == ["size_bytes,hash,path\n"]
    write_json(nested_groups(with_counts(members).where("false")), str(tmp_path / "nojson"))
    assert not any(p.read_text() for p in (tmp_path / "nojson").glob("part*"))


def test_whole_run(corpus, tmp_path):
    out = report(scan_items(corpus(demo())), str(tmp_path / "j"), str(tmp_path / "c"))
    assert out.summary.first().n_groups == 4
    assert out.details.count() == 9 and out.manifest.count() == 5
    assert set(r.action for r in out.manifest.select("action").collect()) == {"would_delete"}
    assert sum(len(p.read_text().splitlines()) for p in Path(tmp_path / "j").glob("part*")) == 4


def test_csv_that_any_reader_takes_back(spark, corpus, tmp_path):
    odd = ["/plain", " /lead", "/a/ b.txt ", '/q"u,ote', '"', "/line\nend", "/cr\r", "/crlf\r\n", "/back\\", '/\\"', "/tab\t", "/'", "#x", "/é"]
    members = scan_items(corpus({path: b"same" for path in odd})).members
    out = str(tmp_path / "csv")
    write_csv(members.df, out)
    found = []
    for name in os.listdir(out):
        if name.endswith(".csv"):
            with open(os.path.join(out, name), newline="", encoding="utf-8") as file:
                found += csv.DictReader(file)
    assert sorted(row["path"] for row in found) == sorted(odd)
    assert all(set(row) == {"size_bytes", "hash", "path"} and row["size_bytes"] == "4" and len(row["hash"]) == 64 for row in found)
    assert sorted(r.path for r in read_csv(spark, out).collect()) == sorted(odd)
