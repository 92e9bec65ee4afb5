import os

import pytest
from pyspark.sql import functions as F

from contentdup.operators.groups import keepers
from contentdup.operators.removal import (
    execute_removal,
    invalid_decisions,
    read_decisions,
    removal_by_decision,
    removal_manifest,
    removal_selected,
    survivors,
)
from contentdup.operators.settle import settle
from contentdup.plans.scan import scan_files, scan_items

MEMBERS = "size_bytes bigint, digest string, path string"
ROWS = [(1, "a", f"/a/{n}") for n in range(3)] + [(2, "b", "/long/b"), (2, "b", "/z")]


def members(spark):
    return spark.createDataFrame(ROWS, MEMBERS)


def paths(df):
    return {r.path for r in df.collect()}


def test_automatic_policy(spark):
    rows = settle(members(spark), "m")
    manifest = removal_manifest(rows)
    assert paths(manifest) == {"/a/1", "/a/2", "/z"}
    assert {r.keep_path for r in manifest.collect()} == {"/a/0", "/long/b"}
    assert paths(removal_manifest(rows, "shortest_path")) == {"/a/1", "/a/2", "/long/b"}
    assert removal_manifest(rows, dry_run=False).first().action == "delete"
    with pytest.raises(ValueError):
        removal_manifest(rows, "oldest")
    second = F.when(F.col("path") == "/a/2", F.lit(1)).otherwise(F.lit(9))
    aged = members(spark).withColumn("modified", F.timestamp_seconds(second))
    assert {r.keep_path for r in keepers(aged, "oldest").collect()} == {"/a/2", "/long/b"}


def test_survivors_have_no_duplicates(corpus):
    files = {f"/{n}": b"same" if n % 3 else bytes([n]) for n in range(30)}
    scan = scan_items(corpus(files))
    left = survivors(scan.digests.df, removal_manifest(scan.members))
    assert left.count() == 11
    assert left.groupBy("digest").count().where("count > 1").count() == 0


@pytest.mark.parametrize(
    "choice, removed",
    [
        ("a", {"/a/1", "/a/2"}), (" A\n", {"/a/1", "/a/2"}), ("s", set()), ("0,2", {"/a/0", "/a/2"}), (" 1 ", {"/a/1"}),
        ("-1", set()), ("99", set()), ("0,1,2", {"/a/0", "/a/1", "/a/2"}), ("1,1", {"/a/1"}), ("+1,0_2", {"/a/1", "/a/2"}),
        ("99999999999999999999,1", {"/a/1"}),
        (None, None), ("1,x", None), ("", None), ("1.0", None), ("1,", None), ("invalid", None),
    ],
)
def test_decisions(spark, choice, removed):
    decisions = spark.createDataFrame([(1, "a", choice)], "size_bytes bigint, digest string, choice string")
    groups = members(spark).select("size_bytes", "digest").distinct()
    bad = invalid_decisions(groups, decisions).count()
    assert bad == (removed is None)
    assert read_decisions(decisions).first().valid == (removed is not None)
    if choice in ("a", "0,2", "-1", "1,x", "+1,0_2", "99999999999999999999,1"):
        assert paths(removal_by_decision(settle(members(spark), "m"), decisions)) == (removed or set())


def test_contradicting_decisions(spark):
    rows = [(1, "a", "a"), (1, "a", "s"), (2, "b", "A"), (2, "b", "a "), (3, "no such group", "x")]
    decisions = spark.createDataFrame(rows, "size_bytes bigint, digest string, choice string")
    groups = members(spark).select("size_bytes", "digest").distinct()
    assert [r.choice for r in invalid_decisions(groups, decisions).collect()] == ["a / s"]
    assert paths(removal_by_decision(settle(members(spark), "m"), decisions)) == {"/z"}


def test_selected(spark):
    picks = spark.createDataFrame([("/a/0",), ("/a/1",), ("/z",), ("/long/b",), ("/z",), ("/elsewhere",)], "path string")
    assert paths(removal_selected(members(spark), picks, keep_one=False)) == {"/a/0", "/a/1", "/z", "/long/b"}
    assert paths(removal_selected(members(spark), picks)) == {"/a/0", "/a/1", "/z"}


def test_kept_paths_of_decisions_and_selections(spark):
    rows = settle(members(spark), "m")
    decisions = spark.createDataFrame([(1, "a", "0"), (2, "b", "0,1")], "size_bytes bigint, digest string, choice string")
    assert {(r.path, r.keep_path) for r in removal_by_decision(rows, decisions).collect()} == {
        ("/a/0", "/a/1"), ("/long/b", None), ("/z", None),
    }
    picks = spark.createDataFrame([("/a/0",), ("/z",), ("/long/b",)], "path string")
    assert {(r.path, r.keep_path) for r in removal_selected(rows.df, picks).collect()} == {("/a/0", "/a/1"), ("/z", "/long/b")}
    assert {(r.path, r.keep_path) for r in removal_selected(rows.df, picks, keep_one=False).collect()} == {
        ("/a/0", "/a/1"), ("/long/b", None), ("/z", None),
    }


def executed(manifest):
    return {os.path.basename(r.path): (r.status, r.error) for r in execute_removal(manifest, dry_run=False).collect()}


def test_a_file_under_two_names_stays(spark, tmp_path):
    data, alias = tmp_path / "data", tmp_path / "alias"
    data.mkdir()
    (data / "only").write_text("text")
    os.symlink(data, alias)
    scan = scan_files(spark, [str(data), str(alias)])
    assert removal_manifest(scan.members).count() == 0
    row = (4, "d", str(alias / "only"), str(data / "only"))
    manifest = spark.createDataFrame([row], "size_bytes bigint, digest string, path string, keep_path string")
    assert executed(manifest)["only"] == ("failed", f"kept copy is this file: {data / 'only'}")
    assert os.listdir(data) == ["only"]


def test_hard_links_may_go(spark, tmp_path):
    (tmp_path / "a").write_text("text")
    os.link(tmp_path / "a", tmp_path / "b")
    manifest = removal_manifest(scan_files(spark, str(tmp_path)).members)
    assert executed(manifest) == {"b": ("deleted", None)} and os.listdir(tmp_path) == ["a"]


def test_changed_files_stay(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text("same")
    scan = scan_files(spark, str(tmp_path))
    manifest = settle(removal_manifest(scan.members), "manifest").df
    assert "modified" in manifest.columns
    (tmp_path / "b").write_text("diff")
    os.utime(tmp_path / "b", (10, 10))
    assert executed(manifest) == {"b": ("failed", "changed since the scan"), "c": ("deleted", None)}
    assert (tmp_path / "b").read_text() == "diff"


def test_missing_or_changed_kept_copies(spark, tmp_path):
    for name in ("one", "two", "three"):
        (tmp_path / name).write_text("same")
    scan = scan_files(spark, str(tmp_path))
    choice = scan.groups.select("size_bytes", "digest", F.lit("1").alias("choice"))
    decided = settle(removal_by_decision(scan.members, choice), "decided").df
    picked = settle(
        removal_selected(scan.members.df, spark.createDataFrame([(str(tmp_path / "two"),)], "path string")), "picked"
    ).df
    assert [os.path.basename(r.keep_path) for r in (decided.first(), picked.first())] == ["one", "one"]
    (tmp_path / "one").write_text("longer text")
    assert executed(picked)["two"] == ("failed", f"kept copy has changed: {tmp_path / 'one'}")
    os.remove(tmp_path / "one")
    assert executed(decided)["three"] == ("failed", f"kept copy is missing: {tmp_path / 'one'}")
    assert sorted(os.listdir(tmp_path)) == ["three", "two"]


def test_execution(spark, tmp_path):
    for name, text in (("keep", "xx"), ("one", "xx"), ("grown", "xxx")):
        (tmp_path / name).write_text(text)
    pairs = (("one", "keep"), ("gone", "keep"), ("grown", "keep"), ("keep", "no"))
    rows = [(2, "d", str(tmp_path / n), str(tmp_path / k)) for n, k in pairs]
    manifest = spark.createDataFrame(rows, "size_bytes bigint, digest string, path string, keep_path string")
    assert {r.status for r in execute_removal(manifest).collect()} == {"would_delete"}
    assert len(os.listdir(tmp_path)) == 3
    log = execute_removal(manifest, dry_run=False)
    status = {os.path.basename(r.path): r.status for r in log.collect()}
    assert status == {"one": "deleted", "gone": "absent", "grown": "failed", "keep": "failed"}
    assert sorted(os.listdir(tmp_path)) == ["grown", "keep"]
    assert {os.path.basename(r.path): r.status for r in log.collect()} == status
