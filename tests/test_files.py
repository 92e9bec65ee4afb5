import fnmatch
import hashlib
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contentdup.operators.among import among, without
from contentdup.operators.filters import audit, keep_items
from contentdup.operators.groups import scan_difference
from contentdup.operators.removal import execute_removal, removal_manifest
from contentdup.operators.settle import settle
from contentdup.plans.rescan import differences, rescan_files, rescan_items, store_rows
from contentdup.plans.scan import digest_items, scan_files, scan_items, stage_counts
from contentdup.plans.store import DigestStore
from contentdup.sources.content import read_digests
from contentdup.sources.inventory import _LISTED, _list_folders, _stat, inventory, mounted_path, outer_folders
from contentdup.sources.synthetic import plant_copies, write_files
from contentdup.sources.tables import binary_file_items, table_items
from contentdup.spec import ScanSpec
from contentdup.streaming.arrivals import ingest, read_store
from tests.conftest import expected_groups, flat

big = bytes(range(256)) * 100

FILES = {
    "a.txt": b"test",
    "sub/b.txt": b"test",
    "sub/deep/c.log": b"test",
    ".hidden": b"test",
    ".git/objects/d": b"test",
    "_under": b"",
    "sub/empty": b"",
    "node/deep/e.txt": b"other",
    "big1": big,
    "big2": big,
    "big3": big[:5000] + b"!" + big[5001:],
    "big4": big[:-1] + b"!",
}


@pytest.fixture()
def tree(tmp_path):
    base = tmp_path / ".base"
    for name, content in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(content)
    os.symlink(base / "a.txt", base / "link.txt")
    os.symlink(base / "sub", base / "linked")
    return str(base)


def below(base, names):
    return {os.path.join(base, n) for n in names}


def test_inventory(spark, tree):
    found = {r.path: r for r in inventory(spark, tree).collect()}
    assert set(found) == below(tree, [*FILES, "link.txt", "linked"])
    assert {p for p, r in found.items() if r.is_symlink} == below(tree, ["link.txt", "linked"])
    for name, content in FILES.items():
        row = found[os.path.join(tree, name)]
        assert row.size_bytes == len(content) and row.dirs == name.split("/")[:-1] and row.name == os.path.basename(name)
        assert abs(row.modified.timestamp() - time.time()) < 3600 * 24
    spec = ScanSpec(exclude=("*.log",), exclude_dirs=("deep",), exclude_hidden=True, min_bytes=1)
    kept = keep_items(inventory(spark, tree, spec), spec)
    assert {r.path for r in kept.collect()} == below(tree, ["a.txt", "sub/b.txt", "big1", "big2", "big3", "big4"])
    reasons = dict(audit(inventory(spark, tree), spec).groupBy("reason").count().collect())
    assert reasons == {"symlink": 2, "hidden": 2, "excluded_dir": 2, "size_out_of_range": 2, "kept": 6}


def no_digests(spark):
    return store_rows(spark.createDataFrame([], "path string, size_bytes bigint, digest string"), ScanSpec())


def test_times_of_change_that_no_calendar_has(spark, tmp_path):
    """Files from before 1970 or long after 2262 are scanned like others."""
    seconds = [-(10**9), 10**10, 0, 1_700_000_000]
    for number, second in enumerate(seconds):
        (tmp_path / str(number)).write_bytes(b"same")
        os.utime(tmp_path / str(number), (second, second))
    scan = scan_files(spark, str(tmp_path))
    assert scan.groups.first().n_files == len(seconds) and scan.unreadable.isEmpty()
    wanted = {str(tmp_path / str(n)): os.lstat(tmp_path / str(n)).st_mtime_ns // 1000 for n in range(len(seconds))}
    found = inventory(spark, str(tmp_path)).select("path", F.unix_micros("modified").alias("micros"))
    assert {r.path: r.micros for r in found.collect()} == wanted
    # Nothing counts as changed by its time alone, and removal goes by it.
    first = rescan_files(inventory(spark, str(tmp_path)), no_digests(spark))
    assert rescan_files(inventory(spark, str(tmp_path)), first.store.df).n_fresh == 0
    log = execute_removal(removal_manifest(scan.members), dry_run=False)
    assert {r.status for r in log.collect()} == {"deleted"} and len(os.listdir(tmp_path)) == 1


@pytest.mark.parametrize("seconds", [-(10**11), 10**12, 2**42])
def test_any_time_is_a_number(spark, monkeypatch, seconds):
    """Also years that the file system of the tests cannot hold."""

    class Found:
        st_size, st_mtime_ns = 3, seconds * 10**9 + 5000

    monkeypatch.setattr("contentdup.sources.inventory.os.lstat", lambda path: Found)
    size, micros, error = _stat("x")
    assert (size, micros, error) == (3, seconds * 10**6 + 5, None)
    row = spark.createDataFrame([(micros,)], "micros bigint").select(F.timestamp_micros("micros").alias("at"))
    assert row.select(F.unix_micros("at")).first()[0] == micros

    def broken(path):
        raise OverflowError("too far")

    monkeypatch.setattr("contentdup.sources.inventory.os.lstat", broken)
    assert _stat("x") == (None, None, "too far")


def test_overlapping_folders(spark, tree, tmp_path):
    os.symlink(tree, tmp_path / "alias")
    bases = [os.path.join(tree, "sub"), tree, str(tmp_path / "alias")]
    both, one = (inventory(spark, b).select("path", "size_bytes", "dirs") for b in (bases, tree))
    assert both.count() == len(FILES) + 2
    assert tuple(scan_difference(both, one).first()) == (0, 0)


def test_names_that_are_no_text_and_closed_folders(spark, tmp_path):
    for name in (b"caf\xe9", b"a", b"b"):
        with open(os.path.join(os.fsencode(tmp_path), name), "wb") as file:
            file.write(b"same")
    os.mkdir(os.path.join(os.fsencode(tmp_path), b"d\xff"))
    scan = scan_files(spark, str(tmp_path))
    assert {os.path.basename(r.path) for r in scan.member_rows.collect()} == {"a", "b"}
    assert {(os.path.basename(r.path), r.error) for r in scan.unreadable.collect()} == {
        (n, "the name is not valid UTF-8") for n in ("caf\\xe9", "d\\xff")
    }
    gone = spark.createDataFrame([(str(tmp_path / "gone"), [])], "path string, dirs array<string>")
    listed = gone.mapInPandas(_list_folders, _LISTED).first()
    assert "No such file" in listed.error and not listed.is_dir


def test_size_changes_between_listing_and_reading(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(b"x" * 10)
    files = settle(inventory(spark, str(tmp_path)).select("path", "size_bytes"), "files").df
    (tmp_path / "a").write_bytes(b"x" * 50_000)
    found = {os.path.basename(r.path): r for r in read_digests(files, "full").collect()}
    assert found["a"].digest is None and "size changed" in found["a"].error and found["b"].digest


def test_object_stores(spark, tree, monkeypatch):
    monkeypatch.setattr("contentdup.plans.scan.mounted_path", lambda folder: None if folder.startswith("file:") else folder)
    scan = scan_files(spark, f"file:{tree}/sub")
    assert [(r.size_bytes, r.n_files) for r in scan.groups.collect()] == [(4, 2)]
    with pytest.raises(ValueError, match="separately"):
        scan_files(spark, [f"file:{tree}/sub", tree])


def walk(folder, spec):
    """The same rules, entry by entry."""
    for entry in os.scandir(folder):
        if entry.is_symlink() or (spec.exclude_hidden and entry.name.startswith(".")):
            continue
        if entry.is_dir():
            if entry.name not in spec.exclude_dirs:
                yield from walk(entry.path, spec)
        elif not any(fnmatch.fnmatchcase(entry.name, p) for p in spec.exclude):
            size = entry.stat().st_size
            if spec.min_bytes <= size <= spec.max_bytes:
                yield entry.path, size


def test_random_trees(spark, tmp_path):
    rng = random.Random(9)
    names = [".a", "a", "b", "skip", "x.log", "y.LOG", "_c"]

    def grow(folder, depth):
        for name in rng.sample(names, 4):
            path = os.path.join(folder, name)
            kind = rng.choice("fffdl" if depth else "ffl")
            if kind == "d":
                os.mkdir(path)
                grow(path, depth - 1)
            elif kind == "l":
                os.symlink(rng.choice([folder, "/nowhere"]), path)
            else:
                with open(path, "wb") as file:
                    file.write(b"z" * rng.randrange(6))

    base = str(tmp_path / "skip")
    os.mkdir(base)
    for n in range(12):
        os.mkdir(f"{base}/{n}")
        grow(f"{base}/{n}", 4)
    for spec in (
        ScanSpec(min_bytes=1, max_bytes=4, exclude=("*.log", "_*"), exclude_dirs=("skip", "b"), exclude_hidden=True),
        ScanSpec(min_bytes=0, max_bytes=9, exclude=("[!a]*",)),
    ):
        kept = keep_items(inventory(spark, base, spec), spec)
        assert {(r.path, r.size_bytes) for r in kept.collect()} == set(walk(base, spec)), spec


def test_folders_inside_others_are_left_out():
    hidden = ScanSpec(exclude_hidden=True, exclude_dirs=("skip",))
    assert outer_folders(["/no/a/b", "/no/a", "/no/ab", "/no/a/"]) == ["/no/a", "/no/ab"]
    assert outer_folders(["/", "/no/a"]) == ["/"]
    assert outer_folders(["/no/.x/b", "/no", "/no/skip/c", "/no/z"], hidden) == ["/no/.x/b", "/no", "/no/skip/c"]
    assert outer_folders(["s3a://x/y/", "s3a://x/y/z", "s3a://x/yz", "s3a://x/y/_t/u"]) == ["s3a://x/y", "s3a://x/yz", "s3a://x/y/_t/u"]


def test_several_folders_are_read_without_a_shuffle_of_content(spark, tree, monkeypatch):
    monkeypatch.setattr("contentdup.plans.scan.mounted_path", lambda folder: None)
    monkeypatch.setattr("contentdup.sources.inventory.mounted_path", lambda folder: None)
    plans = []
    monkeypatch.setattr("contentdup.plans.scan.scan_items", lambda items, *rest: plans.append(items._jdf.queryExecution().executedPlan().toString()))
    scan_files(spark, [f"file:{tree}/sub", f"file:{tree}/sub/deep", f"file:{tree}/node"])
    assert "Exchange" not in plans[0] and plans[0].count("FileScan") == 2


def test_bad_base(spark, tmp_path):
    with pytest.raises(Exception, match="not a folder"):
        inventory(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("mode", ["full", "multi_region", "quick"])
@pytest.mark.parametrize("floor", [None, 1])
def test_scan_files_equals_scan_items(spark, tree, corpus, mode, floor):
    files = {os.path.join(tree, n): c for n, c in FILES.items()}
    compared = (lambda c: c[:4096]) if mode == "quick" else (lambda c: c)
    found = flat(scan_files(spark, tree, ScanSpec(mode=mode), floor).member_rows)
    assert found == expected_groups(files, compared)
    if mode == "full" and floor:
        os.mkfifo(os.path.join(tree, "pipe"))
        scan = scan_files(spark, tree)
        sizes = [len(c) for c in FILES.values()] + [0]
        shared = [s for s in sizes if sizes.count(s) > 1]
        assert [tuple(r) for r in stage_counts(scan).collect()] == [
            ("found", len(sizes), sum(sizes)),
            ("same_size", len(shared), sum(shared)),
            ("candidates", 5 + 2 + 3, 5 * 4 + 3 * len(big)),
            ("duplicates", 5 + 2 + 2, 5 * 4 + 2 * len(big)),
        ]
        assert [os.path.basename(r.path) for r in scan.unreadable.collect()] == ["pipe"]
        # The same figures, counted by the jobs that wrote the stages.
        assert scan.funnel == {
            "found_files": len(sizes), "found_bytes": sum(sizes), "candidate_files": 5 + 2 + 3, "candidate_bytes": 5 * 4 + 3 * len(big),
            "duplicate_files": 5 + 2 + 2, "duplicate_bytes": 5 * 4 + 2 * len(big), "duplicate_groups": 3,
        }
    if floor is None:
        assert found == flat(scan_items(corpus(files), ScanSpec(mode=mode)).member_rows)


def test_read_digests(spark, tree):
    os.mkfifo(os.path.join(tree, "pipe"))
    rows = inventory(spark, tree).where("name IN ('big1', 'a.txt', 'pipe')").select("path", "name", "size_bytes")
    gone = spark.createDataFrame([(tree + "/gone", "gone", 1)], rows.schema)
    files = settle(rows.unionByName(gone), "files").df
    regions = big[:4096] + big[len(big) // 2 - 2048 : len(big) // 2 + 2048] + big[-4096:]
    for how, part in (("whole", big), ("quick", big[:4096]), ("full", big[:16384]), ("multi_region", regions)):
        found = {r.name: r for r in read_digests(files, how, algorithm="blake2b").collect()}
        assert found["big1"].digest == hashlib.blake2b(part).hexdigest()
        assert found["a.txt"].digest == hashlib.blake2b(b"test").hexdigest()
        assert found["gone"].digest is None and "No such file" in found["gone"].error
        assert found["pipe"].digest is None


def test_binary_files(spark, tree):
    found = {r.name: r for r in binary_file_items(spark, tree).select("name", "dirs", "size_bytes").collect()}
    assert found["c.log"].dirs in (["sub", "deep"], ["linked", "deep"]) and found["big1"].size_bytes == len(big)
    bounded = keep_items(binary_file_items(spark, tree), ScanSpec(min_bytes=5, max_bytes=9)).select("path")
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,5)" in plan and "LessThanOrEqual(length,9)" in plan
    groups = scan_items(binary_file_items(spark, os.path.join(tree, "sub"))).groups
    assert [(r.size_bytes, r.n_files) for r in groups.collect()] == [(4, 2)]


def test_kinds_of_folders(spark, tree, monkeypatch):
    assert [mounted_path(f) for f in ("/a/b", "file:/a", "file:///a", "s3a://x/y", "a/b:c")] == ["/a/b", "/a", "/a", None, "a/b:c"]
    monkeypatch.setattr("contentdup.sources.inventory.mounted_path", lambda folder: None)
    listed = inventory(spark, f"file:{tree}/sub")
    assert {(r.name, r.size_bytes, tuple(r.dirs)) for r in listed.collect()} == {
        ("b.txt", 4, ()), ("c.log", 4, ("deep",)),
    }
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_written_corpus(spark, corpus, tmp_path):
    items = plant_copies(corpus({f"/{n}/{n}.bin": bytes([n]) * 3000 * n for n in range(1, 8)}))
    assert write_files(items, str(tmp_path / "c")).count() == 14
    with scan_files(spark, str(tmp_path / "c")) as scan:
        assert scan.groups.count() == 7 and scan.members.n_rows == 14
        folders = [t.folder for t in (scan.digests, scan.members)]
        assert all(map(os.path.isdir, folders))
    assert not any(map(os.path.exists, folders))


def test_rescan_of_files(spark, tree):
    spec = ScanSpec()
    found = inventory(spark, tree)
    nothing = spark.createDataFrame([], "path string, size_bytes bigint, digest string")
    first = rescan_files(found, store_rows(nothing, spec), spec)
    assert first.n_fresh == len(FILES)
    assert flat(first.members()) == expected_groups({os.path.join(tree, n): c for n, c in FILES.items()})
    later = dict(FILES, **{"a.txt": b"tent", "new": b"other"})
    os.remove(os.path.join(tree, "big2"))
    del later["big2"]
    for name in ("a.txt", "new"):
        with open(os.path.join(tree, name), "wb") as file:
            file.write(later[name])
        os.utime(os.path.join(tree, name), (1, 1))
    second = rescan_files(inventory(spark, tree), first.store.df, spec)
    assert second.n_fresh == 2 and second.store.n_rows == len(later)
    assert flat(second.members()) == expected_groups({os.path.join(tree, n): c for n, c in later.items()})
    other = rescan_files(inventory(spark, tree), first.store.df, ScanSpec(mode="quick"))
    assert other.n_fresh == len(later)


def versioned(items, version):
    """Items with one version number, or a number per path."""
    number = F.lit(version) if isinstance(version, int) else F.create_map(*(F.lit(x) for pair in version.items() for x in pair))[F.col("path")]
    return items.withColumn("version", number)


def test_rescan_of_items(spark, corpus):
    old = {"/a": b"one", "/b": b"two", "/gone": b"two", "/same_size": b"abc"}
    new = {"/a": b"one", "/b": b"twoo", "/c": b"one", "/d": b"twoo", "/same_size": b"one"}
    digested = digest_items(corpus(old)).withColumn("version", F.lit(1))
    store = store_rows(digested.unionByName(digested.where("path <> '/b'")), ScanSpec(), "version")
    items = versioned(corpus(new), {path: 2 if path == "/same_size" else 1 for path in new})
    again = rescan_items(items, store, version="version")
    assert again.n_fresh == 4 and again.n_digested == 4 and again.store.n_rows == len(new)
    assert flat(again.members()) == expected_groups(new)
    # Without a version nothing proves that the content is the same.
    unknown = rescan_items(corpus(new), store_rows(digest_items(corpus(old)), ScanSpec()))
    assert unknown.n_fresh == len(new) and flat(unknown.members()) == expected_groups(new)
    other_way = rescan_items(items, store, ScanSpec(mode="quick"), version="version")
    assert other_way.n_fresh == len(new)


def test_store_that_is_met_in_place(spark, corpus, tmp_path):
    """The join of inventory and store moves the inventory alone, and what still
    holds is written where it lies."""
    items = versioned(corpus({f"/{n}": b"%d" % (n // 3) for n in range(60)}), 1)
    store = DigestStore(spark, str(tmp_path / "store"))
    rescan_items(items, store, version="version")
    found = items.select("path", "size_bytes", F.col("version").alias("modified"))
    plan = differences(found, store.rows(), ScanSpec())._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1 and "Bucketed: true" in plan
    kept = store.rows().join(F.broadcast(found.limit(2)), "path", "left_anti")
    assert "Exchange hash" not in kept._jdf.queryExecution().executedPlan().toString()


def test_store_over_many_rescans(spark, corpus, tmp_path):
    """Insertions, changes and removals: members and signed counts stay equal
    to a full scan, also after old versions and steps were cleaned away."""
    rng = random.Random(4)
    store = DigestStore(spark, str(tmp_path / "store"))
    files: dict[str, tuple[int, bytes]] = {}
    for turn in range(5):
        before = {path: content for path, (_, content) in files.items()}
        for path in rng.sample(sorted(files), len(files) // 3):
            del files[path]
        for path in rng.sample([f"/{n}" for n in range(40)], 12):
            files[path] = (turn, b"%d" % rng.randrange(6))
        now = {path: content for path, (_, content) in files.items()}
        again = rescan_items(versioned(corpus(now), {p: v for p, (v, _) in files.items()}), store, version="version")
        assert flat(again.members()) == expected_groups(now)
        sizes = lambda held: Counter((len(c), hashlib.sha256(c).hexdigest()) for c in held.values())
        counted = {(r.size_bytes, r.digest): r.n_files for r in store.counts().collect()}
        assert counted == dict(sizes(now)) and store.version == turn + 1
        touched = {(r.size_bytes, r.digest): (r.n_before, r.n_files) for r in store.touched_groups().collect()}
        old, new = sizes(before), sizes(now)
        assert touched == {k: (old[k], new[k]) for k in old | new if old[k] != new[k]}
        if turn == 2:
            store.clean(keep_steps=1)
            assert len(os.listdir(tmp_path / "store" / "rows")) == 1
    assert rescan_items(versioned(corpus(now), {p: v for p, (v, _) in files.items()}), store, version="version").n_fresh == 0
    with pytest.raises(ValueError, match="no such version"):
        store.rows(1)


def test_store_survives_a_run_that_died(spark, corpus, tmp_path):
    store = DigestStore(spark, str(tmp_path / "store"))
    rescan_items(versioned(corpus({"/a": b"x", "/b": b"x"}), 1), store, version="version")
    # Half of a second version: its step, and rows without the last marker.
    spark.createDataFrame([(1, "d", 5)], "size_bytes bigint, digest string, step bigint").write.parquet(f"{store.folder}/steps/s000000002")
    broken = tmp_path / "store" / "rows" / f"v000000002-b{store.n_buckets}"
    broken.mkdir()
    (broken / "part-00000-x_00000.c000.parquet").write_bytes(b"half")
    assert store.version == 1 and [r.n_files for r in store.groups().collect()] == [2]
    again = rescan_items(versioned(corpus({"/a": b"x", "/b": b"y"}), {"/a": 1, "/b": 2}), store, version="version")
    assert store.version == 2 and again.n_digested == 1 and store.groups().isEmpty()


def test_rescan_lists_what_it_cannot_read(spark, tree):
    store = DigestStore(spark, os.path.join(os.path.dirname(tree), "store"))
    rows = [("/a", "x", 1), ("/b", None, 1), ("/c", "y", None)]
    items = table_items(spark.createDataFrame(rows, "path string, text string, size bigint"), F.col("path"), F.col("text"), size=F.col("size"))
    again = rescan_items(items, store)
    assert {tuple(r) for r in again.unreadable.collect()} == {("/b", "no content"), ("/c", "no size")}
    assert (again.n_fresh, again.n_digested, store.rows().count()) == (3, 1, 1)
    # They are looked at again, and found once they can be read.
    mended = table_items(spark.createDataFrame([(p, "x", 1) for p in ("/a", "/b", "/c")], "path string, text string, size bigint"), F.col("path"), F.col("text"), size=F.col("size"))
    assert rescan_items(mended, store).members().count() == 3 and store.n_buckets == 8
    # Files: a pipe, and a name that is no text.
    os.mkfifo(os.path.join(tree, "pipe"))
    with open(os.path.join(os.fsencode(tree), b"caf\xe9"), "wb") as file:
        file.write(b"test")
    files = DigestStore(spark, os.path.join(os.path.dirname(tree), "files"))
    first = rescan_files(inventory(spark, tree), files)
    assert {os.path.basename(r.path) for r in first.unreadable.collect()} == {"pipe", "caf\\xe9"}
    assert first.n_digested == len(FILES) == files.rows().count()
    assert flat(first.members()) == expected_groups({os.path.join(tree, n): c for n, c in FILES.items()})


def test_filter_leaves_columns_alone(spark):
    rows = spark.createDataFrame([("/a", "x", 1), ("/b", "y", 2), (None, "z", 3)], "path string, bucket string, place int")
    keys = spark.createDataFrame([("/a",)], "path string")
    assert [tuple(r) for r in among(rows, keys).collect()] == [("/a", "x", 1)]
    for n_keys in (1, 10**9):
        assert {tuple(r) for r in without(rows, keys, n_keys).collect()} == {("/b", "y", 2), (None, "z", 3)}


def test_known_items_are_not_digested(spark, corpus, tmp_path):
    files = {f"/{n}": bytes([n]) for n in range(200)}
    source = str(tmp_path / "items")
    corpus(files).write.parquet(source)
    items = spark.read.parquet(source)
    wanted = spark.createDataFrame([(f"/{n}",) for n in range(0, 200, 10)], "path string")
    found = {r.path for r in among(items, wanted).collect()}
    assert found == {f"/{n}" for n in range(0, 200, 10)}
    assert {r.path for r in among(items, wanted, bits=64).collect()} >= found
    plan = digest_items(among(items, wanted))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("sha2") < plan.index("BroadcastHashJoin") < plan.index("FileScan")
    assert "SortMergeJoin" not in plan


def test_arriving_items(spark, corpus, tmp_path):
    incoming, store = str(tmp_path / "in"), str(tmp_path / "store")
    corpus({"/a": b"x", "/b": b"y"}).write.parquet(incoming)
    for later in ({"/c": b"x", "/b": b"z"}, {"/never": b"read"}):
        stream = spark.readStream.schema(corpus({"/a": b""}).schema).parquet(incoming)
        ingest(stream, store, str(tmp_path / "ckpt")).awaitTermination(120)
        corpus(later).write.mode("append").parquet(incoming)
    rows = read_store(spark, store)
    digests = {p: hashlib.sha256(c).hexdigest() for p, c in (("/a", b"x"), ("/b", b"z"), ("/c", b"x"))}
    assert {r.path: r.digest for r in rows.collect()} == digests and rows.count() == 3
    # A stream with a new checkpoint starts at batch 0 again and adds to the store.
    second = str(tmp_path / "in2")
    corpus({"/d": b"x", "/a": b"new"}).write.parquet(second)
    stream = spark.readStream.schema(corpus({"/a": b""}).schema).parquet(second)
    ingest(stream, store, str(tmp_path / "ckpt2")).awaitTermination(120)
    digests |= {p: hashlib.sha256(c).hexdigest() for p, c in (("/d", b"x"), ("/a", b"new"))}
    assert {r.path: r.digest for r in read_store(spark, store).collect()} == digests
    assert len([d for d in os.listdir(store) if d.startswith("stream=")]) == 2


def test_tables_lie_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert settle(spark.range(3), "probe").folder.startswith(named + "/contentdup/")
