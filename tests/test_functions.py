import fnmatch
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from contentdup.functions import (
    adaptive_prefix,
    base_name,
    digest_bytes,
    dir_names,
    dir_path,
    display_digest,
    fixed_prefix,
    format_bytes,
    prefix_length,
    relative_path,
    short_digest,
    three_regions,
)
from contentdup.operators.filters import matches_glob
from contentdup.spec import ScanSpec, split_list

KB, MB, GB, TB, PB = (1024**n for n in range(1, 6))


def human(size):
    units = ["bytes", "KB", "MB", "GB", "TB", "PB"]
    power = next((n for n in range(5) if size < 1024 ** (n + 1)), 5)
    return f"{size / 1024**power:.1f} {units[power]}"


def texts(spark, sizes, kind):
    rows = spark.createDataFrame([(s,) for s in sizes], f"size {kind}")
    return {r.size: r.text for r in rows.select("size", format_bytes(F.col("size")).alias("text")).collect()}


def test_format_bytes_ladder(spark):
    sizes = [0, 512, 1023, 1024, 1536, 1024 * 1023, int(2.5 * MB), int(2.5 * GB), int(2.5 * TB), PB, -1024]
    found = texts(spark, sizes, "bigint")
    assert list(found.values()) == [
        "0.0 bytes", "512.0 bytes", "1023.0 bytes", "1.0 KB", "1.5 KB", "1023.0 KB", "2.5 MB", "2.5 GB", "2.5 TB",
        "1.0 PB", "-1024.0 bytes",
    ]
    assert texts(spark, [0.5], "double") == {0.5: "0.5 bytes"}


def test_format_bytes_random_and_ties(spark):
    rng = random.Random(7)
    sizes = {rng.randrange(2 ** rng.randrange(1, 60)) for _ in range(4000)}
    sizes |= {n * unit // 4 for unit in (KB, MB, GB, TB) for n in range(4, 400)}
    found = texts(spark, sorted(sizes), "bigint")
    assert {s: t for s, t in found.items() if t != human(s)} == {}


def test_digest_texts(spark):
    digest = "0123456789abcdef" * 4
    row = spark.range(1).select(
        short_digest(F.lit(digest)).alias("short"), display_digest(F.lit(digest)).alias("display")
    ).first()
    assert (row.short, row.display) == ("01234567...", "01234567...89abcdef")


def test_path_parts(spark):
    row = spark.range(1).select(
        base_name(F.lit("/a/b/c.txt")).alias("name"),
        dir_names(F.lit("/a/b/c.txt")).alias("dirs"),
        dir_path(F.lit("/a/b/c.txt")).alias("dir"),
        relative_path(F.lit("/a/b/c.txt"), "/a/").alias("below"),
        relative_path(F.lit("/ab/c.txt"), "/a").alias("beside"),
        dir_names(F.lit("c.txt")).alias("none"),
    ).first()
    assert tuple(row) == ("c.txt", ["a", "b"], "/a/b", "b/c.txt", "/ab/c.txt", [])


def test_prefix_tiers(spark):
    sizes = [0, 8192, 8193, MB, MB + 1, 100 * MB, 100 * MB + 1]
    rows = spark.createDataFrame([(s,) for s in sizes], "size bigint")
    assert [r[0] for r in rows.select(prefix_length(F.col("size"))).collect()] == [
        -1, -1, 16384, 16384, 32768, 32768, 65536,
    ]


def slices(content, how):
    size = len(content)
    if how == "regions" and size > 12288:
        return b"".join(content[p : p + 4096] for p in (0, size // 2 - 2048, size - 4096))
    if how == "fixed":
        return content[:4096]
    return content if size <= 8192 else content[:16384]


def test_digested_bytes_match_slicing(spark):
    rng = random.Random(3)
    edges = [0, 1, 4095, 4096, 4097, 8191, 8192, 8193, 12287, 12288, 12289, 16383, 16384, 16385, 20001]
    contents = [rng.randbytes(n) for n in edges + [rng.randrange(40000) for _ in range(40)]]
    rows = spark.createDataFrame([(c, len(c)) for c in contents], "content binary, size bigint")
    content, size = F.col("content"), F.col("size")
    found = rows.select(
        "content",
        digest_bytes(fixed_prefix(content, 4096)).alias("fixed"),
        digest_bytes(adaptive_prefix(content, size)).alias("adaptive"),
        digest_bytes(three_regions(content, size)).alias("regions"),
        digest_bytes(content, "blake2b").alias("blake"),
    ).collect()
    for row in found:
        raw = bytes(row.content)
        for how in ("fixed", "adaptive", "regions"):
            assert row[how] == hashlib.sha256(slices(raw, how)).hexdigest(), (how, len(raw))
        assert row.blake == hashlib.blake2b(raw).hexdigest() and len(row.blake) == 128


def test_globs_match_shell_rules(spark):
    rng = random.Random(11)
    alphabet = "ab.A[]-!+(1\n"
    names = ["".join(rng.choices(alphabet, k=rng.randrange(1, 7))) for _ in range(400)]
    patterns = ["*.tmp", "a*", "?", "[!a]*", "[ab]?", "*a*b*", "*.A", "a.b", "[]]*", "[!]]", "*", "(a", "a+", "[a-b]*"]
    patterns += ["**a", "[!1-5]?*"]
    rows = spark.createDataFrame([(n,) for n in names + ["x.tmp", "X.TMP", "x.tmp\n"]], "name string")
    flags = [matches_glob(F.col("name"), (p,)).alias(f"p{i}") for i, p in enumerate(patterns)]
    for row in rows.select("name", *flags).collect():
        for i, pattern in enumerate(patterns):
            assert row[f"p{i}"] == fnmatch.fnmatchcase(row["name"], pattern), (row["name"], pattern)


def test_spec():
    assert ScanSpec.of(quick=True, multi_region=True).mode == "quick"
    assert ScanSpec.of(multi_region=True).mode == "multi_region"
    assert (ScanSpec.from_megabytes().min_bytes, ScanSpec.from_megabytes().max_bytes) == (4 * MB, 4096 * MB)
    assert split_list("*.tmp, *.bak,,") == ("*.tmp", "*.bak")
    for bad in ({"mode": "fast"}, {"algorithm": "md5"}, {"prefix_bytes": 0}):
        with pytest.raises(ValueError):
            ScanSpec(**bad)


def test_random_globs_match_shell_rules(spark):
    source = random.Random(12)
    letters = "ab[]^&\\-!*?.c\n{}()+$|#x"
    made = lambda n: "".join(source.choice(letters) for _ in range(source.randint(0, n)))
    patterns = ["[a[]x", "[a[b]x", "[]a]", "[!]a]", "[a-]", "[--a]", "[z-a]", "[!z-a]", "[a&&b]", "[", "[!", "[]", "\\[", *(
        "[" + made(5) + "]" + made(3) for _ in range(150)
    ), *(made(7) for _ in range(100))]
    names = [made(5) for _ in range(250)] + ["ax", "[x", "bx", "]", "-", "z", "&", ""]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for start in range(0, len(patterns), 50):
        part = patterns[start : start + 50]
        flags = [matches_glob(F.col("name"), (p,)).alias(f"p{i}") for i, p in enumerate(part)]
        for row in rows.select("name", *flags).collect():
            for i, pattern in enumerate(part):
                assert row[f"p{i}"] == fnmatch.fnmatchcase(row["name"], pattern), (row["name"], pattern)
