"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each
query runs once to warm up, then its best of two runs counts.

``python bench.py --scale [copies]`` prints another line: rows and bytes per
second of a scan over the documents copied many times (by default to about a
million rows, a third of them in one group), and how many rows a re-scan
digests when one document in a hundred is new.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from contentdup.catalogue import QUERIES  # noqa: E402
from contentdup.operators.settle import settle  # noqa: E402
from contentdup.plans.rescan import rescan_items, store_rows  # noqa: E402
from contentdup.plans.scan import scan_items  # noqa: E402
from contentdup.plans.store import DigestStore  # noqa: E402
from contentdup.sources.tables import table_items  # noqa: E402
from contentdup.spec import ScanSpec  # noqa: E402

HEADLINE = [
    "dupes_full",
    "dupes_quick",
    "dupes_multi_region",
    "dupes_legacy",
    "dupes_groups",
    "scan_summary",
    "scan_funnel",
    "scan_audit_counts",
    "detail_report",
    "removal_manifest",
    "rescan_incremental",
]
# Repeats of a query before it is timed, and timed runs.
WARM_UPS, RUNS = 1, 2


def timed(spark, name, folder):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def scale(spark, folder, copies):
    """Digest, group and re-scan ``copies`` versions of every document."""
    documents = table_items(
        spark.read.parquet(f"{folder}/documents.parquet"), F.col("doc_id").cast("string"), F.col("text")
    ).select("path", "content", "size_bytes")
    many = documents.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    # A third of the rows hold one text, the others end in a number of their own.
    own = F.concat("content", F.concat_ws("-", "path", "copy").cast("binary"))
    content = F.when(F.pmod(F.xxhash64("path", "copy"), F.lit(3)) == 0, F.lit(b"one text " * 100)).otherwise(own)
    rows = many.select(F.concat_ws("/", F.lit(""), "copy", "path").alias("path"), content.alias("content"))
    made = settle(rows.withColumn("n_bytes", F.octet_length("content")), "scale-corpus")
    n_rows, n_bytes = made.df.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    items = table_items(made.df, F.col("path"), F.col("content"), size=F.col("n_bytes"))
    found = {}
    for turn in range(2):
        start = time.perf_counter()
        with scan_items(items) as scan:
            members = scan.members.n_rows
            found["scan_sec"] = round(time.perf_counter() - start, 2)
            digests = settle(scan.digests.df, "kept-digests")
    versioned = items.withColumn("version", F.lit(1))
    known = digests.df.withColumn("version", F.lit(1)).where(F.pmod(F.xxhash64("path"), F.lit(100)) != 1)
    store = DigestStore.create(store_rows(known, ScanSpec(), "version"), digests.folder + "-store")
    start = time.perf_counter()
    again = rescan_items(versioned, store, version="version")
    rescan_sec = time.perf_counter() - start
    return found | {
        "rows": n_rows,
        "rows_per_sec": round(n_rows / found["scan_sec"]),
        "mb_per_sec": round(n_bytes / 1e6 / found["scan_sec"]),
        "members": members,
        "rescan_sec": round(rescan_sec, 2),
        "rescan_new": again.n_fresh,
        "rescan_digested": again.n_digested,
    }


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if sys.argv[1:2] == ["--scale"]:
        copies = int(sys.argv[2]) if len(sys.argv) > 2 else 100
        result = scale(spark, folder, copies)
        spark.stop()
        print(json.dumps({"metric": "scan of many documents", "value": result["rows_per_sec"], "unit": "rows/s"} | result))
        return
    seconds = {}
    for name in HEADLINE:
        for _ in range(WARM_UPS):
            timed(spark, name, folder)
        seconds[name] = round(min(timed(spark, name, folder) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
