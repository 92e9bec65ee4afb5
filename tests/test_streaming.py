"""Duplicates among arriving items: batches, restarts, late items, bounded state."""

import hashlib
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contentdup.streaming.arrivals import Arrivals, find_arriving

START = datetime(2024, 1, 1)
ITEMS = "path string, size_bytes bigint, digest string, arrived timestamp"


def rows(items):
    """(path, content, hours after the start) as digested items."""
    return [(p, len(c), hashlib.sha256(c).hexdigest(), START + timedelta(hours=h)) for p, c, h in items]


def found(arrivals):
    return {(r.path, r.duplicate_of, r.late) for r in arrivals.found.collect()}


def plain(batches, hours):
    """The same rules, item by item."""
    state, seen, out = {}, None, set()
    for batch in batches:
        bound = None if seen is None else seen - hours
        late = [i for i in batch if bound is not None and i[2] < bound]
        timely = sorted((i for i in batch if i not in late), key=lambda i: (i[2], i[0]))
        for path, content, hour in timely:
            if content not in state:
                state[content] = [path, hour]
            else:
                out.add((path, state[content][0], False))
            state[content][1] = max(state[content][1], hour)
        out |= {(p, state[c][0] if c in state else None, True) for p, c, _ in late}
        seen = max([i[2] for i in batch] + ([] if seen is None else [seen]), default=None)
        state = {c: v for c, v in state.items() if v[1] >= seen - hours}
    return out, state


@pytest.mark.parametrize("floor", [None, 1])
def test_batches_equal_the_rules(spark, tmp_path, floor):
    draw = random.Random(8)
    batches, number = [], 0
    for turn in range(4):
        batch = []
        for _ in range(25):
            number += 1
            batch.append((f"/{number:04d}", b"%d" % draw.randrange(12), turn * 6 + draw.randrange(-16, 8)))
        batches.append(batch)
    arrivals = Arrivals(spark, str(tmp_path / "a"), within="10 hours", floor=floor)
    for turn, batch in enumerate(batches):
        arrivals.take(spark.createDataFrame(rows(batch), ITEMS), turn)
    wanted, state = plain(batches, 10)
    assert found(arrivals) == wanted and any(late for _, _, late in wanted)
    assert {r.first_path for r in arrivals.state.collect()} == {path for path, _ in state.values()}
    assert len(os.listdir(tmp_path / "a" / "state")) == 2


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """Spark repeats a batch that it has not recorded, with the same items."""
    arrivals = Arrivals(spark, str(tmp_path / "a"))
    one, two = rows([("/a", b"x", 0), ("/b", b"x", 1)]), rows([("/c", b"x", 2), ("/d", b"y", 2)])
    for turn, batch in ((0, one), (0, one), (1, two), (1, two)):
        arrivals.take(spark.createDataFrame(batch, ITEMS), turn)
    assert found(arrivals) == {("/b", "/a", False), ("/c", "/a", False)}
    assert arrivals.state.count() == 2
    arrivals.take(spark.createDataFrame([], ITEMS), 2)
    assert arrivals.state.count() == 2


def test_state_forgets(spark, tmp_path):
    arrivals = Arrivals(spark, str(tmp_path / "a"), within="5 hours")
    for turn in range(8):
        batch = rows([(f"/{turn}", b"%d" % turn, turn * 3), (f"/again{turn}", b"%d" % (turn - 1), turn * 3)])
        arrivals.take(spark.createDataFrame(batch, ITEMS), turn)
        assert arrivals.state.count() <= 4
    assert found(arrivals) == {(f"/again{t}", f"/{t - 1}", False) for t in range(1, 8)}


def test_stream_that_is_restarted(spark, corpus, tmp_path):
    """A stopped stream goes on where it was, with what it remembers."""
    incoming, checkpoint = str(tmp_path / "in"), str(tmp_path / "ckpt")
    arrivals = Arrivals(spark, str(tmp_path / "a"), within="100 days")
    every = {"/a": b"x", "/b": b"y", "/c": b"x", "/d": b"z", "/e": b"y", "/f": b"x"}
    for turn, paths in enumerate((["/a", "/b"], ["/c", "/d"], ["/e", "/f"])):
        items = corpus({p: every[p] for p in paths}).withColumn("arrived", F.timestamp_seconds(F.lit(turn * 100)))
        items.write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(items.schema).parquet(incoming)
        find_arriving(stream, Arrivals(spark, arrivals.folder, "100 days"), checkpoint).awaitTermination(120)
    assert found(arrivals) == {("/c", "/a", False), ("/e", "/b", False), ("/f", "/a", False)}
