"""Chat logs: drop snapshots that a longer conversation contains, then render.

A log often holds the same conversation several times, cut off at different
turns. Every turn carries the hash of the conversation up to it. A
conversation whose hash at its end is the hash of another one before one of
its turns is a prefix of that one. Hashes are sums over the turns of position,
role and text, four sums of 32 bits each, so that a conversation of any length
can be spread over many pieces: a piece sums up its own turns, and what it
takes over from the pieces before it comes from a table of one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.llm.ordering import carried, number_within
from contentdup.operators.settle import settle

TURNS_PER_PART = 256
_SUMS = ["s0", "s1", "s2", "s3"]
_LOW = (1 << 32) - 1


def _placed(conversations: DataFrame) -> DataFrame:
    """Turns in order with their position from 1, however long a conversation."""
    order = ["conv_id", "turn", "role", "text"]
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    )
    return number_within(turns, "conv_id", order[1:], "turns")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the sums up to and including it."""
    first, second = (F.xxhash64(F.lit(seed), "pos", "role", "text") for seed in (1, 2))
    parts = [part for h in (first, second) for part in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]
    hashed = settle(
        turns.select("conv_id", "pos", "piece", *(p.alias(f"h{i}") for i, p in enumerate(parts))), "turn-hashes"
    ).df
    totals = hashed.groupBy("piece", "conv_id").agg(*(F.sum(f"h{i}").alias(s) for i, s in enumerate(_SUMS)))
    so_far = W.partitionBy("piece", "conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        hashed.repartition("piece")
        .select("*", *(F.sum(f"h{i}").over(so_far).alias(s) for i, s in enumerate(_SUMS)))
        .join(F.broadcast(carried(totals, "conv_id", _SUMS)), ["piece", "conv_id"], "left")
        .select(
            "conv_id",
            "pos",
            *((F.col(s) + F.coalesce(f"{s}_before", F.lit(0))).alias(s) for s in _SUMS),
            *(f"h{i}" for i in range(4)),
        )
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no prefix of a
    longer one; of identical ones the smallest ``conv_id``."""
    prefixes = settle(_prefixes(turns), "turn-prefixes").df
    ends = (
        prefixes.groupBy("conv_id")
        .agg(F.max(F.struct("pos", *_SUMS)).alias("end"))
        .select("conv_id", F.col("end.pos").alias("n_turns"), *(f"end.{s}" for s in _SUMS))
    )
    # The state before a turn is that of a strictly shorter conversation.
    shorter = (
        prefixes.where("pos > 1")
        .select((F.col("pos") - 1).alias("n_turns"), *((F.col(s) - F.col(f"h{i}")).alias(s) for i, s in enumerate(_SUMS)))
        .distinct()
    )
    single = ends.groupBy("n_turns", *_SUMS).agg(F.min("conv_id").alias("conv_id"))
    return single.join(shorter, ["n_turns", *_SUMS], "left_anti").select("conv_id", "n_turns")


def format_chats(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Render the maximal conversations, each turn as ``<|role|>``, a line end,
    the text, ``<|end|>`` and a line end.

    Returns ``conv_id, part, n_turns, rendered``: ``n_turns`` of the whole
    conversation, and its text in parts of ``turns_per_part`` turns, numbered
    from 0 (nearly all have one part), so no conversation is gathered whole.

    Turns are ordered by ``turn`` (null first), role and text; repeated turns
    stay. A null role or text counts as empty. Rows without ``conv_id`` belong
    to no conversation and are left out. An empty table gives no rows; further
    columns are ignored.
    """
    turns = settle(_placed(conversations), "placed-turns").df
    kept = settle(maximal_conversations(turns), "kept-conversations").df
    shown = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    part = F.floor((F.col("pos") - 1) / F.lit(turns_per_part)).cast("bigint")
    return (
        turns.join(kept, "conv_id")
        .select("conv_id", part.alias("part"), "n_turns", F.struct("pos", shown.alias("shown")).alias("turn"))
        .groupBy("conv_id", "part", "n_turns")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["shown"]), "").alias("rendered"))
    )
