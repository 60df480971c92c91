"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation several times, each time a few turns longer. A
rolling hash over the turns gives every prefix of a conversation a key; a
conversation whose whole key is a proper prefix key of another is a snapshot of
it. An anti-join leaves the maximal conversations, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vecspark.llm.support import write_step

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MASKED_ROLE = "assistant"


def _turn_key(seed: int) -> Column:
    return F.xxhash64(
        F.lit(seed), "place", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))
    )


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, n, k1, k2, role, text)``: each turn with the key of the prefix it ends.

    The key of a prefix is the exclusive or of 128-bit hashes of (place, role, text), so
    it rolls along the conversation in one pass of a window that holds no rows.
    """
    ordered = W.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    placed = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "role", "text", F.row_number().over(ordered).alias("place"), F.lead(F.lit(1)).over(ordered).isNull().alias("last"),
        "turn",
    )
    hashed = placed.withColumn("h1", _turn_key(1)).withColumn("h2", _turn_key(2))
    return hashed.select(
        "conv_id", "place", "last", "role", "text",
        F.bit_xor("h1").over(so_far).alias("k1"), F.bit_xor("h2").over(so_far).alias("k2"),
    )


def maximal_conversations(keyed: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)``: conversations that no longer one continues.

    Equal conversations are one; the smallest conv_id stands for them. Both sides
    of the anti-join are distinct keys, so common first turns and copies meet once.
    """
    key = ["place", "k1", "k2"]
    whole = keyed.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = keyed.where(~F.col("last")).select(*key).distinct()
    return whole.join(prefixes, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per kept conversation: conv_id, n_turns, n_copies, text, spans.

    ``spans`` holds ``[begin, end)`` in characters of the assistant's texts, for a loss mask.
    """
    turns = keyed.join(kept, "conv_id")
    head = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"))
    body = F.coalesce("text", F.lit(""))
    parts = turns.select(
        "conv_id", "n_turns", "n_copies",
        F.struct("place", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == MASKED_ROLE, F.lit(False)).alias("learn")).alias("part"),
    )
    rows = parts.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    tail = CLOSE + "\n"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def walk(acc, x):
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(
            (end + len(tail)).alias("at"), F.when(x["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    text = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
    return rows.select("conv_id", "n_turns", "n_copies", text.alias("text"), F.aggregate("parts", start, walk)["spans"].alias("spans"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Collapse snapshots of ``turns`` (conv_id, turn, role, text) and render what remains.

    Turns are ordered by (turn, role, text), nulls first; rows without conv_id
    belong to no conversation. A null role or text is rendered empty but differs
    from an empty one when conversations are compared. Repeated rows are turns of
    their own. An empty table gives an empty result.
    """
    keyed = prefix_keys(turns.select("conv_id", "turn", "role", "text"))
    kept = write_step(maximal_conversations(keyed), "maximal")
    return render(keyed, kept)
