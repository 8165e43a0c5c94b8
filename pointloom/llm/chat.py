"""Cumulative-snapshot collapse of logged conversations, in DataFrame operations alone.

A conversation that is logged after each turn leaves snapshots, each a prefix of the next.
Each prefix of a conversation gets a rolling hash: that of the prefix before it plus that of
the turn at its place. Of equal conversations the one with the least id stays; those whose hash is that of a
proper prefix of another go by an anti-join; the rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written


def _tagged(name: str) -> Column:
    """A text that differs for null and empty, and that tells its own length."""
    return F.when(F.col(name).isNull(), "-").otherwise(F.concat(F.octet_length(name).cast("string"), F.lit(":"), F.col(name)))


#: Words of 32 bits of a turn's digest, and of the rolling hash that they are added up to.
LANES = 8


def _rolled(placed: DataFrame) -> DataFrame:
    """(conv_id, place, hash, last): the rolling hash of each prefix, and whether it is the whole conversation.

    A turn's digest is of its place, role and text. The hash of a prefix is that of the prefix
    before it plus the words of the digest, lane by lane, so it takes one running sum over the
    turns, whatever their number; 32-bit words do not overflow a long before 2^31 turns.
    """
    w = Window.partitionBy("conv_id").orderBy("place")
    words = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"w{k}") for k in range(LANES)]
    sums = [F.sum(f"w{k}").over(w).cast("string") for k in range(LANES)]
    rolled = F.unhex(F.sha2(F.concat_ws(",", F.col("place").cast("string"), *sums), 256))
    return placed.select("conv_id", "place", *words).select("conv_id", "place", rolled.alias("hash"), F.lead("place").over(w).isNull().alias("last"))


def rendered(turns: Column) -> Column:
    """``<|role|>``, the text and ``<|end|>`` for each turn; a null role is unknown, a null text empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n<|end|>\n"))), "")


def collapse(conversations: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies, rendered.

    conversations: conv_id, turn, role, text; other columns are not read. Turns are in order
    of turn (null first), then role, then text; repeated rows are turns of their own. A
    conversation is what its roles and texts are, not how its turns are numbered. n_copies
    counts the equal conversations of which the one with the least conv_id is returned.
    Rows with a null conv_id go. A conversation is one row of the result, so its turns are
    brought together when it is rendered; hashes are made turn by turn, in time in proportion.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    digest = F.sha2(F.concat(F.col("place").cast("string"), F.lit("|"), _tagged("role"), F.lit("|"), _tagged("text")), 256)
    whole = written(_rolled(rows.withColumn("place", place).select("conv_id", "place", digest.alias("digest"))))
    each = whole.where("last").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), F.first("place").cast("long").alias("n_turns"))
    # Proper prefixes; common ones come together before the shuffle.
    prefixes = whole.where("not last").select("hash").distinct()
    maximal = each.join(prefixes, "hash", "left_anti").select("conv_id", "n_turns", "n_copies")
    # Only the maximal conversations are rendered.
    own = rows.join(maximal, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return own.select("conv_id", "n_turns", "n_copies", rendered(F.col("turns")).alias("rendered"))
