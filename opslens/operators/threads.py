"""Threads of messages: which message each reply goes back to, and how far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.joins import join_splitting_heavy_keys
from opslens.sources.sinks import create_table_as, work_folder


def reply_chains(messages: DataFrame, message: str = "message_id", parent: str = "parent_message_id", heavy: int = 100_000) -> DataFrame:
    """message, root, depth and state of every message, by pointer jumping in rounds.

    Every open message points to an earlier one of its chain.  In a round it takes over the pointer of the one it
    points to, which doubles the distance, so a chain of n links settles in about log2(n) rounds.  Settled messages
    leave the rounds; they are only looked up.  A message that very many point to is joined by itself.

    States: ``rooted`` goes back to a message without parent; ``orphaned`` goes back to one whose parent is missing (that one
    is the root); ``cyclic`` never ends, so root and depth are NULL.  A repeated message counts once, with its smallest
    parent; rows without a message id are left out.
    """
    spark = messages.sparkSession
    node = F.col(message).alias("node")
    nodes = messages.where(F.col(message).isNotNull()).groupBy(node).agg(F.min(parent).alias("to"))
    nodes = create_table_as(nodes, work_folder(spark, "messages"))
    known = nodes.select(F.col("node").alias("to"), F.lit(True).alias("there"))
    first = join_splitting_heavy_keys(nodes, known, "to", heavy)
    state = F.when(F.col("to").isNull(), "rooted").when(F.col("there").isNull(), "orphaned")
    held = first.select(
        "node",
        F.when(state.isNull(), F.col("to")).otherwise(F.col("node")).alias("to"),
        F.when(state.isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("hops"),
        state.alias("state"),
    )
    held = create_table_as(held, work_folder(spark, "chains"))
    settled, open_ones = held.where("state is not null"), held.where("state is null")
    left = open_ones.count()
    # after this many doublings every chain has ended; what is open then runs in circles
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        ahead = settled.unionByName(open_ones).select(
            F.col("node").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("state").alias("end")
        )
        jumped = join_splitting_heavy_keys(open_ones, ahead, "to", heavy)
        jumped = jumped.select("node", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.col("end").alias("state"))
        held = create_table_as(jumped, work_folder(spark, "chains"))
        settled, open_ones = settled.unionByName(held.where("state is not null")), held.where("state is null")
        left = open_ones.count()
    circles = open_ones.select("node", F.lit(None).cast(nodes.schema["to"].dataType).alias("to"), F.lit(None).cast("long").alias("hops"), F.lit("cyclic").alias("state"))
    return settled.unionByName(circles).select(
        F.col("node").alias(message), F.col("to").alias(f"root_{message}"), F.col("hops").alias("depth"), "state"
    )


def thread_shapes(chains: DataFrame, message: str = "message_id") -> DataFrame:
    """Messages, longest chain and replies to the root, per state and root; all cyclic messages are one row."""
    return chains.groupBy("state", f"root_{message}").agg(
        F.count(F.lit(1)).alias("messages"), F.max("depth").alias("longest"), F.count_if(F.col("depth") == 1).alias("direct_replies")
    )
