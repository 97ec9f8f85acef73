"""Conversation memory: windows, summaries and roll-ups over message logs (conv_id, turn, id, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_window(messages: DataFrame, turns: int, conversations: DataFrame | None = None) -> DataFrame:
    """The newest 2 * turns rows of each conversation, oldest first; blanks and other roles go after the limit, then leading answers.

    With `conversations`, messages whose conversation has no row there are left out.
    """
    if conversations is not None:
        messages = messages.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    newest = messages.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_k") <= 2 * turns)
    spoken = newest.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    first_user = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return spoken.withColumn("_f", first_user).where(F.col("turn") >= F.col("_f")).drop("_k", "_f")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def newest_before(messages: DataFrame, moments: DataFrame, key: list[str], at: str, id_col: str) -> DataFrame:
    """Every row of `moments` (key and time `at`) with the largest id of its key's messages at or before that time; null if there are none.

    Both are put in one order per key and a running maximum is taken, so no pairs of messages and moments are made.
    """
    said = messages.select(*key, F.col(at).alias("_at"), F.col(id_col).alias("_id"), F.lit(None).cast(moments.schema).alias("_row"))
    asked = moments.select(*key, F.col(at).alias("_at"), F.lit(None).cast(messages.schema[id_col].dataType).alias("_id"), F.struct(*moments.columns).alias("_row"))
    # Messages have a null row and go first among equal times.
    so_far = Window.partitionBy(*key).orderBy(F.col("_at"), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = said.unionByName(asked).withColumn(id_col, F.max("_id").over(so_far))
    return both.where(F.col("_row").isNotNull()).select("_row.*", id_col)


def summary_range(messages: DataFrame, summarised: DataFrame | None = None, least_turns: int = 5, kept_turns: int = 4) -> DataFrame:
    """Ids to summarise in each conversation: after the last summarised one and before the oldest of the last `kept_turns` user turns."""
    users = messages.where("role = 'user'").withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("id"))))
    cut = users.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min(F.when(F.col("_k") <= kept_turns, F.col("id"))).alias("before")).where(F.col("turns") >= least_turns)
    last = cut.withColumn("after", F.lit(None).cast("long")) if summarised is None else cut.join(summarised.select("conv_id", F.col("last_id").alias("after")), "conv_id", "left")
    inside = (F.col("id") < F.col("before")) & (F.col("id") > F.coalesce(F.col("after"), F.lit(-1)))
    return messages.where(F.col("role").isin("user", "assistant")).join(last, "conv_id").where(inside).select("conv_id", "id", "role", "text")


def history_with_summary(history: DataFrame, summaries: DataFrame, prefix: str = "Summary: ") -> DataFrame:
    """The summary (prefixed once) before the history; a conversation without history has none."""
    said = F.when(F.col("text").startswith(prefix), F.col("text")).otherwise(F.concat(F.lit(prefix), F.col("text")))
    head = summaries.join(history.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), said.alias("text"))
    rows = head.unionByName(history.select("conv_id", "turn", "role", "text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))


def rewrite_context(history: DataFrame, kept: int = 4) -> DataFrame:
    """User and assistant rows after skipping as many as the whole history (any role) has above `kept`."""
    sized = history.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    spoken = sized.where(F.col("role").isin("user", "assistant")).withColumn("_k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return spoken.where(F.col("_k") > F.greatest(F.lit(0), F.col("_n") - kept)).drop("_n", "_k")


def rollup(messages: DataFrame, key: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row per conversation (or per user and conversation): its first user message and the last one's."""
    return messages.where("role = 'user'").groupBy(*key).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("user_turns"))


def latest_votes(events: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """The latest vote per message and user; only votes of 1 or -1 on existing assistant messages count, and, if `messages` has user_id, only those of the message's own user. Of equal times the first event stays."""
    valid = events.where(F.col("vote").isin(1, -1))
    if messages is not None:
        on = [c for c in ("message_id", "user_id") if c in messages.columns]
        valid = valid.join(messages.where("role = 'assistant'").select(*on).distinct(), on, "left_semi")
    order = Window.partitionBy("message_id", "user_id").orderBy(F.desc("submit_time"), "event_id")
    return valid.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("message_id", "user_id", "vote", "submit_time")
