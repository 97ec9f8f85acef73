"""Queries over conversations and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import memory
from skein.plans.catalog import query
from skein.sources import tables as t
from skein.streaming import streams

WINDOW_SQL = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM message),
s AS (SELECT * FROM n WHERE k <= 6 AND role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''),
h AS (SELECT conv_id, turn, id, role, text FROM (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM s) WHERE turn >= f)
"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.history_window(t.messages(spark, sf_dir), 3)


@query("history_window", WINDOW_SQL + "SELECT conv_id, turn, id, role, text FROM h")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("conv_id", "turn", "id", "role", "text")


@query("history_window_kept", WINDOW_SQL + "SELECT conv_id, turn, id, role, text FROM h WHERE conv_id % 11 <> 0")
def history_window_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.messages(spark, sf_dir)
    return memory.history_window(rows, 3, rows.where("conv_id % 11 <> 0").select("conv_id")).select("conv_id", "turn", "id", "role", "text")


@query("latest_summary", "SELECT conv_id, id, text FROM message WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest(t.messages(spark, sf_dir).where("role = 'assistant'"), ["conv_id"], "turn").select("conv_id", "id", "text")


@query("summary_range", """
WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM message WHERE role = 'user'),
c AS (SELECT conv_id, min(CASE WHEN k <= 2 THEN id END) AS before FROM u GROUP BY conv_id HAVING count(*) >= 3)
SELECT m.conv_id, m.id, m.role, m.text FROM message m JOIN c USING (conv_id) WHERE m.role IN ('user', 'assistant') AND m.id < c.before""")
def summary_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.summary_range(t.messages(spark, sf_dir), least_turns=3, kept_turns=2)


@query("history_with_summary", WINDOW_SQL + """, m AS (SELECT conv_id, -1 AS turn, 'system' AS role, 'Summary: ' || text AS text FROM message WHERE role = 'system' AND conv_id IN (SELECT conv_id FROM h)
UNION ALL SELECT conv_id, turn, role, text FROM h)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM m GROUP BY conv_id""")
def history_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = t.messages(spark, sf_dir).where("role = 'system'").select("conv_id", "text")
    rows = memory.history_with_summary(_history(spark, sf_dir), system)
    return rows.select("conv_id", F.concat_ws("\n", F.transform("history", lambda h: F.concat(h["role"], F.lit(": "), h["text"]))).alias("said"))


@query("rewrite_context", """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM message),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM n WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, role FROM s WHERE k > greatest(0, n - 4)""")
def rewrite_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.rewrite_context(t.messages(spark, sf_dir)).select("conv_id", "turn", "role")


@query("conversation_rollup", "SELECT conv_id, min(id) AS first_id, max(id) AS last_id, count(*) AS user_turns FROM message WHERE role = 'user' GROUP BY conv_id")
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.rollup(t.messages(spark, sf_dir))


USER_ROLLUP_SQL = "SELECT conv_id % 10 AS user_id, conv_id, min(id) AS first_id, max(id) AS last_id, count(*) AS user_turns FROM message WHERE role = 'user' GROUP BY 1, 2"


def _of_users(conversations: DataFrame) -> DataFrame:
    return conversations.select((F.col("conv_id") % 10).alias("user_id"), "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")


@query("conversation_rollup_user", USER_ROLLUP_SQL)
def conversation_rollup_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.rollup(_of_users(t.table(spark, sf_dir, "conversations")), ("user_id", "conv_id"))


@query("rollup_stream", USER_ROLLUP_SQL)
def rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.rollup_stream(spark, f"{sf_dir}/conversations.parquet", _of_users, ("user_id", "conv_id"))


@query("conversation_list", "SELECT conv_id % 10 AS user_id, conv_id, max(id) AS last_id, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY max(id) DESC) AS pos FROM message WHERE role = 'user' GROUP BY conv_id")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = memory.rollup(t.messages(spark, sf_dir)).select((F.col("conv_id") % 10).alias("user_id"), "conv_id", "last_id")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_id"))).cast("long"))


LATEST_SQL = """
WITH a AS (SELECT message_id, user_id FROM chat_message WHERE role = 'assistant'),
f AS (SELECT f.* FROM feedback f WHERE (message_id, user_id) IN (SELECT message_id, user_id FROM a))
SELECT message_id, user_id, vote, submit_time FROM f QUALIFY row_number() OVER (PARTITION BY message_id, user_id ORDER BY submit_time DESC, event_id) = 1"""


@query("feedback_latest", LATEST_SQL)
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest_votes(t.feedback(spark, sf_dir), t.chat_messages(spark, sf_dir)).withColumn("vote", F.col("vote").cast("int"))


@query("feedback_stream", LATEST_SQL)
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.feedback_stream(spark, f"{sf_dir}/events.parquet", t.chat_messages(spark, sf_dir)).withColumn("vote", F.col("vote").cast("int"))


OWNED_SQL = """
SELECT v.message_id, v.user_id, v.vote, v.submit_time FROM vote_event v JOIN chat_message m ON m.message_id = v.message_id AND m.user_id = v.user_id AND m.role = 'assistant'
WHERE v.vote <> 0 QUALIFY row_number() OVER (PARTITION BY v.message_id, v.user_id ORDER BY v.submit_time DESC, v.event_id) = 1"""


@query("feedback_owned", OWNED_SQL)
def feedback_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest_votes(t.votes(spark, sf_dir), t.chat_messages(spark, sf_dir))


@query("feedback_owned_stream", OWNED_SQL)
def feedback_owned_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return streams.owned_votes(t.votes_of(streams.file_stream(spark, path)), t.chat_messages_of(streams.file_stream(spark, path)))


@query("message_at_or_before", """
SELECT s.session_id, s.user_id, max(m.message_id) AS message_id FROM session s LEFT JOIN chat_message m ON m.user_id = s.user_id AND m.role = 'assistant' AND m.create_time <= s.create_time GROUP BY 1, 2""")
def message_at_or_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = t.chat_messages(spark, sf_dir).where("role = 'assistant'")
    return memory.newest_before(answers, t.sessions(spark, sf_dir), ["user_id"], "create_time", "message_id").select("session_id", "user_id", "message_id")


@query("messages_with_vote", """
WITH v AS (SELECT message_id, user_id, vote FROM feedback QUALIFY row_number() OVER (PARTITION BY message_id, user_id ORDER BY submit_time DESC, event_id) = 1)
SELECT m.id, m.conv_id, m.role, v.vote FROM message m LEFT JOIN v ON v.message_id = m.id AND v.user_id = m.conv_id % 50""")
def messages_with_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = memory.latest_votes(t.feedback(spark, sf_dir)).select(F.col("message_id").alias("id"), F.col("user_id").alias("_user"), F.col("vote").cast("int").alias("vote"))
    rows = t.messages(spark, sf_dir).withColumn("_user", F.col("conv_id") % 50)
    return rows.join(votes, ["id", "_user"], "left").select("id", "conv_id", "role", "vote")
