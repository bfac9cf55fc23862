"""Queries on conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sutraloom.operators import dialogue
from sutraloom.operators.chunks import last_wins
from sutraloom.plans.page_queries import SP
from sutraloom.plans.registry import query
from sutraloom.runtime import ensure_checkpoint_dir, ship_package, table
from sutraloom.streaming import sessions

_ONCE = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY coalesce(arrived_at, TIMESTAMP '9999-12-31'), coalesce(content, '')) AS dup FROM chat_messages) WHERE dup = 1)"""
_LAST = f"SELECT * FROM (SELECT session_id, seq, role, content, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM {_ONCE})"


def _messages(spark, d):
    return dialogue.delivered_once(table(spark, d, "chat_messages"))


@query("messages_once", f"SELECT session_id, seq, role, content FROM {_ONCE}")
def messages_once(spark, d):
    return _messages(spark, d).select("session_id", "seq", "role", "content")


@query("memory_window", f"SELECT session_id, seq, role, content FROM ({_LAST}) WHERE r <= 20")
def memory_window(spark, d):
    return dialogue.last_messages(_messages(spark, d)).select("session_id", "seq", "role", "content")


@query("memory_last_n", f"SELECT session_id, string_agg(upper(coalesce(role, '')) || ': ' || coalesce(content, ''), chr(10) ORDER BY seq) AS history FROM ({_LAST}) WHERE r <= 5 GROUP BY session_id")
def memory_last_n(spark, d):
    return dialogue.history(_messages(spark, d))


_SET = f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({{c}}, '')), '{SP}+'), lambda w: w <> ''))"


@query("memory_relevant", f"""WITH m AS (SELECT session_id, seq, role, content, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS pos, {_SET.replace('{c}', 'content')} AS ws FROM {_ONCE}),
p AS (SELECT a.session_id, a.seq, b.seq AS bseq, upper(coalesce(b.role, '')) || ': ' || left(coalesce(b.content, ''), 150) || '...' AS line,
  row_number() OVER (PARTITION BY a.session_id, a.seq ORDER BY len(list_intersect(a.ws, b.ws)) DESC, b.seq) AS k, len(list_intersect(a.ws, b.ws)) AS n
  FROM m a JOIN m b ON a.session_id = b.session_id AND b.pos BETWEEN a.pos - 20 AND a.pos - 1 WHERE a.role = 'user' AND len(list_intersect(a.ws, b.ws)) >= 2)
SELECT m.session_id, m.seq, CASE WHEN count(p.bseq) = 0 THEN '' ELSE 'RELEVANT HISTORY:' || chr(10) || string_agg(p.line, chr(10) ORDER BY p.k) END AS relevant
FROM m LEFT JOIN p ON p.session_id = m.session_id AND p.seq = m.seq AND p.k <= 3 WHERE m.role = 'user' GROUP BY m.session_id, m.seq""")
def memory_relevant(spark, d):
    return dialogue.relevant_history(_messages(spark, d))


_NAMED = " UNION ALL ".join(f"SELECT session_id, {i} AS i, '{c}' AS c, min(seq) AS first_seq FROM {_ONCE} WHERE role = 'user' AND contains(lower(content), '{c}') GROUP BY session_id" for i, c in enumerate(dialogue.CONDITIONS))


@query("user_profile", f"""WITH n AS ({_NAMED}), g AS (SELECT session_id, list(c ORDER BY first_seq, i) AS conditions FROM n GROUP BY session_id),
s AS (SELECT DISTINCT session_id FROM chat_messages), a AS (SELECT s.session_id, coalesce(conditions, []) AS conditions FROM s LEFT JOIN g ON g.session_id = s.session_id),
b AS (SELECT session_id, conditions, list_filter(conditions, lambda c: c IN ('vata', 'pitta', 'kapha')) AS doshas, list_filter(conditions, lambda c: c NOT IN ('vata', 'pitta', 'kapha'))[1:5] AS others FROM a)
SELECT session_id, array_to_string(conditions, ',') AS conditions, CASE WHEN len(conditions) = 0 THEN '' ELSE 'USER PROFILE: ' || array_to_string(list_filter([
  CASE WHEN len(doshas) > 0 THEN 'Doshas: ' || array_to_string(doshas, ', ') END, CASE WHEN len(others) > 0 THEN 'Concerns: ' || array_to_string(others, ', ') END], lambda x: x IS NOT NULL), ' | ') END AS summary FROM b""")
def user_profile(spark, d):
    return dialogue.profile(_messages(spark, d)).select("session_id", F.array_join("conditions", ",").alias("conditions"), "summary")


@query("session_stats", f"SELECT session_id, count(*) AS message_count, min(ts) AS created_at, max(ts) AS last_active FROM {_ONCE} GROUP BY session_id")
def session_stats(spark, d):
    return dialogue.session_counters(_messages(spark, d))


@query("api_stats", f"SELECT count(DISTINCT session_id) AS total_sessions, count(*) AS total_messages FROM {_ONCE}")
def api_stats(spark, d):
    return dialogue.session_counters(_messages(spark, d)).agg(F.count("*").alias("total_sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"))


@query("sessions_after_reset", f"SELECT session_id, seq FROM {_ONCE} WHERE session_id NOT IN (SELECT session_id FROM chat_messages WHERE contains(lower(content), 'fever') AND session_id IS NOT NULL)")
def sessions_after_reset(spark, d):
    """Messages left when the sessions that mention fever are reset."""
    messages = _messages(spark, d)
    return dialogue.without_sessions(messages, messages.where(F.contains(F.lower("content"), F.lit("fever")))).select("session_id", "seq")


_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("stream_memory", f"""WITH n AS ({_NAMED}), g AS (SELECT session_id, string_agg(c, ',' ORDER BY first_seq, i) AS conditions FROM n GROUP BY session_id),
l AS (SELECT session_id, max(total) AS seen, string_agg(upper(coalesce(role, '')) || ': ' || coalesce(content, ''), chr(10) ORDER BY seq) AS remembered FROM (
  SELECT session_id, seq, role, content, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM {_ONCE} WHERE session_id IS NOT NULL) WHERE r <= 20 GROUP BY session_id)
SELECT l.session_id, l.seen, l.remembered, coalesce(g.conditions, '') AS conditions FROM l LEFT JOIN g ON g.session_id = l.session_id""")
def stream_memory(spark, d):
    """The memory of every session after the whole message table has run through the keyed stream."""
    ship_package(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE)
    try:
        stream = sessions.remember(sessions.folder_stream(spark, f"{d}/chat_messages.parquet"))
        updates = sessions.run_once(stream, f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = last_wins(updates, ["session_id"], ["batch"])
    return last.select("session_id", "seen", F.array_join("remembered", "\n").alias("remembered"), F.array_join("conditions", ",").alias("conditions"))
