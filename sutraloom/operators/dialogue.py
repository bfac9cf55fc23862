"""Memory of conversations: the last messages, the relevant ones, the speaker's profile, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from sutraloom.functions import text as T

#: Messages that a conversation remembers.
REMEMBERED = 20
# What a profile notes, in this order; the first three are kinds of constitution.
CONDITIONS = ("vata", "pitta", "kapha", "diabetes", "anxiety", "arthritis", "indigestion", "constipation", "stress", "sleep", "pain", "fever", "cold", "headache")
CONSTITUTIONS = CONDITIONS[:3]


def delivered_once(messages: DataFrame) -> DataFrame:
    """Messages by (session_id, seq); of repeated deliveries the first to arrive, then the smallest text."""
    rest = [c for c in messages.columns if c not in ("session_id", "seq")]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce("arrived_at", F.to_timestamp(F.lit("9999-12-31"))), F.coalesce("content", F.lit(""))))
    return messages.groupBy("session_id", "seq").agg(best.alias("_m")).select("session_id", "seq", "_m.*")


def last_messages(messages: DataFrame, n: int = REMEMBERED) -> DataFrame:
    """The last n messages of each session. A filter on row_number: each task keeps n rows per session before rows move."""
    rank = F.row_number().over(Win.partitionBy("session_id").orderBy(F.desc("seq")))
    return messages.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def history(messages: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, history): the last n messages as `ROLE: text` lines, oldest first."""
    line = F.concat(F.upper(F.coalesce("role", F.lit(""))), F.lit(": "), F.coalesce("content", F.lit("")))
    kept = last_messages(messages, n).select("session_id", F.struct("seq", line.alias("line")).alias("m"))
    lines = F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"])
    return kept.groupBy("session_id").agg(F.array_join(lines, "\n").alias("history"))


#: Messages of a session that one task orders.
BLOCK = 1_000


def numbered(messages: DataFrame, name: str) -> DataFrame:
    """Messages with their position in their session from 0, by seq. Those of a range of seq are ordered together; for
    the ranges of a session only their counts are."""
    rows = messages.withColumn("_range", F.floor(F.col("seq") / BLOCK))
    counts = rows.groupBy("session_id", "_range").agg(F.count("*").alias("_n"))
    earlier = Win.partitionBy("session_id").orderBy("_range").rowsBetween(Win.unboundedPreceding, -1)
    starts = counts.select(F.col("session_id").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Win.partitionBy("session_id", "_range").orderBy("seq"))
    met = rows.withColumn("_inside", inside).join(starts, F.col("session_id").eqNullSafe(F.col("_s")) & F.col("_range").eqNullSafe(F.col("_r")))
    return met.withColumn(name, F.col("_start") + F.col("_inside") - 1).drop("_range", "_s", "_r", "_start", "_inside")


def _word_set(c: Column) -> Column:
    return F.array_distinct(T.words(F.lower(F.coalesce(c, F.lit("")))))


def relevant_history(messages: DataFrame, n: int = 3, least: int = 2, remembered: int = REMEMBERED) -> DataFrame:
    """(session_id, seq, relevant): for each message of a user, those of the `remembered` messages before it that share
    at least `least` words with it, the most alike first, then the older; n of them as one text, empty without any.

    A frame of `remembered` rows bounds what is held for a message. Sessions are cut into blocks of BLOCK messages, each
    with the last messages of the block before it, so that a session of any length is no single task."""
    rows = numbered(messages.select("session_id", "seq", "role", "content"), "_at")
    block = F.floor(F.col("_at") / BLOCK)
    # a block's last messages stand in the next one, too
    last = F.when(F.col("_at") % BLOCK >= BLOCK - remembered, F.array(block, block + 1)).otherwise(F.array(block))
    spread = rows.withColumn("_own", block).withColumn("_block", F.explode(last))
    before = Win.partitionBy("session_id", "_block").orderBy("seq").rowsBetween(-remembered, -1)
    past = F.collect_list(F.struct("seq", "role", "content")).over(before)
    asked = spread.withColumn("_past", past).where((F.col("role") == "user") & (F.col("_own") == F.col("_block")))
    scored = T.let(_word_set(F.col("content")), lambda own: F.transform(F.col("_past"), lambda m: F.struct(F.size(F.array_intersect(own, _word_set(m["content"]))).alias("n"), m["seq"].alias("seq"), m["role"].alias("role"), m["content"].alias("content"))))
    hits = F.array_sort(F.transform(F.filter(scored, lambda m: m["n"] >= least), lambda m: F.struct((-m["n"]).alias("o"), m["seq"], m["role"], m["content"])))
    line = lambda m: F.concat(F.upper(F.coalesce(m["role"], F.lit(""))), F.lit(": "), F.left(F.coalesce(m["content"], F.lit("")), F.lit(150)), F.lit("..."))
    top = F.slice(hits, 1, n)
    text = F.when(F.size(hits) == 0, "").otherwise(F.array_join(F.concat(F.array(F.lit("RELEVANT HISTORY:")), F.transform(top, line)), "\n"))
    return asked.select("session_id", "seq", text.alias("relevant"))


def profile(messages: DataFrame) -> DataFrame:
    """(session_id, conditions, constitutions, summary) over all messages of users: conditions in order of first
    mention (in one message: in the list's order). It outlives the remembered messages. Sessions without a condition
    have empty lists and an empty summary."""
    low = F.lower(F.coalesce("content", F.lit("")))
    named = [F.min(F.when((F.col("role") == "user") & F.contains(low, F.lit(c)), F.col("seq"))).alias(f"_{i}") for i, c in enumerate(CONDITIONS)]
    first = messages.groupBy("session_id").agg(*named)
    pairs = F.array(*[F.struct(F.col(f"_{i}").alias("at"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CONDITIONS)])
    ordered = F.transform(F.array_sort(F.filter(pairs, lambda p: p["at"].isNotNull())), lambda p: p["c"])
    made = first.select("session_id", ordered.alias("conditions"))
    made = made.withColumn("constitutions", F.filter("conditions", lambda c: c.isin(*CONSTITUTIONS)))
    others = F.slice(F.filter("conditions", lambda c: ~c.isin(*CONSTITUTIONS)), 1, 5)
    parts = F.array_compact(F.array(
        F.when(F.size("constitutions") > 0, F.concat(F.lit("Doshas: "), F.array_join("constitutions", ", "))),
        F.when(F.size(others) > 0, F.concat(F.lit("Concerns: "), F.array_join(others, ", "))),
    ))
    return made.withColumn("summary", F.when(F.size("conditions") == 0, "").otherwise(F.concat(F.lit("USER PROFILE: "), F.array_join(parts, " | "))))


def session_counters(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_active"))


def without_sessions(messages: DataFrame, reset: DataFrame) -> DataFrame:
    """Messages of the sessions that were not reset."""
    return messages.join(reset.select("session_id").distinct(), "session_id", "left_anti")
