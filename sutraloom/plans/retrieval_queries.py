"""Queries on vectors and passages. Asked vectors: every row whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.operators import answers, dialogue, questions, retrieval
from sutraloom.plans.registry import query
from sutraloom.runtime import table
from sutraloom.sources import embedders

#: Ids of asked vectors are multiples of ASKED; GROUPED / ASKED of them are phrasings of one question.
ASKED, GROUPED = 20, 80

_SCORES = """SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"""
_TOP = f"SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_SCORES})) WHERE r <= 5"
_MERGED = f"""SELECT question, vec_id, score FROM (SELECT question, vec_id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS r
  FROM (SELECT query_id // 80 AS question, vec_id, max(score) AS score FROM ({_TOP}) GROUP BY ALL)) WHERE r <= 10"""
_INTENTS = ("treatment", "diet", "lifestyle", "symptoms", "causes")


def _contains(c: str, words: tuple[str, ...]) -> str:
    return " + ".join(f"coalesce(contains(lower({c}), '{w}')::INT, 0)" for w in words)


_INTENT_SQL = "CASE intent " + " ".join(f"WHEN '{n}' THEN least(1e0, ({_contains('text', w)}) / {len(w)}e0)" for n, w in retrieval.INTENT_WORDS.items()) + " ELSE 0e0 END"
_HITS = f"""SELECT m.question, m.vec_id, m.score, d.text, d.source, d.page, ['treatment', 'diet', 'lifestyle', 'symptoms', 'causes'][1 + m.question % 5] AS intent
  FROM ({_MERGED}) m JOIN documents d ON d.doc_id = m.vec_id"""
_RERANK = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(final_score, 9) DESC, score DESC, vec_id) AS rank FROM (
  SELECT *, semantic_score * 0.5e0 + intent_score * 0.25e0 + diversity_score * 0.15e0 + quality_score * 0.1e0 AS final_score FROM (
  SELECT question, vec_id, score, text, source, page, CASE WHEN max(score) OVER (PARTITION BY question) > 0 THEN score / max(score) OVER (PARTITION BY question) ELSE 0e0 END AS semantic_score,
    coalesce({_INTENT_SQL}, 0e0) AS intent_score, 1e0 / count(*) OVER (PARTITION BY question, source) AS diversity_score,
    coalesce(CASE WHEN length(text) BETWEEN 200 AND 1000 THEN 1e0 WHEN length(text) < 200 THEN length(text) / 200e0 WHEN text IS NULL THEN NULL ELSE 0.8e0 END, CASE WHEN text IS NULL THEN 0e0 END) AS quality_score
  FROM ({_HITS})))) WHERE rank <= 5"""


def _top(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return retrieval.top_k(vectors, "vec_id", "embedding", asked, "query_id", "v", 5)


def _merged(spark, d) -> DataFrame:
    hits = _top(spark, d).withColumn("question", F.floor(F.col("query_id") / GROUPED))
    return retrieval.best_per_document(hits, "question", "vec_id", 10)


def _hits(spark, d) -> DataFrame:
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "page")
    intent = F.element_at(F.array(*[F.lit(i) for i in _INTENTS]), (F.col("question") % 5 + 1).cast("int"))
    return _merged(spark, d).join(passages, "vec_id").withColumn("intent", intent)


def _reranked(spark, d) -> DataFrame:
    return retrieval.rerank(_hits(spark, d), "question", "vec_id", "text", "source", F.col("intent"))


@query("cosine_topk", _TOP)
def cosine_topk(spark, d):
    return _top(spark, d)


@query("multi_query_retrieve", _MERGED)
def multi_query_retrieve(spark, d):
    return _merged(spark, d)


@query("rerank", f"SELECT question, rank, vec_id, round(score, 6) AS score, round(semantic_score, 6) AS semantic_score, round(intent_score, 6) AS intent_score, round(diversity_score, 6) AS diversity_score, round(quality_score, 6) AS quality_score, round(final_score, 5) AS final_score FROM ({_RERANK})")
def rerank(spark, d):
    scores = ("score", "semantic_score", "intent_score", "diversity_score", "quality_score")
    shown = [F.round(s, 6).alias(s) for s in scores] + [F.round("final_score", 5).alias("final_score")]
    return _reranked(spark, d).select("question", F.col("rank").cast("bigint").alias("rank"), "vec_id", *shown)


_QUOTED = f"""SELECT question, avg(final_score) AS score, count(*) AS n, string_agg('[Source ' || rank || '] ' || left(coalesce(text, ''), 100), ' ' ORDER BY rank) AS answer,
  left(coalesce(arg_min(coalesce(text, ''), rank), ''), 300) AS asked FROM ({_RERANK}) GROUP BY question"""
_TERM_LIST = "[" + ", ".join(f"'{t}'" for t in questions.TERMS) + "]"


def _quoted(spark, d) -> DataFrame:
    """An answer to each question that quotes its passages; the question is the beginning of the best one."""
    grouped = _reranked(spark, d).groupBy("question").agg(_in_rank_order("text").alias("passages"), F.avg("final_score").alias("score"), F.count("*").alias("n"))
    return grouped.withColumn("answer", answers.quoted(F.col("passages"))).withColumn("asked", F.left(F.get("passages", F.lit(0)), F.lit(300)))


def _in_rank_order(text: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(text, F.lit("")).alias("text")))), lambda x: x["text"])


@query("confidence", f"""WITH a AS (SELECT *, list_filter({_TERM_LIST}, lambda t: contains(lower(asked), t)) AS found FROM ({_QUOTED}))
SELECT question, round(least(1e0, score * 0.4e0 + least(n / 5e0, 1e0) * 0.2e0 + least(length(answer) / 400e0, 1e0) * 0.15e0 + least(len(regexp_extract_all(answer, '\\[Source')) / 3e0, 1e0) * 0.15e0
  + CASE WHEN len(found) = 0 THEN 0.5e0 ELSE len(list_filter(found, lambda t: contains(lower(answer), t))) / len(found) END * 0.1e0), 6) AS confidence FROM a""")
def confidence(spark, d):
    made = _quoted(spark, d).withColumn("found", questions.entities(F.col("asked")))
    covered = answers.coverage(F.col("answer"), F.col("found"))
    value = retrieval.answer_confidence(F.col("score"), F.col("n"), F.col("answer"), answers.citations(F.col("answer")), covered)
    return made.select("question", value.alias("confidence"))


@query("badges", f"SELECT question, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS badge FROM (SELECT question, round(avg(final_score), 6) AS score FROM ({_RERANK}) GROUP BY question)")
def badges(spark, d):
    scores = _reranked(spark, d).groupBy("question").agg(F.round(F.avg("final_score"), 6).alias("score"))
    return scores.select("question", answers.badge(F.col("score")).alias("badge"))


@query("context_render", f"""SELECT question, string_agg('[Source ' || rank || ': ' || coalesce(source, 'unknown') || ', Page ' || coalesce(page, -1) || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
  FROM ({_RERANK}) GROUP BY question""")
def context_render(spark, d):
    return retrieval.rendered_context(_reranked(spark, d), "question", "text", "source", "page")


_USER = "(SELECT session_id, seq, content FROM chat_messages WHERE role = 'user' AND content IS NOT NULL)"
_COUNTS = {n: "(" + _contains("content", w) + ")" for n, w in questions.INTENTS.items()}
_BEST = "greatest(" + ", ".join(_COUNTS.values()) + ")"
_INTENT = f"CASE WHEN {_BEST} = 0 THEN 'general' " + " ".join(f"WHEN {c} = {_BEST} THEN '{n}'" for n, c in _COUNTS.items()) + " END"
_TERMS = "[" + ", ".join(f"'{t}'" for t in questions.TERMS) + "]"
_FOUND = f"list_filter({_TERMS}, lambda t: contains(lower(content), t))"


def _phrase(t: str) -> str:
    place, value = ("{q}", "content") if "{q}" in t else ("{e}", "found[1]")
    a, _, b = t.partition(place)
    return f"('{a}' || {value} || '{b}')"


_EXTRA = "CASE intent " + " ".join(f"WHEN '{n}' THEN [{', '.join(map(_phrase, ts))}]" for n, ts in questions.PHRASINGS.items()) + " ELSE [] END"


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "chat_messages").where((F.col("role") == "user") & F.col("content").isNotNull()).select("session_id", "seq", "content")


@query("question_intents", f"SELECT session_id, seq, {_INTENT} AS intent FROM {_USER}")
def question_intents(spark, d):
    return _asked(spark, d).select("session_id", "seq", questions.intent(F.col("content")).alias("intent"))


@query("question_entities", f"SELECT session_id, seq, array_to_string({_FOUND}, '|') AS entities FROM {_USER}")
def question_entities(spark, d):
    return _asked(spark, d).select("session_id", "seq", F.array_join(questions.entities(F.col("content")), "|").alias("entities"))


@query("question_phrasings", f"""WITH a AS (SELECT session_id, seq, content, {_INTENT} AS intent, {_FOUND} AS found FROM {_USER}),
b AS (SELECT session_id, seq, list_filter(list_concat([content], {_EXTRA}, list_transform(found[1:2], lambda e: e || ' classical Ayurvedic texts')), lambda x: x IS NOT NULL) AS every FROM a)
SELECT session_id, seq, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i)[1:4], '|') AS phrasings FROM b""")
def question_phrasings(spark, d):
    rows = _asked(spark, d).withColumn("intent", questions.intent(F.col("content"))).withColumn("found", questions.entities(F.col("content")))
    return rows.select("session_id", "seq", F.array_join(questions.phrasings(F.col("content"), F.col("intent"), F.col("found")), "|").alias("phrasings"))


_FOLLOW = " OR ".join(f"contains(lower(content), '{w}')" for w in questions.FOLLOW_UPS)


@query("question_follow_ups", rf"""SELECT session_id, seq, (({_FOLLOW}) OR len(list_filter(regexp_split_to_array(content, '[\s\x{{85}}\p{{Z}}]+'), lambda w: w <> '')) < 5) AND seq > 1 AS follow_up FROM {_USER}""")
def question_follow_ups(spark, d):
    return _asked(spark, d).select("session_id", "seq", questions.is_follow_up(F.col("content"), F.col("seq") > 1).alias("follow_up"))


@query("embedded_documents")
def embedded_documents(spark, d):
    return embedders.embed(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query("index_stats", "SELECT count(*) AS vectors, count(DISTINCT label) AS labels, min(len(embedding)) AS least_dimensions, max(len(embedding)) AS most_dimensions FROM embeddings")
def index_stats(spark, d):
    size = F.size("embedding").cast("bigint")
    return table(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("labels"), F.min(size).alias("least_dimensions"), F.max(size).alias("most_dimensions"))


@query("extractive_answers")
def extractive_answers(spark, d):
    """For every question of the reranked passages: the answer from their sentences, and what it is worth. The question
    is the first sentence of its best passage."""
    grouped = _reranked(spark, d).groupBy("question").agg(_in_rank_order("text").alias("passages"), F.avg("final_score").alias("score"))
    asked = grouped.withColumn("asked", F.substring_index(F.get("passages", F.lit(0)), ".", 1))
    made = asked.withColumn("answer", answers.extract(F.col("asked"), F.col("passages")))
    return answers.judged(made, "asked", "answer", "passages").select("question", "answer", "groundedness", "relevance", "quality", answers.badge(F.col("score")).alias("badge"))


@query("chat_turns")
def chat_turns(spark, d):
    """Every question of a user, answered as a turn of its conversation: intent, entities and phrasings, search with
    each phrasing over all documents, reranking, the answer from the passages' sentences with its sources, confidence
    and badge, and what the conversation remembered before.

    Equal phrasings are searched once; the passages come to the hits by their key."""
    messages = dialogue.delivered_once(table(spark, d, "chat_messages"))
    documents = table(spark, d, "documents").where(F.col("text").isNotNull())
    asked = messages.where((F.col("role") == "user") & F.col("content").isNotNull()).select("session_id", "seq", F.col("content").alias("asked"))
    asked = asked.withColumn("intent", questions.intent(F.col("asked"))).withColumn("found", questions.entities(F.col("asked")))
    content = asked.select("asked", "intent", "found").distinct()
    phrased = content.select("asked", F.explode(questions.phrasings(F.col("asked"), F.col("intent"), F.col("found"))).alias("phrasing"))
    queries = embedders.embed(phrased.select("phrasing").distinct(), "phrasing", "v")
    vectors = embedders.embed(documents.select("doc_id", "text"), "text").select("doc_id", "embedding")
    hits = retrieval.top_k(vectors, "doc_id", "embedding", queries, "phrasing", "v", 5).join(phrased, "phrasing")
    best = retrieval.best_per_document(hits, "asked", "doc_id", 10).join(documents.select("doc_id", "text", "source", "page"), "doc_id").join(content.select("asked", "intent"), "asked")
    top = retrieval.rerank(best, "asked", "doc_id", "text", "source", F.col("intent"))
    grouped = top.groupBy("asked").agg(_in_rank_order("text").alias("passages"), F.avg("final_score").alias("score"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "source", "page"))).alias("sources"))
    cited = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("[Source "), s["rank"].cast("string"), F.lit("]"))), " ")
    made = grouped.withColumn("answer", F.concat_ws(" ", answers.extract(F.col("asked"), F.col("passages")), cited))
    turns = asked.join(made, "asked", "left").join(dialogue.relevant_history(messages), ["session_id", "seq"], "left")
    answer = F.coalesce("answer", F.lit(answers.NOTHING))
    covered = answers.coverage(answer, F.col("found"))
    sure = retrieval.answer_confidence(F.coalesce("score", F.lit(0.0)), F.coalesce("n", F.lit(0)), answer, answers.citations(answer), covered)
    shown = turns.withColumn("answer", answer).withColumn("confidence", sure).withColumn("follow_up", questions.is_follow_up(F.col("asked"), F.col("seq") > 1))
    return shown.select("session_id", "seq", "intent", F.array_join("found", "|").alias("entities"), "follow_up", "relevant", "answer", F.coalesce("n", F.lit(0)).alias("n_sources"), "confidence", answers.badge(F.col("confidence")).alias("badge"))
