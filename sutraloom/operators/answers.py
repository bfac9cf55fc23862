"""Answers from passages, and what they are worth. Callers may bring a model; the defaults need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutraloom.functions import text as T

#: Said where the passages give less than LEAST characters.
NOTHING = "The available passages do not answer this question."
LEAST = 40


def _word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(T.words(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\s]", " "))), lambda w: F.length(w) > 2))


def extract(question: Column, passages: Column, n: int = 3) -> Column:
    """The n sentences of the passages (an array) that share the most words with the question, in the order of their
    rank; earlier sentences first among equals."""
    sentences = F.flatten(F.transform(passages, lambda p: T.sentences(T.squeeze(F.coalesce(p, F.lit(""))))))

    def pick(own: Column) -> Column:
        scored = F.transform(sentences, lambda s, i: F.struct((-F.size(F.array_intersect(own, _word_set(s)))).alias("o"), i.alias("i"), s.alias("s")))
        return F.array_join(F.transform(F.slice(F.array_sort(scored), 1, n), lambda x: x["s"]), " ")

    return T.let(T.let(_word_set(question), pick), lambda made: F.when(F.length(made) < LEAST, NOTHING).otherwise(made))


def quoted(passages: Column, width: int = 100) -> Column:
    """The beginning of each passage (an array in rank order) after its citation, joined by blanks."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), F.left(F.coalesce(p, F.lit("")), F.lit(width)))), " ")


def citations(answer: Column) -> Column:
    return F.regexp_count(answer, F.lit(r"\[Source"))


def coverage(answer: Column, entities: Column) -> Column:
    """Share of the entities that an answer names in any case; a half without entities."""
    named = T.let(F.lower(answer), lambda low: F.size(F.filter(entities, lambda e: F.contains(low, F.lower(e)))))
    return F.when(F.size(entities) == 0, 0.5).otherwise(named / F.greatest(F.size(entities), F.lit(1)))


def prompt(question: Column, context: Column, history: Column, system: Column) -> Column:
    """Instruction, history (if any), context and question, blank lines between."""
    parts = F.array(system, F.when(history != "", history), F.concat(F.lit("CONTEXT:\n"), context), F.concat(F.lit("QUESTION: "), question))
    return F.array_join(F.array_compact(parts), "\n\n")


def instruction(intent: Column, by_intent: dict[str, str], default: str) -> Column:
    """The instruction of an intent, the default for intents without one."""
    table = F.create_map(*[F.lit(x) for pair in by_intent.items() for x in pair]) if by_intent else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, intent), F.lit(default))


def generate(rows: DataFrame, prompt_column: str, out: str, model: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """Rows with a model's answer to each prompt, in batches; answers under LEAST characters become NOTHING."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = ["" if t is None else t for t in part]
            made = [a for i in range(0, len(texts), batch) for a in model(texts[i : i + batch])]
            yield pd.Series([a if a and len(a.strip()) >= LEAST else NOTHING for a in made], index=part.index)

    return rows.withColumn(out, run(prompt_column))


def judged(rows: DataFrame, question: str, answer: str, passages: str) -> DataFrame:
    """Rows with groundedness (share of the answer's words that the passages have), relevance (share of the question's
    words that the answer has) and quality (their mean); zeros where there are no words."""
    share = lambda a, b: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))
    given = _word_set(F.array_join(F.transform(passages, lambda p: F.coalesce(p, F.lit(""))), " "))
    made = rows.withColumn("groundedness", F.round(share(_word_set(F.col(answer)), given), 6)).withColumn("relevance", F.round(share(_word_set(F.col(question)), _word_set(F.col(answer))), 6))
    return made.withColumn("quality", F.round((F.col("groundedness") + F.col("relevance")) / 2, 6))


def badge(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.5, "medium").otherwise("low")
