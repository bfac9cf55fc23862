"""What a question asks: intent, entities, further phrasings, whether it follows up on the conversation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sutraloom.functions import text as T
from sutraloom.operators.retrieval import words_named

# Words that tell an intent; of intents with equally many words the first.
INTENTS = {
    "treatment": ("treat", "cure", "remedy", "medicine", "therapy"),
    "prevention": ("prevent", "avoid", "stop", "reduce risk"),
    "diet": ("eat", "avoid", "diet", "food", "meal", "nutrition"),
    "lifestyle": ("lifestyle", "routine", "habits", "daily", "practice"),
    "symptoms": ("symptom", "sign", "feel", "experience"),
    "causes": ("cause", "why", "reason", "origin"),
    "diagnosis": ("diagnose", "identify", "assess"),
    "comparison": ("difference", "compare", "versus", "vs"),
    "definition": ("what is", "meaning", "define", "explain"),
    "recommendation": ("suggest", "recommend", "advise", "should"),
}
# Entities looked for in questions, in the order in which they are given.
TERMS = ("vata", "pitta", "kapha", "dosha", "agni", "ama", "ojas", "prana", "tejas", "dhatu", "srotas", "mala", "triphala", "ashwagandha", "ginger", "turmeric", "brahmi", "panchakarma", "abhyanga", "shirodhara")
# What makes a question a follow-up.
FOLLOW_UPS = ("also", "what about", "and", "more", "else", "another", "this", "that", "it", "them")
# Further phrasings by intent; {q} is the question, {e} its first entity (left out without one).
PHRASINGS = {
    "treatment": ("Ayurvedic treatment for {q}", "{e} remedies protocol"),
    "diet": ("Ayurvedic diet recommendations {q}", "Foods to eat and avoid {q}"),
    "lifestyle": ("Daily routine Dinacharya {q}", "{e} lifestyle modifications"),
    "symptoms": ("Signs and symptoms {q}", "{e} imbalance indicators"),
}
ENTITY_PHRASING = "{e} classical Ayurvedic texts"


def intent(question: Column) -> Column:
    """The intent of which a question contains the most words; `general` without any."""
    counts = F.array(*[words_named(question, words) for words in INTENTS.values()])
    names = F.array(*[F.lit(n) for n in INTENTS])
    # the first of equals: the position of the highest count
    pick = F.aggregate(F.sequence(F.lit(1), F.lit(len(INTENTS))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("i")), lambda a, i: F.when(F.element_at(counts, i) > a["n"], F.struct(F.element_at(counts, i).alias("n"), i.alias("i"))).otherwise(a))
    return F.when(question.isNotNull(), F.coalesce(F.get(names, pick["i"] - 1), F.lit("general")))


def entities(question: Column, terms: tuple[str, ...] = TERMS) -> Column:
    low = F.lower(question)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def _phrase(template: str, question: Column, entity: Column) -> Column:
    """A template with its places filled; null where it needs an entity that is missing."""
    left, mark, right = template.partition("{q}" if "{q}" in template else "{e}")
    return F.concat(F.lit(left), question if mark == "{q}" else entity, F.lit(right))


def phrasings(question: Column, intent_name: Column, found: Column, most: int = 4) -> Column:
    """The question and its further phrasings, each once, at most `most`."""
    first = F.try_element_at(found, F.lit(1))
    extra = F.array().cast("array<string>")
    for name, templates in PHRASINGS.items():
        extra = F.when(intent_name == name, F.array(*[_phrase(t, question, first) for t in templates])).otherwise(extra)
    about = F.transform(F.slice(found, 1, 2), lambda e: _phrase(ENTITY_PHRASING, question, e))
    every = F.array_compact(F.concat(F.array(question), extra, about))
    return F.slice(F.array_distinct(every), 1, most)


def is_follow_up(question: Column, has_history: Column) -> Column:
    """Fewer than five words or a word that refers back, in a conversation that has a past."""
    refers = words_named(question, FOLLOW_UPS) > 0
    return (refers | (F.size(T.words(question)) < 5)) & has_history
