"""Operators on pages and their lines: repeated lines, line filters, rebuilt pages, entities, lexicon spelling."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutraloom.functions import text as T
from sutraloom.functions.unicode import nfkc, with_nfkc
from sutraloom.runtime import attach, collect_bounded

#: Entries that a lexicon may have, and terms that may stand in a plan; more are looked for by one automaton in a task.
LEXICON_ROWS, LITERALS = 20_000, 200


def explode_lines(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep..., line_no from 1, line) of each line of each text that is not null."""
    parts = F.posexplode(F.split(F.col(text), "\n")).alias("_at", "line")
    return df.where(F.col(text).isNotNull()).select(key, *keep, parts).select(key, *keep, (F.col("_at") + 1).cast("bigint").alias("line_no"), "line")


def line_key(line: Column) -> Column:
    return F.lower(T.strip(line))


def repeated_lines(df: DataFrame, source: str, text: str, min_repeat: float = 0.3) -> DataFrame:
    """(source, line_norm, n_pages, total): lines on at least `min_repeat` of a source's pages, counted once a page.

    A page's lines are made distinct inside its row, so the count is one partial aggregation and a large source moves
    one counter per line and task. Pages without text count among the source's pages."""
    rows = df.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(text).alias("text"))
    per_page = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), line_key), lambda x: x != ""))
    counts = rows.select("source", F.explode(per_page).alias("line_norm")).groupBy("source", "line_norm").agg(F.count("*").alias("n_pages"))
    totals = rows.groupBy("source").agg(F.count("*").alias("total"))
    return counts.join(totals, "source").where(F.col("n_pages") >= F.col("total") * F.lit(min_repeat))


def lexicon_terms(lexicon: DataFrame, canonical: str = "canonical", order: str = "ord") -> list[str]:
    rows = collect_bounded(lexicon.select(order, canonical).where(F.col(canonical).isNotNull()), LEXICON_ROWS, "lexicon")
    return [r[1] for r in sorted(rows)]


def mentions(text: Column, terms: list[str]) -> Column:
    """The terms that a text contains in any case, sorted. The list is folded into the plan, or into one automaton
    beyond LITERALS terms: no join, no shuffle."""
    if len(terms) > LITERALS:
        return _finder(tuple(sorted(set(terms))), False)(text)
    named = F.array(*[F.lit(t) for t in sorted(set(terms))])
    found = T.let(F.lower(text), lambda low: F.when(low.isNotNull(), F.filter(named, lambda t: F.contains(low, F.lower(t)))))
    return found if terms else F.array().cast("array<string>")


def _finder(terms: tuple[str, ...], per_line: bool):
    """An Arrow function text -> its terms, sorted, or (per_line) lines -> whether each names a term."""

    def machine():
        import ahocorasick

        made, names = ahocorasick.Automaton(), {}
        for t in terms:
            names.setdefault(t.lower(), []).append(t)
        for low, of in names.items():
            if low:
                made.add_word(low, of)
        made.make_automaton()
        return made, names.get("", [])

    @F.pandas_udf("array<boolean>" if per_line else "array<string>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made, always = machine()
        named = lambda x: bool(always) or next(made.iter(x.lower()), None) is not None
        found = lambda t: sorted({n for _, of in made.iter(t.lower()) for n in of}.union(always))
        for part in parts:
            yield pd.Series([None if t is None else [named(x) for x in t] if per_line else found(t) for t in part], dtype=object)

    return find


def mentions_any(text: Column, terms: list[str]) -> Column:
    named = F.array(*[F.lit(t.lower()) for t in terms])
    return T.let(F.lower(text), lambda low: F.exists(named, lambda t: F.contains(low, t))) if terms else F.lit(False)


def drop_repeated(df: DataFrame, key: str, source: str, text: str, terms: list[str], min_repeat: float = 0.3, keep_blank: bool = False) -> DataFrame:
    """(key, source, text, lines): each page's lines without its source's repeated ones, unless a line names a term.
    keep_blank: blank lines stay. Pages without a source lose nothing but blank lines. A source has at most (mean lines
    of its pages) / min_repeat repeated lines."""
    repeated = repeated_lines(df, source, text, min_repeat)
    lists = repeated.groupBy(F.col("source").alias("_source")).agg(F.collect_set("line_norm").alias("_repeated"))
    pages = attach(df.select(key, source, text), source, lists, "_source", key)
    many = len(terms) > LITERALS
    if many:
        pages = pages.withColumn("_named", _finder(tuple(terms), True)(F.split(F.col(text), "\n")))

    def stays(line: Column, i: Column) -> Column:
        def judge(key: Column) -> Column:
            again = F.coalesce(F.array_contains(F.col("_repeated"), key), F.lit(False))
            kept = ~again | (F.get("_named", i) if many else mentions_any(line, terms))
            return kept if keep_blank else kept & (key != "")

        return T.let(line_key(line), judge)

    return pages.select(key, source, text, F.filter(F.split(F.col(text), "\n"), stays).alias("lines"))


def joined_pages(df: DataFrame, key: str, source: str, text: str, terms: list[str], min_repeat: float = 0.3) -> DataFrame:
    """(key, source, text): lines without repeated ones joined by blanks; empty pages are left out."""
    lines = drop_repeated(df, key, source, text, terms, min_repeat)
    return lines.select(key, source, T.strip(F.array_join("lines", " ")).alias(text)).where(F.col(text) != "")


def script_filtered(lines: Column) -> Column:
    """Lines without Devanagari, those that are then gibberish left out. The weaker filters for foreign lines and
    noise hold for every line that stays, so they need no pass of their own."""
    return F.filter(F.transform(lines, T.drop_devanagari), lambda x: ~T.is_gibberish(x))


def page_sentences(normalised: Column) -> Column:
    """The sentences of a page's text, which is in NFKC, with its letters and words made whole."""
    c = T.dehyphenate(T.join_spaced_letters(T.drop_intrusive(T.ligatures(normalised))))
    return T.sentences(T.squeeze(c))


def page_paragraphs(sentences: Column) -> Column:
    """Clean paragraphs of three sentences each."""
    made = F.transform(sentences, lambda s: T.capitalise(T.drop_repeated_words(s)))
    return F.when(F.array_join(sentences, "") == "", "").otherwise(T.paragraphs(made))


def clean_page(normalised: Column) -> Column:
    """A page's text, which is in NFKC, in clean paragraphs of three sentences, without a lexicon."""
    return page_paragraphs(page_sentences(normalised))


def clean_pages(df: DataFrame, key: str, source: str, text: str, terms: list[str], min_repeat: float = 0.3, lexicon: DataFrame | None = None) -> DataFrame:
    """(key, source, text, entities): the whole cleaning of a corpus of pages in one plan: repeated lines, script filter,
    sentences, the lexicon's spelling of their words (if there is a lexicon), paragraphs, the raw text where nothing is
    left, and the terms named. A word that is only like a lexicon name gets it only where the raw page has that name."""
    pages = drop_repeated(df, key, source, text, terms, min_repeat)
    merged = pages.select(key, source, text, F.array_join(script_filtered(F.col("lines")), " ").alias("_merged"))
    cut = with_nfkc(merged, "_merged").withColumn("_merged", page_sentences(F.col("_merged")))
    if lexicon is not None:
        cut = cut.withColumn("_merged", speller(lexicon)("_merged", text))
    clean = cut.withColumn("_clean", F.coalesce(page_paragraphs(F.col("_merged")), F.lit("")))
    final = F.when(F.col(text).isNotNull(), T.or_raw(F.col("_clean"), F.col(text)))
    return clean.select(key, source, final.alias(text)).withColumn("entities", mentions(F.col(text), terms))


def integrated_clean(text: Column, repeated: Column | None = None, terms: list[str] | None = None) -> Column:
    """The other cleaning order: spaced letters, ligatures, Devanagari, NFKC, page marks, broken words, blanks; texts
    of fewer than ten characters become empty (see skip_reason).

    terms: words to preserve; that step parts the text into words and joins them by blanks, so that the text is one line
    from then on. repeated: lines of the text's source in lower case; a line that is one goes, unless it names a term."""
    c = T.replace_all(T.join_spaced_pairs(text), T.LIGATURES[:4])
    c = T.rejoin_broken(T.drop_page_marks(nfkc(T.drop_devanagari(c))))
    if terms is not None:
        c = T.squeeze(c)
    if repeated is not None:
        stays = lambda x: T.let(line_key(x), lambda k: ~F.coalesce(F.array_contains(repeated, k), F.lit(False)) | mentions_any(k, terms or []))
        c = F.array_join(F.filter(F.split(c, "\n"), stays), "\n")
    return F.when(F.length(T.strip(text)) < 10, "").otherwise(T.squeeze(c))


def skip_reason(text: Column) -> Column:
    """Why the integrated cleaning leaves a text empty; null where it does not."""
    return F.when(F.coalesce(F.length(T.strip(text)), F.lit(0)) < 10, "too_short")


# --- lexicon spelling -----------------------------------------------------------------------------------------------------------


def lexicon_keys(lexicon: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """(canonical by lower-case name, canonical by exact variant); of several entries the first in order."""
    rows = collect_bounded(lexicon.select("ord", "canonical", "variants"), LEXICON_ROWS, "lexicon")
    names: dict[str, tuple[int, str]] = {}
    variants: dict[str, tuple[int, str]] = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["canonical"] is not None:
            names.setdefault(r["canonical"].lower(), (r["ord"], r["canonical"]))
            for v in r["variants"] or ():
                variants.setdefault(v, (r["ord"], r["canonical"]))
    merged = {v: c for v, (o, c) in variants.items() if v.lower() not in names or names[v.lower()][0] >= o}
    return {k: c for k, (_, c) in names.items()}, merged


def canonical_word(word: Column, names: dict[str, str], variants: dict[str, str]) -> Column:
    """The canonical form of a word's Latin letters, the word itself where the lexicon has none."""

    def table(d: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.lit(None).cast("map<string,string>")

    def look_up(bare: Column) -> Column:
        found = F.coalesce(F.try_element_at(table(variants), bare), F.try_element_at(table(names), F.lower(bare)))
        return F.when(bare == "", word).otherwise(F.coalesce(found, word))

    return T.let(F.regexp_replace(word, "[^a-zA-Z]", ""), look_up)


def normalise_spelling(text: Column, names: dict[str, str], variants: dict[str, str]) -> Column:
    return F.array_join(F.transform(T.words(text), lambda w: canonical_word(w, names, variants)), " ")


def indel_similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in percent."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def speller(lexicon: DataFrame, least: float = 90.0):
    """An Arrow function (sentences, raw text) -> sentences in which each word has the lexicon's spelling: that of its
    letters, else the most similar name of at least `least` that the raw text has. The lexicon is bounded and goes with
    the function; a task scores a distinct word once, whatever number of texts it stands in."""
    names, variants = lexicon_keys(lexicon)
    similar = _nearest(names, least)

    @F.pandas_udf("array<string>")
    def spell(sentences: pd.Series, raw: pd.Series) -> pd.Series:
        known: dict[str, tuple[str | None, str | None]] = {}

        def of(word: str, low: str) -> str:
            found = known.get(word)
            if found is None:
                bare = re.sub("[^a-zA-Z]", "", word)
                exact = (variants.get(bare) or names.get(bare.lower())) if bare else word
                found = known[word] = (exact, None if exact else similar(bare)[0])
            exact, like = found
            return exact or (like if like and like.lower() in low else word)

        out = []
        for s, t in zip(sentences, raw):
            low = (t or "").lower()
            out.append(None if s is None else [" ".join([of(w, low) for w in x.split()]) for x in s])
        return pd.Series(out)

    return spell


def _nearest(names: dict[str, str], least: float) -> Callable[[str], tuple[str | None, float | None]]:
    """The most similar of the names to a word and its score, the first of equals; nothing below `least`."""
    bags = [(t, Counter(t)) for t in dict.fromkeys(names.values())]

    def best(w: str) -> tuple[str | None, float | None]:
        top, bag = (-1.0, None), Counter(w)
        for t, other in bags:
            # letters in common bound the common subsequence, whatever their order
            shared = 0 if 2 * min(len(w), len(t)) * 100 < least * (len(w) + len(t)) else sum((bag & other).values())
            if 200 * shared >= least * (len(w) + len(t)) and (v := indel_similarity(w, t)) > top[0]:
                top = (v, t)
        return (top[1], top[0]) if top[0] >= least else (None, None)

    return best


def fuzzy_lexicon(df: DataFrame, key: str, text: str, lexicon: DataFrame, least: float = 90.0) -> DataFrame:
    """(word, canonical, score): distinct words of the texts that are no entry but as similar to one as `least`.

    Words are made distinct before any is scored; the lexicon is bounded, so each word is scored in place."""
    names, variants = lexicon_keys(lexicon)
    similar = _nearest(names, least)

    @F.pandas_udf("struct<canonical string, score double>")
    def best(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([similar(w) for w in s], columns=["canonical", "score"])

    bare = F.regexp_replace("w", "[^a-zA-Z]", "")
    words = df.where(F.col(text).isNotNull()).select(F.explode(T.words(F.col(text))).alias("w")).select(bare.alias("word")).where(F.col("word") != "").distinct()
    known = [*variants, *names]
    fresh = words.where(~F.col("word").isin(known) & ~F.lower("word").isin(list(names))) if known else words
    return fresh.select("word", best("word").alias("b")).where(F.col("b.canonical").isNotNull()).select("word", "b.canonical", F.round("b.score", 6).alias("score"))
