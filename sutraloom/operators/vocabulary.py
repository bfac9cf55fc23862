"""Word lists: terms from pages and dictionaries, their union with labels, a trigram index and spelling correction."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sutraloom.functions import text as T
from sutraloom.functions.unicode import without_accents
from sutraloom.operators import trigrams
from sutraloom.runtime import cut_lineage, with_position

_BLOCK_TAGS = "p|br|div|h[1-6]|ul|ol|li|table|tr|td|body|html"


def tag_texts(html: Column, tag: str) -> Column:
    """The inner texts of a tag, without tags inside."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: T.strip(F.regexp_replace(x, "<[^>]*>", "")))


def paragraph_texts(html: Column) -> Column:
    """Texts of paragraphs, which end at their own end tag or at the next block."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?(?:{_BLOCK_TAGS})\b|$)"), F.lit(1))
    return F.transform(inner, lambda x: T.squeeze(F.regexp_replace(x, "<[^>]*>", "")))


def glossary_term(term: Column) -> Column:
    """Without a last colon, hyphens as underscores."""
    return F.replace(F.regexp_replace(T.strip(term), ":$", ""), F.lit("-"), F.lit("_"))


def entry_term(term: Column) -> Column:
    """Hyphens and blanks as single underscores, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(T.strip(term), "[- ]", "_"), "_+", "_"))


def glossary_terms(pages: DataFrame, html: str, tag: str = "strong") -> DataFrame:
    """(term): distinct normalised texts of a tag."""
    return pages.select(F.explode(tag_texts(F.col(html), tag)).alias("t")).select(glossary_term(F.col("t")).alias("term")).where(F.col("term") != "").distinct()


def entry_parts(text: Column) -> Column:
    """[term, variant] of a paragraph `Term (variant) - description`; a hyphenated head is cut at its first hyphen."""
    head = T.strip(F.regexp_extract(text, r"^([A-Za-z \-()]+?)\s*[-–]\s*(?:.*)$", 1))
    main = T.strip(F.regexp_replace(head, r"\(.*?\)", ""))
    variant = F.when(F.regexp_like(head, F.lit(r"\(.*?\)")), T.strip(F.regexp_extract(head, r"\((.*?)\)", 1)))
    return F.when(head != "", F.array_compact(F.array(main, variant))).otherwise(F.array().cast("array<string>"))


def entry_terms(pages: DataFrame, html: str) -> DataFrame:
    texts = pages.select(F.explode(paragraph_texts(F.col(html))).alias("t"))
    return texts.select(F.explode(entry_parts(F.col("t"))).alias("p")).select(entry_term(F.col("p")).alias("term")).distinct()


def dictionary_terms(lines: DataFrame, line: str, tags: tuple[str, ...] = ("s", "k1")) -> DataFrame:
    """(iast, ascii) of the words in the tags of dictionary lines, from their one-letter code."""
    found = F.concat(*[F.regexp_extract_all(F.col(line), F.lit(f"<{t}>(.*?)</{t}>"), F.lit(1)) for t in tags])
    words = lines.select(F.explode(found).alias("w")).select(T.slp1_word(F.col("w")).alias("w")).where(F.col("w").isNotNull()).distinct()
    iast = words.select(T.slp1_to_iast(F.col("w")).alias("iast")).where(~F.regexp_like("iast", F.lit("[ḻṟ]")))
    return iast.withColumn("ascii", T.iast_to_plain(F.col("iast"))).distinct()


def table_terms(cells: DataFrame, cell: str, page: str | None = None, pages: tuple[int, int] = (499, 606)) -> DataFrame:
    """(iast, ascii) of the first cells of extracted tables; headings and empty cells are left out. page: the column of
    the page number, of which only `pages` count, the first and the last too."""
    cells = cells.where(F.col(page).between(*pages)) if page else cells
    rows = cells.where(F.col(cell).isNotNull() & (F.col(cell) != "") & ~F.contains(F.col(cell), F.lit("Sanskrit")))
    iast = T.underscored(T.strip(F.col(cell)))
    return rows.select(iast.alias("iast"), T.term_to_ascii(iast).alias("ascii"))


def union_of_terms(lists: list[DataFrame]) -> DataFrame:
    """(ascii, label): the distinct keys of several one-column term lists, label 1; null terms count as empty."""
    keyed = [d.select(T.term_key(F.coalesce(F.col(d.columns[0]), F.lit(""))).alias("ascii")) for d in lists]
    every = keyed[0]
    for k in keyed[1:]:
        every = every.unionByName(k)
    return every.distinct().where(F.col("ascii") != "").withColumn("label", F.lit(1))


def labelled_words(first: DataFrame, second: DataFrame) -> DataFrame:
    """(ascii, label) of two labelled lists, each word once; the first list's label stands."""
    every = first.select("ascii", "label", F.lit(0).alias("_o")).unionByName(second.select("ascii", "label", F.lit(1).alias("_o")))
    return every.groupBy("ascii").agg(F.min_by("label", F.struct("_o", "label")).alias("label"))


def sorted_words(words: DataFrame, word: str) -> DataFrame:
    """(position from 0, word): the distinct words in code-point order, sorted by range partitions."""
    distinct = words.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct()
    return with_position(cut_lineage(distinct.orderBy("word")), "position").select("position", "word")


def english_words(lines: DataFrame, line: str) -> DataFrame:
    rows = lines.where(T.strip(F.col(line)) != "")
    return rows.select(F.replace(F.lower(T.strip(F.col(line))), F.lit(" "), F.lit("_")).alias("ascii"), F.lit(0).alias("label"))


def known_words(words: DataFrame, word: str, label: str, wanted: int = 1) -> DataFrame:
    """(word): the distinct lower-case words of one label."""
    return words.where((F.col(label) == wanted) & F.col(word).isNotNull()).select(F.lower(F.col(word)).alias("word")).distinct()


def add_words(vocabulary: DataFrame, fresh: DataFrame) -> DataFrame:
    """(word, freq) of a vocabulary with further words; frequencies of words in both add up."""
    both = vocabulary.select("word", "freq").unionByName(fresh.select("word", "freq"))
    return both.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("freq").alias("freq"))


def preserved_terms(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, n_known): how many words of each text, without signs at their ends, a vocabulary knows. Words are counted by
    text first, so that a frequent word moves once per text."""
    bare = F.filter(F.transform(T.words(F.lower(F.col(text))), lambda w: F.btrim(w, F.lit(".,;:!?()"))), lambda w: w != "")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.explode(bare).alias("word"))
    counted = rows.groupBy("_key", "word").agg(F.count("*").alias("n"))
    per = counted.join(known.select("word").distinct(), "word").groupBy("_key").agg(F.sum("n").alias("n_known"))
    return texts.select(key).join(per, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("n_known", F.lit(0)).alias("n_known"))


def spelling_forms(words: DataFrame, word: str) -> DataFrame:
    """(word): each word as it is, in lower case, and both without accents."""
    forms = F.array(F.col(word), F.lower(word), F.col("_bare"), F.lower("_bare"))
    return words.where(F.col(word).isNotNull()).withColumn("_bare", without_accents(word)).select(F.explode(F.array_distinct(forms)).alias("word")).distinct()


# --- trigrams and spelling ----------------------------------------------------------------------------------------------------


def trigram_index(words: DataFrame, word: str) -> DataFrame:
    """(trigram, words): the distinct words that hold each trigram, as rows of postings."""
    return words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct().select(F.explode(T.trigrams(F.col("word"))).alias("trigram"), "word")


def vocabulary_counts(words: DataFrame, word: str) -> DataFrame:
    """(total_words, unique_lowercase, total_trigrams, mean_frequency) of the distinct words."""
    distinct = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("freq"))
    a = distinct.agg(F.count("*").alias("total_words"), F.count_distinct(F.lower("word")).alias("unique_lowercase"), F.round(F.avg("freq"), 6).alias("mean_frequency"))
    b = distinct.select(F.explode(T.trigrams(F.col("word"))).alias("t")).agg(F.count_distinct("t").alias("total_trigrams"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("total_words", "unique_lowercase", "total_trigrams", "mean_frequency")])


#: Pairs of words by common trigram up to which a join of them costs less than an index in the tasks.
PAIRS = 500_000


def trigram_candidates(asked: DataFrame, word: str, vocabulary: DataFrame, vocabulary_word: str, n: int = 10) -> DataFrame:
    """(word, candidate, common): the n vocabulary words that share the most distinct trigrams with each asked word,
    ties in code-point order.

    Words meet by trigram. Where that gives more than PAIRS pairs, they are counted over an index in the tasks instead of
    becoming rows; only the n best of each block of the vocabulary do."""
    index = trigram_index(vocabulary, vocabulary_word).withColumnRenamed("word", "candidate")
    postings = trigram_index(asked, word).withColumnRenamed("word", "asked")
    sizes = index.groupBy("trigram").agg(F.count("*").alias("size"))
    if (postings.join(sizes, "trigram").agg(F.sum("size")).first()[0] or 0) <= PAIRS:
        pairs = postings.join(index, "trigram").groupBy("asked", "candidate").agg(F.count("*").alias("common"))
    else:
        distinct = lambda df, c, name: df.select(F.col(c).alias(name)).where(F.col(name).isNotNull()).distinct()
        pairs = trigrams.best_candidates(distinct(asked, word, "asked"), distinct(vocabulary, vocabulary_word, "candidate"), n)
    return _first_of(pairs, n).select(F.col("asked").alias("word"), "candidate", "common")


def _first_of(pairs: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Win.partitionBy("asked").orderBy(F.desc("common"), "candidate"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


@F.pandas_udf(DoubleType())
def word_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 for equal words in any case, 0.95 without accents, else the matching share less a penalty for length."""
    import unicodedata

    bare = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")
    out = []
    for x, y in zip(a, b):
        x, y = x.lower(), y.lower()
        if x == y:
            out.append(1.0)
        elif bare(x) == bare(y):
            out.append(0.95)
        else:
            ratio = difflib.SequenceMatcher(None, x, y).ratio()
            out.append(ratio * (1 - 0.3 * abs(len(x) - len(y)) / max(len(x), len(y), 1)))
    return pd.Series(out)


def correct_words(asked: DataFrame, word: str, vocabulary: DataFrame, vocabulary_word: str, least: float = 0.75, n: int = 10) -> DataFrame:
    """(word, corrected, score) of each distinct asked word: itself if the vocabulary has it; its smallest vocabulary
    form in any case; else, from three characters on, the most similar of n trigram candidates, the more frequent of
    equals; null without one. Signs at the ends of a word do not count.

    Exact and case-blind words are settled by joins; only the rest meets the trigram index."""
    signs = F.lit(".,;:!?()[]{}\"'")
    words = asked.where(F.col(word).isNotNull()).select(F.btrim(F.col(word), signs).alias("word")).where(F.col("word") != "").distinct()
    known = vocabulary.where(F.col(vocabulary_word).isNotNull()).groupBy(F.col(vocabulary_word).alias("v")).agg(F.count("*").alias("freq"))
    lower = known.groupBy(F.lower("v").alias("low")).agg(F.min("v").alias("any_case"))
    settled = (
        words.join(known.select(F.col("v").alias("word"), F.lit(True).alias("exact")), "word", "left")
        .join(lower, F.lower("word") == F.col("low"), "left")
        .select("word", F.when(F.col("exact"), F.col("word")).otherwise(F.col("any_case")).alias("found"))
    )
    open_words = settled.where(F.col("found").isNull() & (F.length("word") >= 3)).select("word")
    candidates = trigram_candidates(open_words, "word", known, "v", n).join(known.select(F.col("v").alias("candidate"), "freq"), "candidate")
    scored = candidates.withColumn("score", F.round(word_similarity(F.col("word"), F.col("candidate")), 9)).where(F.col("score") >= least)
    best = scored.groupBy("word").agg(F.min_by(F.struct("candidate", "score"), F.struct(-F.col("score"), -F.col("freq"), "candidate")).alias("b"))
    return settled.join(best, "word", "left").select("word", F.coalesce("found", "b.candidate").alias("corrected"), F.when(F.col("found").isNotNull(), 1.0).otherwise(F.col("b.score")).alias("score"))


def correct_texts(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, vocabulary_word: str, separator: str = "", least: float = 0.75) -> DataFrame:
    """(key, text): tokens (words, and signs on their own) with each word corrected, joined by `separator`; words that
    have no correction stay. Words are corrected once each, then meet the texts again by word."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(rf"{T.W}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(tokens).alias("at", "word"))
    fixed = correct_words(rows, "word", vocabulary, vocabulary_word, least).select("word", "corrected")
    joined = rows.join(fixed, "word", "left").select(key, F.struct("at", F.coalesce("corrected", "word").alias("w")).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"])
    made = joined.groupBy(F.col(key).alias("_key")).agg(F.array_join(ordered, separator).alias("_made"))
    final = F.when(F.col(text).isNotNull(), F.coalesce("_made", F.lit("")))
    return texts.select(key, text).join(made, F.col(key) == F.col("_key"), "left").select(key, final.alias(text))
