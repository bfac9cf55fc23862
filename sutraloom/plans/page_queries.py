"""Queries on pages, lines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutraloom.functions import text as T
from sutraloom.functions.unicode import nfkc, without_accents
from sutraloom.operators import chunks, pages
from sutraloom.plans.registry import query
from sutraloom.runtime import attach, table
from sutraloom.sources import readers

PAGES = "ayurveda_docs_final"
#: Share of a source's pages on which the queries take a line as repeated (the operators' own default is 0.3).
REPEAT = 0.05

# Blanks as the library understands them, for SQL engines whose \s is ASCII.
SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LINES = """(SELECT rec_id, source, unnest(string_split(content, chr(10))) AS line,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM ayurveda_docs_final WHERE content IS NOT NULL)"""


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def _squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


_REPEATED = f"""SELECT l.source, l.line_norm, l.n_pages, t.total FROM (
  SELECT source, line_norm, count(DISTINCT rec_id) AS n_pages FROM (SELECT rec_id, source, lower({_strip('line')}) AS line_norm FROM {LINES})
  WHERE line_norm <> '' AND source IS NOT NULL GROUP BY source, line_norm) l
JOIN (SELECT source, count(*) AS total FROM ayurveda_docs_final WHERE source IS NOT NULL GROUP BY source) t ON t.source = l.source
WHERE l.n_pages >= t.total * {REPEAT}"""
_TERMS = "(SELECT list(lower(canonical)) FROM lexicon WHERE canonical IS NOT NULL)"
_KEPT = f"""(SELECT p.* FROM {LINES} p LEFT JOIN ({_REPEATED}) r ON r.source = p.source AND r.line_norm = lower({_strip('p.line')})
  WHERE {_strip('p.line')} <> '' AND (r.source IS NULL OR len(list_filter({_TERMS}, lambda t: contains(lower(p.line), t))) > 0))"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PAGES)


def _terms(spark: SparkSession, d: str) -> list[str]:
    return pages.lexicon_terms(table(spark, d, "lexicon"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.explode_lines(_pages(spark, d), "rec_id", "content", "source")


@query("scanned_sources", f"SELECT source, NOT coalesce(bool_or({_strip('content')} <> ''), false) AS is_scanned FROM ayurveda_docs_final WHERE source IS NOT NULL GROUP BY source")
def scanned_sources(spark, d):
    return readers.scanned_sources(_pages(spark, d))


@query("repeated_lines", _REPEATED)
def repeated_lines(spark, d):
    return pages.repeated_lines(_pages(spark, d), "source", "content", REPEAT)


@query("strip_headers", f"SELECT rec_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM {_KEPT} GROUP BY rec_id")
def strip_headers(spark, d):
    made = pages.drop_repeated(_pages(spark, d), "rec_id", "source", "content", _terms(spark, d), REPEAT)
    return made.where(F.size("lines") > 0).select("rec_id", F.array_join("lines", "\n").alias("content"))


@query("extract_pages", f"SELECT * FROM (SELECT rec_id, source, {_strip('''string_agg(line, ' ' ORDER BY line_no)''')} AS content FROM {_KEPT} GROUP BY rec_id, source) WHERE content <> ''")
def extract_pages(spark, d):
    return pages.joined_pages(_pages(spark, d), "rec_id", "source", "content", _terms(spark, d), REPEAT)


#: Pages with their number as a mark before and after the first line end.
_NUMBERED = "(SELECT rec_id, CASE WHEN content IS NOT NULL THEN coalesce(page, 0) || ' | Page' || chr(10) || content || ' ' || coalesce(page, 0) || '  |  Page.' || chr(10) || '[Page 7] | 12' END AS content FROM ayurveda_docs_final)"


def _numbered(text, page):
    n = F.coalesce(page, F.lit(0)).cast("string")
    return F.concat(n, F.lit(" | Page\n"), text, F.lit(" "), n, F.lit("  |  Page.\n[Page 7] | 12"))


_SIGNS = r"""[^a-zA-Z0-9\s.,;:''\"!?()-]"""


def _shares(c: str) -> tuple[str, str]:
    return (f"len(regexp_extract_all({c}, '{_SIGNS}')) / greatest(1, length({c}))", f"len(regexp_extract_all({c}, '[a-zA-Z]')) / greatest(1, length({c}))")


_BARE = r"regexp_replace(line, '[\x{0900}-\x{097F}]+', ' ', 'g')"


@query("script_lines", f"SELECT rec_id, line_no, bare AS line FROM (SELECT rec_id, line_no, {_BARE} AS bare FROM {LINES}) WHERE NOT ({_shares('bare')[0]} > 0.25 OR {_shares('bare')[1]} < 0.4)")
def script_lines(spark, d):
    bare = _lines(spark, d).select("rec_id", "line_no", T.drop_devanagari(F.col("line")).alias("line"))
    return bare.where(~T.is_gibberish(F.col("line")))


@query("foreign_lines", f"SELECT rec_id, line_no FROM {LINES} WHERE {_shares('line')[0]} > 0.3 OR {_shares('line')[1]} < 0.4")
def foreign_lines(spark, d):
    return _lines(spark, d).where(T.is_foreign(F.col("line"))).select("rec_id", "line_no")


@query("noise_lines", f"SELECT rec_id, line_no FROM {LINES} WHERE len(regexp_extract_all(line, '[a-zA-Z]+')) < 3 AND (len(regexp_extract_all(line, '[a-zA-Z0-9]')) = 0 OR len(regexp_extract_all(line, '[a-zA-Z0-9]')) / greatest(1, length(line)) < 0.25)")
def noise_lines(spark, d):
    return _lines(spark, d).where(T.is_noise(F.col("line"))).select("rec_id", "line_no")


_READABLE = rf"""coalesce(array_to_string(list_filter(string_split({_squeeze('content')}, ' '),
  lambda t: regexp_full_match(t, '[A-Za-z0-9.,;:()''\"-]+') AND length(t) <= 25 AND len(regexp_extract_all(t, '[A-Za-z0-9]')) >= length(t) * 0.8), ' '), '')"""


@query("readable_tokens", f"SELECT rec_id, {_READABLE} AS content FROM ayurveda_docs_final WHERE content IS NOT NULL")
def readable_tokens(spark, d):
    return _pages(spark, d).where(F.col("content").isNotNull()).select("rec_id", T.readable_tokens(F.col("content")).alias("content"))


def _meaningful(c: str) -> str:
    w = f"string_split({_squeeze(c)}, ' ')"
    n = f"(CASE WHEN {_squeeze(c)} = '' THEN 0 ELSE len({w}) END)"
    letters = f"length(replace({_squeeze(c)}, ' ', ''))"
    return rf"(length({_strip(c)}) >= 20 AND {n} >= 5 AND {letters} >= {n} * 2.5 AND len(regexp_extract_all({c}, '[\p{{L}}\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]')) >= length({c}) * 0.7)"


@query("meaningful_pages", f"SELECT rec_id, coalesce({_meaningful('content')}, false) AS meaningful FROM ayurveda_docs_final")
def meaningful_pages(spark, d):
    return _pages(spark, d).select("rec_id", T.is_meaningful(F.col("content")).alias("meaningful"))


@query("load_counters", f"""SELECT count(*) AS total, count_if(coalesce({_strip('content')}, '') = '') AS empty,
  count_if(coalesce({_strip('content')}, '') <> '' AND NOT {_meaningful('content')}) AS gibberish, count_if(coalesce({_meaningful('content')}, false)) AS valid FROM ayurveda_docs_final""")
def load_counters(spark, d):
    good, blank = T.is_meaningful(F.col("content")), F.coalesce(T.strip(F.col("content")), F.lit("")) == ""
    return _pages(spark, d).agg(F.count("*").alias("total"), F.count_if(blank).alias("empty"), F.count_if(~blank & ~good).alias("gibberish"), F.count_if(good).alias("valid"))


def _ocr_sql(c: str) -> str:
    for p in (rf"Vol\.{SP}*Page\.", rf"Vol\.{SP}*Rage\.", rf"Page\.{SP}*\d+", rf"\d+{SP}*Vol\.", r"INDEX\.", "i{2,}", r"\^+", r"\.{3,}", SP + "{3,}", "[■□●○▪▫◆◇★☆]+", r"\x{fffd}+", r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]"):
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    for _ in range(2):  # a removed letter's neighbours may be neighbours of the next
        c = rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])[a-zA-Z]($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    for a, b in T.APOSTROPHES:
        c = "replace({}, '{}', '{}')".format(c, a.replace("'", "''"), b)
    return _squeeze(c)


def _ocr_steps(c):
    """ocr_clean without its last step, repeated signs, which needs a back reference."""
    for pattern in T.OCR_MARKS:
        c = F.regexp_replace(c, pattern, " ")
    return T.squeeze(T.replace_all(T.drop_single_letters(c), T.APOSTROPHES))


@query("ocr_marks", f"SELECT rec_id, {_ocr_sql('content')} AS content FROM ayurveda_docs_final")
def ocr_marks(spark, d):
    return _pages(spark, d).select("rec_id", _ocr_steps(F.col("content")).alias("content"))


@query("ocr_clean")
def ocr_clean(spark, d):
    return _pages(spark, d).select("rec_id", T.ocr_clean(F.col("content")).alias("content"))


_CHUNKS = rf"""WITH RECURSIVE s AS (
  SELECT rec_id, list_filter(list_transform(regexp_split_to_array(content, '[.!?]{SP}+'), lambda x: {_strip('x')}), lambda x: length(x) > 15) AS parts
  FROM ayurveda_docs_final WHERE content IS NOT NULL
), r AS (
  SELECT rec_id, parts, 1 AS i, []::VARCHAR[] AS open, 0 AS n, NULL::VARCHAR AS done, 0 AS made FROM s WHERE len(parts) > 0
  UNION ALL
  SELECT rec_id, parts, i + 1,
    list_append(CASE WHEN cut THEN CASE WHEN len(open) > 1 THEN [open[len(open)]] ELSE [] END ELSE open END, parts[i]),
    CASE WHEN cut THEN CASE WHEN len(open) > 1 THEN length(open[len(open)]) ELSE 0 END ELSE n END + length(parts[i]),
    CASE WHEN cut THEN array_to_string(open, ' ') END, made + CASE WHEN cut THEN 1 ELSE 0 END
  FROM (SELECT *, n + length(parts[i]) > 400 AND len(open) > 0 AS cut FROM r) WHERE i <= len(parts)
), c AS (
  SELECT rec_id, made - 1 AS chunk_id, done AS content FROM r WHERE done IS NOT NULL
  UNION ALL SELECT rec_id, made, array_to_string(open, ' ') FROM r WHERE i = len(parts) + 1
) SELECT rec_id, chunk_id, content FROM c WHERE length(content) >= 30"""


@query("chunk_corpus", _CHUNKS)
def chunk_corpus(spark, d):
    return chunks.chunk(_pages(spark, d), "rec_id", "content")


@query("chunk_stats", _CHUNKS.rsplit("SELECT", 1)[0] + "SELECT count(*) AS chunks, round(avg(length(content)), 6) AS mean_length FROM c WHERE length(content) >= 30")
def chunk_stats(spark, d):
    return chunk_corpus(spark, d).agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("content")), 6).alias("mean_length"))


_VECTOR_ID = "concat(string_split(string_split(coalesce(source, 'unknown'), chr(92))[-1], '/')[-1], '|p', coalesce(page, -1), '|d', rec_id, '|c0')"


@query("vector_ids", f"SELECT rec_id, {_VECTOR_ID} AS id, left(content, 1000) AS content FROM ayurveda_docs_final")
def vector_ids(spark, d):
    made = chunks.vector_id(F.col("source"), F.col("page"), F.col("rec_id"), F.lit(0))
    return _pages(spark, d).select("rec_id", made.alias("id"), F.left(F.col("content"), F.lit(1000)).alias("content"))


@query("pages_last_wins", """SELECT source, page, rec_id, content FROM (SELECT source, page, rec_id, content,
  row_number() OVER (PARTITION BY source, page ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS r FROM ayurveda_docs_final) WHERE r = 1""")
def pages_last_wins(spark, d):
    rows = _pages(spark, d).select("source", "page", "rec_id", "content", "loaded_at")
    return chunks.last_wins(rows, ["source", "page"], ["loaded_at", "rec_id"]).select("source", "page", "rec_id", "content")


def _page_marks_sql(c: str) -> str:
    """Marks one after the other, each leaving a sign, so that what is left of a line is not taken for a mark."""
    for _ in range(2):  # a mark's end may be the beginning of the next
        c = rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])\d+\s*\|\s*Page($|[^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g')"
    c = rf"regexp_replace({c}, '\[Page\s+\d+\]', chr(1), 'g')"
    return rf"replace(regexp_replace({c}, '(?m)^[\d\s|]+$', '', 'g'), chr(1), '')"


@query("page_marks", f"SELECT rec_id, {_page_marks_sql('content')} AS content FROM {_NUMBERED}")
def page_marks(spark, d):
    """Page marks of all pages; every page gets its number as `N | Page`, which the tables do not have."""
    return _pages(spark, d).select("rec_id", T.drop_page_marks(_numbered(F.col("content"), F.col("page"))).alias("content"))


@query("raw_fallback", rf"""SELECT rec_id, CASE WHEN trim(clean) = '' THEN content ELSE clean END AS content FROM (SELECT rec_id, content, {_READABLE} AS clean FROM ayurveda_docs_final WHERE content IS NOT NULL)""")
def raw_fallback(spark, d):
    pages_ = _pages(spark, d).where(F.col("content").isNotNull())
    return pages_.select("rec_id", T.or_raw(T.readable_tokens(F.col("content")), F.col("content")).alias("content"))


@query("repeated_lines_default", _REPEATED.replace(f"* {REPEAT}", "* 0.3"))
def repeated_lines_default(spark, d):
    """Repeated lines at the operator's own share."""
    return pages.repeated_lines(_pages(spark, d), "source", "content")


@query("skip_reasons", f"SELECT rec_id, CASE WHEN coalesce(length({_strip('content')}), 0) < 10 THEN 'too_short' END AS skipped FROM ayurveda_docs_final")
def skip_reasons(spark, d):
    return _pages(spark, d).select("rec_id", pages.skip_reason(F.col("content")).alias("skipped"))


@query("dehyphenated", rf"SELECT rec_id, regexp_replace(content, '-{SP}*\n{SP}*', '', 'g') AS content FROM ayurveda_docs_final")
def dehyphenated(spark, d):
    return _pages(spark, d).select("rec_id", T.dehyphenate(F.col("content")).alias("content"))


@query("ligatures", "SELECT rec_id, " + "replace(" * len(T.LIGATURES) + "content" + "".join(f", '{a}', '{b}')" for a, b in T.LIGATURES) + " AS content FROM ayurveda_docs_final")
def ligatures(spark, d):
    return _pages(spark, d).select("rec_id", T.ligatures(F.col("content")).alias("content"))


_SENTENCES = rf"string_split(regexp_replace({_squeeze('content')}, '([.!?]){SP}+', '\1' || chr(30), 'g'), chr(30))"


@query("paragraphs", rf"""SELECT rec_id, (SELECT string_agg(part, chr(10) || chr(10) ORDER BY g) FROM (
  SELECT (i - 1) // 3 AS g, string_agg(s, ' ' ORDER BY i) AS part FROM (SELECT unnest(parts) AS s, unnest(range(1, len(parts) + 1)) AS i) GROUP BY g)) AS content
  FROM (SELECT rec_id, list_transform({_SENTENCES}, lambda x: CASE WHEN length(x) > 1 THEN upper(x[1]) || x[2:] ELSE x END) AS parts FROM ayurveda_docs_final WHERE content IS NOT NULL)""")
def paragraphs(spark, d):
    made = T.paragraphs(F.transform(T.sentences(T.squeeze(F.col("content"))), T.capitalise))
    return _pages(spark, d).where(F.col("content").isNotNull()).select("rec_id", made.alias("content"))


@query("page_entities", """SELECT rec_id, array_to_string(list_sort(list_filter((SELECT list(DISTINCT canonical) FROM lexicon WHERE canonical IS NOT NULL),
  lambda t: contains(lower(content), lower(t)))), '|') AS entities FROM ayurveda_docs_final WHERE content IS NOT NULL""")
def page_entities(spark, d):
    rows = _pages(spark, d).where(F.col("content").isNotNull())
    return rows.select("rec_id", F.array_join(pages.mentions(F.col("content"), _terms(spark, d)), "|").alias("entities"))


@query("canonical_spelling", rf"""WITH keys AS (
  SELECT v AS exact, NULL AS folded, ord, canonical FROM (SELECT unnest(variants) AS v, ord, canonical FROM lexicon)
  UNION ALL SELECT NULL, lower(canonical), ord, canonical FROM lexicon),
w AS (SELECT rec_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT rec_id, string_split({_squeeze('content')}, ' ') AS ws FROM ayurveda_docs_final WHERE content IS NOT NULL)),
d AS (SELECT DISTINCT word, regexp_replace(word, '[^a-zA-Z]', '', 'g') AS bare FROM w),
m AS (SELECT d.word, arg_min(k.canonical, k.ord) AS canonical FROM d JOIN keys k ON d.bare <> '' AND (d.bare = k.exact OR lower(d.bare) = k.folded) GROUP BY d.word)
SELECT w.rec_id, string_agg(coalesce(m.canonical, w.word), ' ' ORDER BY w.i) AS content FROM w LEFT JOIN m ON m.word = w.word GROUP BY w.rec_id""")
def canonical_spelling(spark, d):
    names, variants = pages.lexicon_keys(table(spark, d, "lexicon"))
    rows = _pages(spark, d).where(F.col("content").isNotNull())
    return rows.select("rec_id", pages.normalise_spelling(F.col("content"), names, variants).alias("content"))


@query("fuzzy_lexicon")
def fuzzy_lexicon(spark, d):
    return pages.fuzzy_lexicon(_pages(spark, d), "rec_id", "content", table(spark, d, "lexicon"))


@query("nfkc")
def nfkc_pages(spark, d):
    return _pages(spark, d).select("rec_id", nfkc("content").alias("content"))


@query("without_accents")
def accents(spark, d):
    return _pages(spark, d).select("rec_id", without_accents("content").alias("content"))


@query("spaced_letters")
def spaced_letters(spark, d):
    return _pages(spark, d).select("rec_id", T.join_spaced_letters(T.drop_intrusive(F.col("content"))).alias("content"))


@query("repeated_words")
def repeated_words(spark, d):
    return _pages(spark, d).select("rec_id", T.drop_repeated_signs(T.drop_repeated_words(F.col("content"))).alias("content"))


@query("integrated_clean")
def integrated_clean(spark, d):
    """All pages with their source's repeated lines at hand; lines are kept as lines, as no words are preserved."""
    repeated = pages.repeated_lines(_pages(spark, d), "source", "content", REPEAT).groupBy(F.col("source").alias("_s")).agg(F.collect_set("line_norm").alias("_lines"))
    rows = attach(_pages(spark, d), "source", repeated, "_s", "rec_id")
    return rows.select("rec_id", pages.integrated_clean(F.col("content"), F.col("_lines")).alias("content"), pages.skip_reason(F.col("content")).alias("skipped"))


@query("clean_pages")
def clean_pages(spark, d):
    return pages.clean_pages(_pages(spark, d), "rec_id", "source", "content", _terms(spark, d), REPEAT, table(spark, d, "lexicon"))
