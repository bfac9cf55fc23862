"""Queries on word lists, spelling and word classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sutraloom.functions import text as T
from sutraloom.operators import vocabulary, wordclass
from sutraloom.plans.page_queries import SP, _squeeze, _strip
from sutraloom.plans.registry import query
from sutraloom.runtime import table

WORDS = "final_language_dataset"


def _words(spark, d):
    return table(spark, d, WORDS)


def _glossary(spark, d):
    return table(spark, d, "sanskrit_glossary")


def _fill(template: str, c: str) -> str:
    """The template with an expression in its place."""
    return template.replace("{c}", c)


_PLAIN = "replace(" * len(T.IAST) + "{c}" + "".join(f", '{a}', '{b}')" for a, b in T.IAST)
_UNDER = rf"trim(regexp_replace(regexp_replace({{c}}, '-|{SP}+', '_', 'g'), '_+', '_', 'g'), '_')"


@query("iast_ascii", f"SELECT entry_id, {_fill(_UNDER, _strip('sanskrit_term'))} AS iast, lower({_fill(_UNDER, _fill(_PLAIN, _fill(_UNDER, _strip('sanskrit_term'))))}) AS ascii FROM sanskrit_glossary")
def iast_ascii(spark, d):
    iast = T.underscored(T.strip(F.col("sanskrit_term")))
    return _glossary(spark, d).select("entry_id", iast.alias("iast"), T.term_to_ascii(iast).alias("ascii"))


_KEY = rf"lower(regexp_replace({{c}}, '{SP}+|-', '_', 'g'))"


@query("term_keys", f"SELECT entry_id, {_fill(_KEY, _strip('sanskrit_term'))} AS term_key FROM sanskrit_glossary")
def term_keys(spark, d):
    return _glossary(spark, d).select("entry_id", T.term_key(F.col("sanskrit_term")).alias("term_key"))


# Pages of a glossary made from the tables' terms: tags with attributes, nested and unclosed, in either case.
_GLOSSARY_PAGE = ("<html><body><p><STRONG class='t'>", "</STRONG> gloss<br>and <strong><i>", "</i>-x: </strong><stronger>no</stronger>")
_ENTRY_PAGE = ("<div><p align='left'>", " - a <b>plant</b> of hills<p>Root-stock (", ") – of a tree</p><p>no dash here</p><P> ", " (variant)</P></div>")


def _page_sql(parts: tuple[str, ...], c: str) -> str:
    return f" || {c} || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _page(parts: tuple[str, ...], c):
    every = [F.lit(parts[0])]
    for p in parts[1:]:
        every += [c, F.lit(p)]
    return F.concat(*every)


_BARE_TAGS = "regexp_replace(x, '<[^>]*>', '', 'g')"
_INNER = f"unnest(list_transform(regexp_extract_all(html, '(?is)<strong(?:\\s[^>]*)?>(.*?)</strong>', 1), lambda x: {_strip(_BARE_TAGS)}))"


@query("glossary_terms", f"""SELECT DISTINCT term FROM (SELECT replace(regexp_replace(t, ':$', ''), '-', '_') AS term FROM (
  SELECT {_INNER} AS t FROM (SELECT {_page_sql(_GLOSSARY_PAGE, 'sanskrit_term')} AS html FROM sanskrit_glossary WHERE sanskrit_term IS NOT NULL))) WHERE term <> ''""")
def glossary_terms(spark, d):
    """Terms in a tag of pages that hold every term of the glossary."""
    html = _glossary(spark, d).where(F.col("sanskrit_term").isNotNull()).select(_page(_GLOSSARY_PAGE, F.col("sanskrit_term")).alias("html"))
    return vocabulary.glossary_terms(html, "html")


_BLOCKS_OFF = r"regexp_replace(regexp_replace(x, '(?is)</?(?:p|br|div|h[1-6]|ul|ol|li|table|tr|td|body|html)\b.*$', ''), '<[^>]*>', '', 'g')"
_HEAD = r"regexp_extract(t, '^([A-Za-z \-()]+?)\s*[-–]\s*(?:.*)$', 1)"
_MAIN, _VARIANT = r"regexp_replace(head, '\(.*?\)', '', 'g')", r"regexp_extract(head, '\((.*?)\)', 1)"


@query("entry_terms", rf"""WITH t AS (SELECT unnest(list_transform(regexp_split_to_array(html, '(?i)<p(?:\s[^>]*)?>')[2:], lambda x: {_squeeze(_BLOCKS_OFF)})) AS t
  FROM (SELECT {_page_sql(_ENTRY_PAGE, 'sanskrit_ayurvedic_terms')} AS html FROM ayurveda_terms_from_ak WHERE sanskrit_ayurvedic_terms IS NOT NULL)),
h AS (SELECT {_strip(_HEAD)} AS head FROM t),
p AS (SELECT {_strip(_MAIN)} AS part FROM h WHERE head <> '' UNION ALL SELECT {_strip(_VARIANT)} FROM h WHERE regexp_matches(head, '\(.*?\)'))
SELECT DISTINCT lower(regexp_replace(regexp_replace(part, '[- ]', '_', 'g'), '_+', '_', 'g')) AS term FROM p""")
def entry_terms(spark, d):
    """Terms and variants in the paragraphs of pages that hold every entry."""
    html = table(spark, d, "ayurveda_terms_from_ak").where(F.col("sanskrit_ayurvedic_terms").isNotNull()).select(_page(_ENTRY_PAGE, F.col("sanskrit_ayurvedic_terms")).alias("html"))
    return vocabulary.entry_terms(html, "html")


_SLP1 = rf"regexp_replace(regexp_replace(regexp_replace({_strip('{c}')}, '[-—]', '', 'g'), 'srs+', '', 'g'), '[^a-zA-Z]', '', 'g')"
_VALID = "CASE WHEN length(w) >= 3 AND regexp_matches(w, '[aAiIuUfFxXeEoO]') THEN w END"
_SOUNDS = "map([" + ", ".join(f"'{k}'" for k in T.SLP1) + "], [" + ", ".join(f"'{v}'" for v in T.SLP1.values()) + "])"
_IAST = f"array_to_string(list_transform(string_split(w, ''), lambda x: coalesce({_SOUNDS}[x], x)), '')"


@query("slp1_words", f"SELECT word_id, w AS word, {_IAST} AS iast FROM (SELECT word_id, {_VALID} AS w FROM (SELECT word_id, {_fill(_SLP1, 'ascii')} AS w FROM final_language_dataset))")
def slp1_words(spark, d):
    made = _words(spark, d).select("word_id", T.slp1_word(F.col("ascii")).alias("word"))
    return made.select("word_id", "word", T.slp1_to_iast(F.col("word")).alias("iast"))


@query("dictionary_terms", f"""SELECT DISTINCT iast, {_fill(_PLAIN, 'iast')} AS ascii FROM (SELECT {_IAST} AS iast FROM (SELECT {_VALID} AS w FROM (
  SELECT unnest([{_fill(_SLP1, 'ascii')}, {_fill(_SLP1, "upper(ascii)")}]) AS w FROM final_language_dataset WHERE ascii IS NOT NULL AND NOT contains(ascii, '<'))) WHERE w IS NOT NULL) WHERE NOT regexp_matches(iast, '[ḻṟ]')""")
def dictionary_terms(spark, d):
    """Words in the tags of dictionary lines, one for each word of the table."""
    words = _words(spark, d).where(F.col("ascii").isNotNull() & ~F.contains("ascii", F.lit("<")))
    lines = words.select(F.concat(F.lit("<L>12<k1>"), F.upper("ascii"), F.lit("</k1> of <s>"), F.col("ascii"), F.lit("</s> cf. <ls>x</ls>")).alias("line"))
    return vocabulary.dictionary_terms(lines, "line")


_CELL = _fill(_UNDER, _strip("sanskrit_term"))


@query("table_terms", f"SELECT {_CELL} AS iast, lower({_fill(_UNDER, _fill(_PLAIN, _CELL))}) AS ascii FROM sanskrit_glossary WHERE sanskrit_term <> '' AND NOT contains(sanskrit_term, 'Sanskrit')")
def table_terms(spark, d):
    return vocabulary.table_terms(_glossary(spark, d), "sanskrit_term")


@query("sorted_vocabulary", "SELECT row_number() OVER (ORDER BY word) - 1 AS position, word FROM (SELECT DISTINCT ascii AS word FROM final_language_dataset WHERE ascii IS NOT NULL)")
def sorted_vocabulary(spark, d):
    return vocabulary.sorted_words(_words(spark, d), "ascii")


@query("edit_distances", "SELECT DISTINCT ascii AS word, levenshtein(ascii, lower(ascii) || 'a') AS typed, levenshtein(ascii, 'vata') AS other FROM final_language_dataset WHERE ascii IS NOT NULL AND regexp_full_match(ascii, '[ -~]*')")
def edit_distances(spark, d):
    words = _words(spark, d).where(F.col("ascii").isNotNull() & F.regexp_like("ascii", F.lit("^[ -~]*$"))).select(F.col("ascii").alias("word")).distinct()
    return words.select("word", F.levenshtein("word", F.concat(F.lower("word"), F.lit("a"))).cast("bigint").alias("typed"), F.levenshtein("word", F.lit("vata")).cast("bigint").alias("other"))


_LOG = "(SELECT (strftime(o_orderdate, '%Y')::INT - 1992) * 12 + strftime(o_orderdate, '%m')::INT - 1 AS epoch, round(avg(o_totalprice), 2) AS val_loss, round(1e0 / count(*), 9) AS val_accuracy FROM orders GROUP BY 1)"


@query("best_epoch", f"SELECT (epoch + 1)::BIGINT AS epoch, val_loss, val_accuracy FROM {_LOG} ORDER BY val_loss, val_accuracy LIMIT 1")
def best_epoch(spark, d):
    """The month of least mean price, as a training log's epoch of least loss."""
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    log = table(spark, d, "orders").groupBy(month.alias("epoch")).agg(F.round(F.avg("o_totalprice"), 2).alias("val_loss"), F.round(1.0 / F.count("*"), 9).alias("val_accuracy"))
    return wordclass.best_epoch(log)


@query("vocab_union", " UNION ".join(f"SELECT {_fill(_KEY, _strip(c))} AS ascii, 1 AS label FROM {t} WHERE {_strip(c)} <> ''" for c, t in (("sanskrit_term", "sanskrit_glossary"), ("sanskrit_ayurvedic_terms", "ayurveda_terms_from_ak"), ("ascii", "(SELECT ascii FROM final_language_dataset WHERE label = 1)"))))
def vocab_union(spark, d):
    lists = [_glossary(spark, d).select("sanskrit_term"), table(spark, d, "ayurveda_terms_from_ak").select("sanskrit_ayurvedic_terms"), _words(spark, d).where("label = 1").select("ascii")]
    return vocabulary.union_of_terms(lists)


@query("labelled_vocab", f"""SELECT ascii, label FROM (SELECT ascii, label, row_number() OVER (PARTITION BY ascii ORDER BY o, label) AS r FROM (
  SELECT ascii, label, 0 AS o FROM final_language_dataset WHERE label = 1 UNION ALL SELECT replace(lower({_strip('ascii')}), ' ', '_'), 0, 1 FROM final_language_dataset WHERE label = 0 AND {_strip('ascii')} <> '')) WHERE r = 1""")
def labelled_vocab(spark, d):
    words = _words(spark, d)
    return vocabulary.labelled_words(words.where("label = 1").select("ascii", "label"), vocabulary.english_words(words.where("label = 0"), "ascii"))


@query("spelling_forms")
def spelling_forms(spark, d):
    return vocabulary.spelling_forms(_glossary(spark, d), "sanskrit_term")


_TRI = "unnest(list_distinct(list_transform(range(1, length(word) + 1), lambda i: ('#' || word || '#')[i:i + 2])))"
_DISTINCT = "(SELECT DISTINCT ascii AS word FROM final_language_dataset WHERE {} AND ascii IS NOT NULL)"


@query("trigram_index", f"SELECT trigram, count(*) AS n_words FROM (SELECT word, {_TRI} AS trigram FROM {_DISTINCT.format('label = 1')}) GROUP BY trigram")
def trigram_index(spark, d):
    return vocabulary.trigram_index(_words(spark, d).where("label = 1"), "ascii").groupBy("trigram").agg(F.count("*").alias("n_words"))


@query("trigram_candidates", f"""SELECT word, candidate, common FROM (SELECT a.word, b.word AS candidate, count(*) AS common, row_number() OVER (PARTITION BY a.word ORDER BY count(*) DESC, b.word) AS r
  FROM (SELECT word, {_TRI} AS t FROM {_DISTINCT.format('word_id % 20 = 0')}) a JOIN (SELECT word, {_TRI} AS t FROM {_DISTINCT.format('label = 1')}) b ON a.t = b.t GROUP BY a.word, b.word) WHERE r <= 10""")
def trigram_candidates(spark, d):
    """Candidates of every word whose id is divisible by 20 among all words of label 1."""
    words = _words(spark, d)
    return vocabulary.trigram_candidates(words.where("word_id % 20 = 0"), "ascii", words.where("label = 1"), "ascii")


@query("vocab_stats", f"""SELECT (SELECT round(count(ascii) / count(DISTINCT ascii), 6) FROM final_language_dataset) AS mean_frequency, (SELECT count(*) FROM {_DISTINCT.format('true')}) AS total_words, (SELECT count(DISTINCT lower(word)) FROM {_DISTINCT.format('true')}) AS unique_lowercase,
  (SELECT count(DISTINCT t) FROM (SELECT {_TRI} AS t FROM {_DISTINCT.format('true')})) AS total_trigrams""")
def vocab_stats(spark, d):
    return vocabulary.vocabulary_counts(_words(spark, d), "ascii")


@query("spell_words")
def spell_words(spark, d):
    """Corrections of every word whose id is divisible by 20 against all words of label 1."""
    words = _words(spark, d)
    return vocabulary.correct_words(words.where("word_id % 20 = 0"), "ascii", words.where("label = 1"), "ascii")


@query("spell_texts")
def spell_texts(spark, d):
    """All user messages, their words corrected against all words of the pages' lexicon and the labelled words."""
    messages = table(spark, d, "chat_messages").where("role = 'user'").select(F.concat_ws(":", "session_id", "seq", "arrived_at").alias("key"), "content")
    known = _words(spark, d).where("label = 1").select("ascii").unionByName(table(spark, d, "lexicon").select(F.col("canonical").alias("ascii")))
    return vocabulary.correct_texts(messages, "key", "content", known, "ascii", " ")


_CHARS = "(SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(lower(ascii), '')) AS ch FROM final_language_dataset WHERE ascii <> '') WHERE ch <> '' GROUP BY ch)"


@query("char_index", f"SELECT ch, n, row_number() OVER (ORDER BY n DESC, ch) AS rank FROM {_CHARS}")
def char_index(spark, d):
    return wordclass.character_index(_words(spark, d), "ascii")


@query("char_encode", f"""WITH ix AS (SELECT ch, row_number() OVER (ORDER BY n DESC, ch) AS rank FROM {_CHARS}), m AS (SELECT map_from_entries(list((ch, rank))) AS ranks FROM ix),
w AS (SELECT word_id, list_transform(string_split(lower(ascii), ''), lambda c: coalesce(ranks[c], 0))[-40:] AS codes FROM final_language_dataset, m WHERE ascii <> '')
SELECT word_id, array_to_string(list_resize(codes, 40, 0), ',') AS codes FROM w""")
def char_encode(spark, d):
    return wordclass.encoded(_words(spark, d), "word_id", "ascii").select("word_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("label_counts", "SELECT label, count(*) AS n FROM final_language_dataset GROUP BY label")
def label_counts(spark, d):
    return wordclass.label_counts(_words(spark, d), "label")


# A class by letters alone, to have predictions that SQL can repeat.
_GUESS_SQL = "CASE WHEN regexp_matches(lower(ascii), '[0-9^~*;|#]') OR NOT regexp_matches(lower(ascii), '[aeiou]') THEN 2 WHEN regexp_matches(lower(ascii), 'aa|ii|uu|_|[bdgjkpt]h') THEN 1 ELSE 0 END"


def _guessed(spark, d):
    low = F.lower("ascii")
    guess = F.when(F.regexp_like(low, F.lit(r"[0-9^~*;|#]")) | ~F.regexp_like(low, F.lit("[aeiou]")), 2).when(F.regexp_like(low, F.lit("aa|ii|uu|_|[bdgjkpt]h")), 1).otherwise(0)
    return _words(spark, d).where(F.col("ascii").isNotNull() & F.col("label").isNotNull()).withColumn("guess", guess)


_GUESSED = f"(SELECT label, {_GUESS_SQL} AS guess FROM final_language_dataset WHERE ascii IS NOT NULL AND label IS NOT NULL)"


@query("confusion", f"SELECT label, count_if(guess = 0) AS p0, count_if(guess = 1) AS p1, count_if(guess = 2) AS p2 FROM {_GUESSED} GROUP BY label")
def confusion(spark, d):
    return wordclass.confusion(_guessed(spark, d), "label", "guess")


@query("class_report", f"""WITH g AS {_GUESSED}, c AS (SELECT k, count_if(label = k AND guess = k) AS h, count_if(guess = k) AS gs, count_if(label = k) AS s FROM g, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
p AS (SELECT k, CASE WHEN gs = 0 THEN 0e0 ELSE h / gs END AS pr, CASE WHEN s = 0 THEN 0e0 ELSE h / s END AS re, s FROM c),
f AS (SELECT k::VARCHAR AS class, pr, re, CASE WHEN pr + re = 0 THEN 0e0 ELSE 2 * pr * re / (pr + re) END AS f1, s FROM p), t AS (SELECT count_if(label = guess) / count(*) AS acc, count(*) AS n FROM g),
u AS (SELECT class, pr, re, f1, s FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM t UNION ALL SELECT 'macro', avg(pr), avg(re), avg(f1), sum(s)::BIGINT FROM f
  UNION ALL SELECT 'weighted', sum(pr * s) / sum(s), sum(re * s) / sum(s), sum(f1 * s) / sum(s), sum(s)::BIGINT FROM f)
SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, s AS support FROM u""")
def class_report(spark, d):
    return wordclass.class_report(_guessed(spark, d), "label", "guess")


_SHARE = "('0x' || md5(concat_ws('|', word_id, ascii))[1:8])::BIGINT / 4294967296e0"


@query("word_split", f"SELECT word_id, label, CASE WHEN {_SHARE} < 0.7 THEN 'train' WHEN {_SHARE} < 0.85 THEN 'valid' ELSE 'test' END AS part FROM final_language_dataset")
def word_split(spark, d):
    return wordclass.split_by_hash(_words(spark, d), "word_id", "ascii").select("word_id", "label", "part")


@query("stratified_split", f"""SELECT word_id, label, CASE WHEN r <= ceil(0.70 * n) THEN 'train' WHEN r <= ceil(0.85 * n) THEN 'valid' ELSE 'test' END AS part FROM (
  SELECT word_id, label, row_number() OVER (PARTITION BY label ORDER BY {_SHARE}) AS r, count(*) OVER (PARTITION BY label) AS n FROM final_language_dataset)""")
def stratified_split(spark, d):
    return wordclass.stratified_split(_words(spark, d).select("word_id", "ascii", "label"), "label", "word_id", "ascii").select("word_id", "label", "part")


@query("label_index", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS index FROM (SELECT DISTINCT label FROM final_language_dataset WHERE label IS NOT NULL)")
def label_index(spark, d):
    return wordclass.label_index(_words(spark, d), "label")


@query("noisy_words")
def noisy_words(spark, d):
    """Invented junk (random letters, the same with typing errors and as misread) beside 10,000 misspelled words of
    class 1, as training rows."""
    words = _words(spark, d).where(F.col("label") == 1).select(F.trim("ascii").alias("ascii"), "word_id").where(F.length("ascii") > 0)
    some = wordclass.shuffled(words, "word_id", "ascii").limit(10_000)
    junk = wordclass.random_junk(spark, 40_000)
    typos = wordclass.misspelled(wordclass.random_junk(spark, 30_000, seed=1_000), "ascii", seed=2_000)
    misread = wordclass.swapped(wordclass.random_junk(spark, 30_000, seed=3_000), "ascii", seed=4_000)
    return junk.unionByName(typos).unionByName(misread).unionByName(wordclass.noisy(some, "ascii", seed=5_000))


@query("word_classifier")
def word_classifier(spark, d):
    """Report of the classifier on the words that it was not trained on."""
    words = wordclass.split_by_hash(_words(spark, d).where(F.col("ascii").isNotNull() & F.col("label").isNotNull()), "word_id", "ascii")
    model = wordclass.fit_classifier(words.where("part = 'train'"), "ascii", "label")
    return wordclass.class_report(wordclass.predict(model, words.where("part = 'test'"), "ascii"), "label", "predicted")


@query("known_words", "SELECT DISTINCT lower(ascii) AS word FROM final_language_dataset WHERE label = 1 AND ascii IS NOT NULL")
def known_words(spark, d):
    return vocabulary.known_words(_words(spark, d), "ascii", "label")


@query("labelled_rows", f"SELECT {_strip('ascii')} AS word, label FROM final_language_dataset WHERE ascii IS NOT NULL AND label IS NOT NULL")
def labelled_rows(spark, d):
    return wordclass.labelled_rows(_words(spark, d), "ascii", "label")


@query("class_names", "SELECT word_id, CASE label WHEN 0 THEN 'English' WHEN 1 THEN 'Sanskrit' WHEN 2 THEN 'Junk' END AS name FROM final_language_dataset")
def class_names(spark, d):
    return _words(spark, d).select("word_id", wordclass.class_name(F.col("label")).alias("name"))


@query("vocabulary_growth", """SELECT word, sum(freq)::BIGINT AS freq FROM (SELECT ascii AS word, 1 AS freq FROM final_language_dataset WHERE label = 1
  UNION ALL SELECT canonical, 1 FROM lexicon) WHERE word IS NOT NULL GROUP BY word""")
def vocabulary_growth(spark, d):
    one = F.lit(1).alias("freq")
    return vocabulary.add_words(_words(spark, d).where("label = 1").select(F.col("ascii").alias("word"), one), table(spark, d, "lexicon").select(F.col("canonical").alias("word"), one))


@query("preserved_terms", f"""WITH w AS (SELECT rec_id, trim(unnest(string_split(trim(regexp_replace(lower(content), '{SP}+', ' ', 'g')), ' ')), '.,;:!?()') AS word FROM ayurveda_docs_final WHERE content IS NOT NULL),
k AS (SELECT DISTINCT lower(ascii) AS word FROM final_language_dataset WHERE label = 1 AND ascii IS NOT NULL)
SELECT d.rec_id, count(k.word) AS n_known FROM ayurveda_docs_final d LEFT JOIN w ON w.rec_id = d.rec_id AND w.word <> '' LEFT JOIN k ON k.word = w.word GROUP BY d.rec_id""")
def preserved_terms(spark, d):
    return vocabulary.preserved_terms(table(spark, d, "ayurveda_docs_final"), "rec_id", "content", known_words(spark, d))


@query("cleaning_stats", f"""SELECT count(*) AS total_processed, coalesce(sum(n), 0)::BIGINT AS terms_preserved FROM (SELECT d.rec_id, (SELECT count(*) FROM (
    SELECT trim(unnest(string_split(trim(regexp_replace(lower(d.content), '{SP}+', ' ', 'g')), ' ')), '.,;:!?()') AS word) w WHERE w.word IN (SELECT lower(ascii) FROM final_language_dataset WHERE label = 1 AND ascii IS NOT NULL)) AS n
  FROM ayurveda_docs_final d WHERE length({_strip('d.content')}) >= 10)""")
def cleaning_stats(spark, d):
    """What the integrated cleaning has done: texts that it processes and known words in them."""
    rows = table(spark, d, "ayurveda_docs_final").where(F.length(T.strip(F.col("content"))) >= 10)
    counts = vocabulary.preserved_terms(rows, "rec_id", "content", known_words(spark, d))
    return counts.agg(F.count("*").alias("total_processed"), F.coalesce(F.sum("n_known"), F.lit(0)).alias("terms_preserved"))
