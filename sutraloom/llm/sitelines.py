"""Lines repeated across one source's documents: find them, and give every document back without them.

Method: each line is reduced to its letters and hashed to 128 bits; records are counted per source and hash (lines
repeated inside one record count once); lines that reach the least number of records and the least share of the
source's records are frequent; they are joined back and the documents are rebuilt from their other lines.

Scale: counting is a partial aggregation per (source, hash), so a source with a third of all rows moves one counter
per line and task. A source has at most (mean lines of its records) / min_share frequent lines; all of them together
are broadcast only after their number has been checked, beyond that bound they meet the lines by a shuffle on
(source, hash), whose hot keys AQE splits.

Defined results: null source or null text: nothing is removed. Lines without a letter are never frequent. A record
whose every line is frequent becomes the empty text. Lines are cut at line feeds only and counted from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutraloom.runtime import attach, cut_lineage, fresh_name

MIN_RECORDS, MIN_SHARE = 5, 0.15
#: Frequent lines that may be broadcast (24 bytes each).
BROADCAST_ROWS = 500_000
#: Sources whose lists of such lines may be broadcast together.
BROADCAST_SOURCES = 50_000


def letters_only(line: Column) -> Column:
    """A line's letters in one case; the sharp s counts as its two letters, as upper case writes it."""
    return F.replace(F.regexp_replace(F.lower(line), r"[^\p{L}]+", ""), F.lit("ß"), F.lit("ss"))


def line_hash(line: Column) -> Column:
    """128 bits of a line's letters; null where it has none."""
    key = letters_only(line)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def frequent_lines(
    df: DataFrame, source: str, text: str, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE
) -> DataFrame:
    """(source, hash, n_records, n_source): the lines that recur too often within their source."""
    rows = df.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(text).alias("text"))
    per_record = F.array_compact(F.array_distinct(F.transform(_lines("text"), line_hash)))
    counts = (
        rows.where(F.col("text").isNotNull()).select("source", F.explode(per_record).alias("hash"))
        .groupBy("source", "hash").agg(F.count("*").alias("n_records")).where(F.col("n_records") >= min_records)
    )
    totals = rows.groupBy("source").agg(F.count("*").alias("n_source"))
    return counts.join(totals, "source").where(F.col("n_records") >= F.col("n_source") * F.lit(min_share))


def _sized(frequent: DataFrame) -> tuple[DataFrame, bool]:
    """The frequent lines, written once, and whether their number allows a broadcast."""
    kept = cut_lineage(frequent)
    return kept, kept.count() <= BROADCAST_ROWS


def find_lines(
    df: DataFrame, key: str, source: str, text: str, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE
) -> DataFrame:
    """(key, line_no) of each frequent line of each record."""
    frequent, small = _sized(frequent_lines(df, source, text, min_records, min_share).select("source", "hash"))
    lines = (
        df.where(F.col(source).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key), F.col(source).alias("source"), F.posexplode(F.transform(_lines(text), line_hash)).alias("at", "hash"))
        .where(F.col("hash").isNotNull())
    )
    side = F.broadcast(frequent) if small else frequent
    return lines.join(side, ["source", "hash"], "left_semi").select(key, (F.col("at") + 1).cast("bigint").alias("line_no"))


def remove_lines(
    df: DataFrame, source: str, text: str, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE, salts: int = 64
) -> DataFrame:
    """df with `text` rebuilt without its source's frequent lines; all rows and other columns stay."""
    own, hashes = fresh_name(df, "_source"), fresh_name(df, "_hashes")
    frequent = frequent_lines(df, source, text, min_records, min_share)
    lists = frequent.groupBy(F.col("source").alias(own)).agg(F.collect_set("hash").alias(hashes))
    joined = attach(df, source, lists, own, text, BROADCAST_SOURCES, salts)
    kept = F.filter(_lines(text), lambda line: ~F.coalesce(F.array_contains(F.col(hashes), line_hash(line)), F.lit(False)))
    new = F.when(F.col(hashes).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text, new).drop(own, hashes)


FOUND_SQL = r"""
WITH lines AS (
  SELECT rec_id, source, u.line_no, replace(regexp_replace(lower(u.line), '[^\p{L}]+', '', 'g'), 'ß', 'ss') AS letters
  FROM (SELECT rec_id, source, string_split(content, chr(10)) AS parts FROM ayurveda_docs_final
        WHERE source IS NOT NULL AND content IS NOT NULL) d,
       LATERAL (SELECT unnest(d.parts) AS line, unnest(range(1, len(d.parts) + 1)) AS line_no) u
), totals AS (SELECT source, count(*) AS n FROM ayurveda_docs_final WHERE source IS NOT NULL GROUP BY source),
frequent AS (
  SELECT l.source, l.letters FROM lines l JOIN totals t ON l.source = t.source WHERE l.letters <> ''
  GROUP BY l.source, l.letters, t.n HAVING count(DISTINCT l.rec_id) >= 5 AND count(DISTINCT l.rec_id) >= t.n * 0.15
)
SELECT l.rec_id, l.line_no FROM lines l JOIN frequent f ON l.source = f.source AND l.letters = f.letters
"""

#: The same lines, taken out of the whole texts.
CLEAN_SQL = FOUND_SQL.rsplit("SELECT", 1)[0] + """
SELECT d.rec_id, CASE WHEN d.source IS NULL OR d.content IS NULL THEN d.content ELSE coalesce(k.content, '') END AS content
FROM ayurveda_docs_final d LEFT JOIN (
  SELECT p.rec_id, string_agg(p.line, chr(10) ORDER BY p.line_no) AS content
  FROM (SELECT rec_id, source, unnest(string_split(content, chr(10))) AS line,
               unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no
        FROM ayurveda_docs_final WHERE source IS NOT NULL AND content IS NOT NULL) p
  WHERE NOT EXISTS (SELECT 1 FROM frequent f WHERE f.source = p.source
                    AND f.letters = replace(regexp_replace(lower(p.line), '[^\\p{L}]+', '', 'g'), 'ß', 'ss'))
  GROUP BY p.rec_id) k ON k.rec_id = d.rec_id
"""
