"""Sentence-aware chunks of texts, with the last sentence of a chunk carried over to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutraloom.functions import text as T


def chunk_array(text: Column, size: int = 400, least_sentence: int = 15) -> Column:
    """Chunks of a text in order. Sentences end at . ! or ? before a blank (the sign is lost) and are longer than
    `least_sentence`; a chunk takes sentences until the next would pass `size` (blanks between them not counted), and
    hands its last one on if it had several."""
    parts = F.filter(F.transform(F.split(text, r"(?U)[.!?]\s+"), T.strip), lambda s: F.length(s) > least_sentence)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("chunks"), none.alias("open"), F.lit(0).alias("n"))

    def take(state: Column, s: Column) -> Column:
        full = (state["n"] + F.length(s) > size) & (F.size(state["open"]) > 0)
        chunks = F.when(full, F.concat(state["chunks"], F.array(F.array_join(state["open"], " ")))).otherwise(state["chunks"])
        carried = F.when(F.size(state["open"]) > 1, F.slice(state["open"], -1, 1)).otherwise(none)
        kept = F.when(full, carried).otherwise(state["open"])
        left = F.when(full, F.coalesce(F.aggregate(carried, F.lit(0), lambda a, x: a + F.length(x)), F.lit(0))).otherwise(state["n"])
        return F.struct(chunks.alias("chunks"), F.concat(kept, F.array(s)).alias("open"), (left + F.length(s)).alias("n"))

    def close(state: Column) -> Column:
        rest = F.when(F.size(state["open"]) > 0, F.array(F.array_join(state["open"], " "))).otherwise(none)
        return F.concat(state["chunks"], rest)

    return F.aggregate(parts, start, take, close)


def chunk(df: DataFrame, key: str, text: str, size: int = 400, least: int = 30) -> DataFrame:
    """(key, chunk_id, text) of each chunk of at least `least` characters; ids count the shorter ones, too."""
    made = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(chunk_array(F.col(text), size)).alias("chunk_id", "_chunk"))
    return made.where(F.length("_chunk") >= least).select(key, F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("_chunk").alias(text))


def vector_id(source: Column, page: Column, doc: Column, part: Column) -> Column:
    """file|pPAGE|dDOC|cCHUNK, the file without its folders."""
    name = F.substring_index(F.substring_index(F.coalesce(source, F.lit("unknown")), "\\", -1), "/", -1)
    return F.format_string("%s|p%s|d%s|c%s", name, F.coalesce(page, F.lit(-1)).cast("string"), doc.cast("string"), part.cast("string"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: one aggregation with map-side combine, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, "_last.*")
