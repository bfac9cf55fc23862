"""Writers: JSON lines, CSV, vocabularies and vector tables in which the last row of an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.operators.chunks import last_wins


def json_lines(records: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, in UTF-8; flat source, page, doc_name and entities go back under `metadata`."""
    meta = [c for c in ("source", "page", "doc_name", "entities") if c in records.columns]
    rest = [c for c in records.columns if c not in meta]
    made = records.select(*rest, F.struct(*meta).alias("metadata")) if meta else records
    made.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("header", "true").csv(path)


def vectors(rows: DataFrame, path: str, key: str = "id", order: str = "seq", mode: str = "error") -> None:
    """A new vector table with the last row of each id."""
    last_wins(rows, [key], [order]).write.mode(mode).parquet(path)


def upserted_vectors(rows: DataFrame, old: DataFrame, path: str, key: str = "id", order: str = "seq", mode: str = "error") -> None:
    """A vector table with the rows of an old one and further rows; the last row of each id wins. The old table is not
    written over, so that a failed job leaves it whole."""
    vectors(old.unionByName(rows), path, key, order, mode)


def vocabulary_json(words: DataFrame, path: str, word: str = "word", freq: str = "freq", mode: str = "error") -> None:
    """Word and frequency as one JSON object per line, which readers.vocabulary_file reads back; a vocabulary may be
    larger than one task holds."""
    words.select(F.col(word).alias("word"), F.col(freq).alias("freq")).write.mode(mode).json(path)
