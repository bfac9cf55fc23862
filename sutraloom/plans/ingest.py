"""From a folder of PDF files to a cleaned corpus in JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutraloom.operators import pages
from sutraloom.runtime import cut_lineage
from sutraloom.sources import readers, writers

Decoder = Callable[[bytes], list[str]]


def decoded_corpus(files: DataFrame, decode_text: Decoder, decode_scanned: Decoder) -> DataFrame:
    """(source, page, content, error): pages by the text decoder; those of files without any visible text, or that it
    cannot read, by the one for scans. Each file is decoded once by either, and written before it is used again."""
    text = cut_lineage(readers.decoded_pages(files, decode_text))
    scanned = readers.scanned_sources(text).where("is_scanned").select(F.col("source").alias("path"))
    again = readers.decoded_pages(files.join(scanned, "path", "left_semi"), decode_scanned)
    return text.join(scanned, F.col("source") == F.col("path"), "left_anti").unionByName(again)


def ingest(spark: SparkSession, folder: str, out: str, lexicon: DataFrame, decode_text: Decoder, decode_scanned: Decoder, min_repeat: float = 0.3, mode: str = "error") -> DataFrame:
    """Writes (content, metadata of source, page, doc_name, entities) of every page below `folder` as JSON lines and
    gives (source, error) of the files that neither decoder could read."""
    decoded = cut_lineage(decoded_corpus(readers.pdf_files(spark, folder), decode_text, decode_scanned))
    rows = decoded.where(F.col("error").isNull()).select(F.struct("source", "page").alias("key"), "source", "content")
    clean = pages.clean_pages(rows, "key", "source", "content", pages.lexicon_terms(lexicon), min_repeat, lexicon)
    name = F.element_at(F.split("source", "/"), -1).alias("doc_name")
    writers.json_lines(clean.select("content", "source", "key.page", name, "entities"), out, mode)
    return decoded.where(F.col("error").isNotNull()).select("source", "error")
