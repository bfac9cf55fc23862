"""Readers: JSON lines with positions, required CSV columns, word lists, lexicons, PDF files, and decoding plug points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sutraloom.functions import text as T
from sutraloom.runtime import with_position


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of all PDF files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)


def decoded_pages(files: DataFrame, decode: Callable[[bytes], list[str]]) -> DataFrame:
    """(source, page from 1, content, error): pages of files by a decoder that the caller brings (PDF text or OCR). Files
    stream through in batches; a file that cannot be decoded gives one row without a page, with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(decode(content), 1)]
                except Exception as e:  # a broken file must not end the scan
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source", "page", "content", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "source string, page int, content string, error string")


def scanned_sources(pages: DataFrame, source: str = "source", text: str = "content") -> DataFrame:
    """(source, is_scanned): sources without any page of visible text."""
    return pages.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg((~F.coalesce(F.bool_or(T.strip(F.col(text)) != ""), F.lit(False))).alias("is_scanned"))


_RECORD = S.StructType([
    S.StructField("content", S.StringType()), S.StructField("text", S.StringType()),
    S.StructField("metadata", S.StructType([S.StructField("source", S.StringType()), S.StructField("page", S.IntegerType()), S.StructField("entities", S.ArrayType(S.StringType()))])),
])


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, source, page) of a file of JSON lines: doc_id is the line's position from 0, lines that are no
    object are counted but left out; `content`, else `text`, else nothing; source `unknown` and page -1 where missing.

    Positions: lines are numbered inside their file part, after the lines of the parts before it."""
    record = F.from_json(F.col("value"), _RECORD)
    parsed = with_position(spark.read.text(path), "doc_id").where(F.regexp_like("value", F.lit(r"^\s*\{"))).withColumn("r", record)
    blank = lambda c: F.when(c != "", c)
    return parsed.select(
        "doc_id",
        F.coalesce(blank(F.col("r.content")), blank(F.col("r.text")), F.lit("")).alias("text"),
        F.coalesce("r.metadata.source", F.lit("unknown")).alias("source"), F.coalesce("r.metadata.page", F.lit(-1)).alias("page"),
    )


def csv_strings(spark: SparkSession, path: str, required: str) -> DataFrame:
    """All columns as strings, nulls as empty; ValueError where the required column is missing."""
    rows = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    if required not in rows.columns:
        raise ValueError(f"{path}: no column {required}")
    return rows.na.fill("")


def word_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, canonical, variants) of a JSON object of name lists, in the file's order."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).select("ord", F.col("e.key").alias("canonical"), F.col("e.value").alias("variants"))


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of `word<TAB>frequency` lines, or of JSON lines with `word` and `freq`, as writers.vocabulary_json
    makes them; frequency 1 where missing."""
    if path.rstrip("/").endswith(".json"):
        rows = spark.read.schema("word string, freq int").json(path).where(F.col("word").isNotNull())
        return rows.select("word", F.coalesce("freq", F.lit(1)).alias("freq"))
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(T.strip(F.col("value")) != "")
    return rows.select(T.strip(F.get(parts, F.lit(0))).alias("word"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(1)).alias("freq"))


def vocabulary_object(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of a JSON file of one object with `vocab` and `frequencies`; it is read in one task."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "vocab array<string>, frequencies map<string,int>").alias("v"))
    words = whole.select("v.frequencies", F.explode("v.vocab").alias("word"))
    return words.select("word", F.coalesce(F.try_element_at("frequencies", F.col("word")), F.lit(1)).alias("freq"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "epoch int, accuracy double, learning_rate double, loss double, val_accuracy double, val_loss double"
    return spark.read.option("header", "true").schema(schema).csv(path)
