"""Unicode forms, for which the JVM has no column function: Arrow batches to Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def without_accents(s: pd.Series) -> pd.Series:
    """Letters without their marks; null stays null."""
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def with_nfkc(df: DataFrame, column: str) -> DataFrame:
    """df with a string column in compatibility composition: the column function as a step of its own, for columns that
    come out of higher-order functions, whose results a Python function cannot take inside one projection."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(made, b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
