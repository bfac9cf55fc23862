"""Word counts over whole corpora, combined inside each task before anything moves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.runtime import collect_bounded

_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ̀-ॣॱ-῿Ⰰ-ⷿ㐀-퟿豈-﷿ﹰ-ﻼ"
#: Letters with their marks, in a row.
WORD = re.compile(f"[{_LETTERS}]+")
#: The same with single hyphens inside, as in compounds.
COMPOUND = re.compile(f"[{_LETTERS}]+(?:-[{_LETTERS}]+)*")

#: Distinct words that a task holds before it hands them on; a bound on memory only, counts are summed afterwards.
HELD = 500_000


def count_words(df: DataFrame, text: str, find: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(word, n) over all texts of df; null texts count nothing. find: the words of a text."""
    find = find or WORD.findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def give() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(find(t))
            if len(seen) > HELD:
                yield give()
        yield give()

    return df.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


#: Depths that one pass of `oversized` counts.
LEVELS = 6


def oversized(df: DataFrame, column: str, limit: int, first: int, step: int) -> set:
    """Prefixes (of `first` letters or bytes of the column, `first` + `step` and so on) that more than `limit` rows share,
    some of them longer ones. One pass counts LEVELS depths; another follows only for the rows below those that are
    still oversized at the deepest. At most rows / limit of each depth reach the driver."""
    depth, split, level = first, set(), df.select(F.col(column).alias("key"))
    kind = level.schema["key"].dataType.simpleString()
    plain = bytes if kind == "binary" else str
    while True:
        depths = [depth + step * i for i in range(LEVELS)]
        # a key counts at the depths that it reaches
        at = level.select("key", F.explode(F.array(*map(F.lit, depths))).alias("deep")).where(F.length("key") >= F.col("deep"))
        counts = at.groupBy("deep", F.expr("substring(key, 1, deep)").alias("prefix")).agg(F.count("*").alias("n"), F.max(F.length("key")).alias("longest"))
        rows = collect_bounded(counts.where((F.col("n") > limit) & (F.col("longest") > F.col("deep"))), 1_000_000, "oversized buckets")
        split |= {plain(r["prefix"]) for r in rows}
        deepest = [(r["prefix"],) for r in rows if r["deep"] == depths[-1]]
        if not deepest:
            return split
        held = F.broadcast(df.sparkSession.createDataFrame(deepest, f"_head {kind}"))
        level = level.join(held, F.substring("key", 1, depths[-1]) == F.col("_head"), "left_semi")
        depth = depths[-1] + step
