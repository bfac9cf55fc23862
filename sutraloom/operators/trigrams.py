"""The vocabulary words that share the most trigrams with each asked word, counted over an inverted index of a block of the
vocabulary in a task: no pair of words that share a trigram becomes a row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.runtime import ship_package

#: Letters of words at most, on average, in a block of the vocabulary and in a shard of the asked words; letters of asked
#: words that are worth an index of their own, where cores would be idle otherwise.
LETTERS, WORTH = 4_000_000, 50_000
#: Trigrams at most that have a row of flags for all words, and the share (one in so many) of the words that must hold them.
FLAGGED, SPARSE = 200, 32


def word_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, numbers of their words) of words between # marks, a word's trigram once, by trigram and word. A trigram is
    its three code points, 21 bits each."""
    letters = np.frombuffer("".join([f"#{w}#" for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    at = np.arange(len(word)) + 2 * word  # a word has as many trigrams as letters, and two marks
    trigram = letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2]
    order = np.argsort(trigram, kind="stable")
    trigram, word = trigram[order], word[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (trigram[1:] != trigram[:-1]) | (word[1:] != word[:-1])
    return trigram[fresh], word[fresh]


def first_of(common: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest numbers over 0, the larger first, of equals the earlier."""
    most = common.max()
    least = (int(most) + 1) // 2
    while len(at := np.flatnonzero(common >= max(1, least))) < n and least > 1:
        least = (least + 1) // 2
    return at[np.argsort(most - common[at], kind="stable")[:n]]


class Index:
    """The numbers of the words that hold each trigram; for the most frequent trigrams a flag for each word, which is
    faster to add up."""

    def __init__(self, words: list[str]) -> None:
        self.n = len(words)
        trigram, self.words = word_trigrams(words)
        self.trigrams, starts = np.unique(trigram, return_index=True)
        self.bounds = np.append(starts, len(trigram))
        sizes = np.diff(self.bounds)
        self.flags: dict[int, np.ndarray] = {}
        for k in np.argsort(-sizes, kind="stable")[:FLAGGED]:
            if sizes[k] * SPARSE >= self.n:
                self.flags[int(k)] = np.zeros(self.n, np.uint8)
                self.flags[int(k)][self.words[self.bounds[k] : self.bounds[k + 1]]] = 1

    def best(self, asked: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the asked word, number of the word, trigrams in common) of the n words with the most, of equals the
        earlier ones; words without a trigram in common are left out."""
        trigram, word = word_trigrams(asked)
        k = np.searchsorted(self.trigrams, trigram)
        known = k < len(self.trigrams)
        known[known] = self.trigrams[k[known]] == trigram[known]
        order = np.argsort(word[known], kind="stable")
        k, word = k[known][order], word[known][order]
        ends = np.searchsorted(word, np.arange(len(asked) + 1)).tolist()
        found, shared, few = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(self.n, np.uint8)
        times = np.zeros(len(asked), np.int64)
        for i in range(len(asked)):
            own = k[ends[i] : ends[i + 1]].tolist()
            if not own:
                continue
            common = few if len(own) < 256 else np.zeros(self.n, np.int32)
            common.fill(0)
            for x in own:
                if (flags := self.flags.get(x)) is not None:
                    common += flags
                else:
                    common[self.words[self.bounds[x] : self.bounds[x + 1]]] += 1  # no word twice
            best = first_of(common, n)
            found.append(best)
            shared.append(common[best].astype(np.int64))
            times[i] = len(best)
        return np.repeat(np.arange(len(asked)), times), np.concatenate(found), np.concatenate(shared)


def best_candidates(asked: DataFrame, vocabulary: DataFrame, n: int) -> DataFrame:
    """(asked, candidate, common) of the n best words of each block of `vocabulary` (candidate) for each word of `asked`
    (asked); both hold each word once, without nulls. Every shard of the asked words meets every block."""
    ship_package(asked.sparkSession)
    letters = [d.agg(F.sum(F.length(d.columns[0]))).first()[0] or 0 for d in (asked, vocabulary)]
    blocks = max(1, math.ceil(letters[1] / LETTERS))
    idle = math.ceil(2 * asked.sparkSession.sparkContext.defaultParallelism / blocks)
    shards = max(1, math.ceil(letters[0] / LETTERS), min(idle, math.ceil(letters[0] / WORTH)))

    def part(word: str, parts: int):
        return F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")

    def every(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = asked.select("asked", part("asked", shards).alias("shard"), every(blocks).alias("block"))
    right = vocabulary.select("candidate", every(shards).alias("shard"), part("candidate", blocks).alias("block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        words = b.column("candidate").combine_chunks()
        words = words.take(pc.array_sort_indices(words))  # by code point
        asked = a.column("asked").combine_chunks()
        i, j, common = Index(words.to_pylist()).best(asked.to_pylist(), n) if len(asked) and len(words) else (np.zeros(0, np.int64),) * 3
        return pa.table({"asked": asked.take(pa.array(i)), "candidate": words.take(pa.array(j)), "common": common})

    tasks = 2 * shards * blocks  # a number that is named stays; few megabytes would be put into one task
    grid = [d.repartition(tasks, "shard", "block").groupBy("shard", "block") for d in (left, right)]
    return grid[0].cogroup(grid[1]).applyInArrow(run, "asked string, candidate string, common bigint")
