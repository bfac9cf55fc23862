"""Evaluation texts inside a corpus: which documents hold a passage of which test item.

Method: Wu-Manber multi-pattern search over words. The patterns are all windows of SEED words of the test items; a
table over blocks of two words tells how far the search may skip, a block that ends a pattern leads to the bucket of
patterns with that suffix, and direct comparison confirms an occurrence. Occurrences are then extended in both
directions with words changed, added or missing, and a stretch of LEAST words with at most one such word in PER is a
leak.

Why SEED words lose nothing: a stretch of 20 words with two words off has 18 words in at most three runs, so that one
run has 6 words or more, and the runs have at least NEED windows of 6 words between them. A longer stretch within the
same rate holds one of 20 words with two words off.

Scale: documents pass once. Up to BLOCK test items go out by broadcast as the tables of one matcher, and documents
stay in place. Beyond that, the items' windows lie in buckets by a hash of their words, dealt to tasks; what goes out
is one bit for each window, SLOT_BITS at most in all, by which the one pass over the documents skips the places where
no window can stand. The few places left meet the windows by hash, and direct comparison confirms them as before. Both
ways give the same rows.

Defined results: null and empty texts hold nothing; items of fewer than LEAST words cannot leak; repeated items each
give their row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sutraloom.runtime import collect_bounded, cut_lineage, map_columns

LEAST, PER = 20, 10
SEED, NEED = 6, 3
#: Most words off that are followed: four, in a stretch of 40 words.
ERRORS = 4
BLOCK = 4_000
#: Bits of the table of windows, as a power of two; more windows than bits only let more places through.
SLOT_BITS = 30

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


class Matcher:
    """Shift table, suffix buckets and items of one block of test texts."""

    def __init__(self, items: list[tuple[int, str]], m: int = SEED) -> None:
        self.m = m
        self.items = {i: words(t) for i, t in items if t}
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = defaultdict(dict)
        for i, w in self.items.items():
            if len(w) < LEAST:
                continue
            for at in range(len(w) - m + 1):
                window = tuple(w[at : at + m])
                for j in range(m - 1):
                    block = window[j : j + 2]
                    self.shift[block] = min(self.shift.get(block, m - 1), m - 2 - j)
                self.buckets[window[-2:]].setdefault(window, []).append((i, at))

    def seeds(self, w: list[str]) -> dict[int, list[tuple[int, int]]]:
        """item -> (position in the document, position in the item) of each pattern that occurs."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        m, shift, buckets, skip, n = self.m, self.shift.get, self.buckets, self.m - 1, len(w)
        at = m - 1  # the last word of the window
        while at < n:
            block = (w[at - 1], w[at])
            step = shift(block, skip)
            if step:
                at += step
                continue
            start = at - m + 1
            for i, j in buckets[block].get(tuple(w[start : at + 1]), ()):
                found[i].append((start, j))
            at += 1
        return found

    def leaks(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (first word in the document, words of the item, words off) of the longest passage of each."""
        w = words(text)
        out = {}
        if len(w) < LEAST - ERRORS:
            return out
        for i, hits in self.seeds(w).items():
            if len(hits) >= NEED and (best := passage(w, self.items[i], hits, self.m)):
                out[i] = best
        return out


def _reach(a: list[str], b: list[str], i: int, j: int, step: int, errors: int) -> list[tuple[int, int]]:
    """For 0..errors words off: the most words of b reached from (i, j) on, and of a; a reach ends in equal words."""
    best = [(0, 0)] * (errors + 1)
    stack, seen = [(i, j, 0)], set()
    while stack:
        x, y, e = stack.pop()
        if (x, y, e) in seen:
            continue
        seen.add((x, y, e))
        s = 0
        while 0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
            x, y, s = x + step, y + step, s + 1
        if s and abs(y - j) > best[e][0]:
            best[e] = (abs(y - j), abs(x - i))
        if e < errors:
            stack += [(x + step, y + step, e + 1), (x + step, y, e + 1), (x, y + step, e + 1)]
    for e in range(1, errors + 1):
        best[e] = max(best[e], best[e - 1])
    return best


def passage(doc: list[str], item: list[str], hits: list[tuple[int, int]], m: int = SEED) -> tuple[int, int, int] | None:
    """The longest passage of item in doc around the hits, where it is long and true enough."""
    best, done = None, set()
    present = set(hits)
    for i, j in hits:
        if (i - 1, j - 1) in present or (i, j) in done:
            continue
        run = m
        while (i + run - m + 1, j + run - m + 1) in present:
            run += 1
        left = _reach(doc, item, i - 1, j - 1, -1, ERRORS)
        right = _reach(doc, item, i + run, j + run, 1, ERRORS)
        for e1 in range(ERRORS + 1):
            for e2 in range(ERRORS + 1 - e1):
                length = left[e1][0] + run + right[e2][0]
                off = e1 + e2
                if length >= LEAST and off * PER <= length and (best is None or (length, -off) > (best[1], -best[2])):
                    best = (i - left[e1][1], length, off)
        done.add((i, j))
    return best


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, block: int = BLOCK) -> DataFrame:
    """(key, item key, first_word, n_words, n_off): the longest passage of each item in each document that holds one."""
    source = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    wanted = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull() & F.col("i").isNotNull())
    schema = f"k {source.schema['_k'].dataType.simpleString()}, i {wanted.schema['i'].dataType.simpleString()}, first_word int, n_words int, n_off int"
    found = _with_matcher(source, wanted, schema, block) if wanted.count() <= block else _with_buckets(source, wanted, schema)
    return found.withColumnsRenamed({"k": key, "i": item_key})


def _with_matcher(source: DataFrame, wanted: DataFrame, schema: str, block: int) -> DataFrame:
    rows = collect_bounded(wanted, block, "test items")
    held = source.sparkSession.sparkContext.broadcast(Matcher([(r["i"], r["t"]) for r in rows]))

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        matcher = held.value
        out: dict[str, list] = {c: [] for c in ("k", "i", "first_word", "n_words", "n_off")}
        for k, t in zip(cols["_k"], cols["_t"]):
            for i, passage in matcher.leaks(t).items() if t else ():
                for name, v in zip(out, (k, i, *passage)):
                    out[name].append(v)
        return out

    return map_columns(source, kernel, schema)


def window_hashes(w: list[str], m: int = SEED) -> np.ndarray:
    """A hash of each m words in a row, without their order lost."""
    n = len(w) - m + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    one = np.array([xxhash.xxh3_64_intdigest(x) for x in w], dtype=np.uint64)
    made = np.zeros(n, dtype=np.uint64)
    for k in range(m):
        made = made * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
    made ^= made >> np.uint64(29)
    return (made * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _with_buckets(source: DataFrame, wanted: DataFrame, schema: str) -> DataFrame:
    spark = source.sparkSession

    def windows_of(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"h": [], "i": [], "at": []}
        for i, t in zip(cols["i"], cols["t"]):
            if len(w := words(t)) >= LEAST:
                hashes = window_hashes(w).tolist()
                out["h"] += hashes
                out["i"] += [i] * len(hashes)
                out["at"] += range(len(hashes))
        return out

    item_type = wanted.schema["i"].dataType.simpleString()
    windows = cut_lineage(map_columns(wanted, windows_of, f"h bigint, i {item_type}, at int"))
    bits = min(SLOT_BITS, max(10, (16 * max(1, windows.count())).bit_length()))
    table = spark.sparkContext.broadcast(_slot_table(windows, bits))

    def places(cols: dict[str, list]) -> dict[str, list]:
        flags = np.frombuffer(table.value, dtype=np.uint8)
        out: dict[str, list] = {"h": [], "d": [], "pos": []}
        for d, t in zip(cols["d"], cols["_t"]):
            hashes = window_hashes(words(t))
            slots = _slots(hashes, bits)
            hits = np.flatnonzero((flags[slots >> 3] >> (slots & 7)) & 1)
            if len(hits) >= NEED:
                out["h"] += hashes[hits].tolist()
                out["d"] += [d] * len(hits)
                out["pos"] += hits.tolist()
        return out

    texts = source.where(F.col("_t").isNotNull()).withColumn("d", F.md5("_t"))
    found = map_columns(texts.select("d", "_t"), places, "h bigint, d string, pos int").distinct()
    pairs = found.join(windows, "h").groupBy("d", "i").agg(F.collect_list(F.struct("pos", "at")).alias("hits")).where(F.size("hits") >= NEED)
    pairs = cut_lineage(pairs)
    held = texts.select("d", "_t").join(pairs.select("d").distinct(), "d", "left_semi").dropDuplicates(["d"])

    def confirm(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("d", "i", "first_word", "n_words", "n_off")}
        for d, i, t, item, hits in zip(cols["d"], cols["i"], cols["_t"], cols["t"], cols["hits"]):
            doc, want = words(t), words(item)
            same = sorted((h["pos"], h["at"]) for h in hits if doc[h["pos"] : h["pos"] + SEED] == want[h["at"] : h["at"] + SEED])
            if len(same) >= NEED and (best := passage(doc, want, same)):
                for name, v in zip(out, (d, i, *best)):
                    out[name].append(v)
        return out

    asked = pairs.join(held, "d").join(wanted, "i").select("d", "i", "_t", "t", "hits")
    sure = map_columns(asked, confirm, f"d string, i {item_type}, first_word int, n_words int, n_off int").distinct()
    return texts.select(F.col("_k").alias("k"), "d").join(sure, "d").select(*[f.name for f in StructType.fromDDL(schema).fields])


def _slot_table(windows: DataFrame, bits: int) -> bytes:
    """One bit for each window's slot. Tasks make the bits of CHUNK bytes each; the driver puts these in a row."""
    size = 1 << max(0, bits - 3)
    chunk = min(size, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            slots = _slots(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            for part in np.unique(slots // (8 * chunk)).tolist():
                mine = slots[slots // (8 * chunk) == part] - part * 8 * chunk
                flags = parts.setdefault(part, np.zeros(chunk, dtype=np.uint8))
                np.bitwise_or.at(flags, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], names=["part", "flags"])

    # windows of one part of the table in one task, so that each part comes to the driver once
    dealt = windows.select("h").repartition(F.shiftrightunsigned("h", 64 - bits + (8 * chunk).bit_length() - 1))
    out = bytearray(size)
    for r in dealt.mapInArrow(run, "part bigint, flags binary").toLocalIterator():
        at = r["part"] * chunk
        mine = np.frombuffer(bytes(out[at : at + chunk]), dtype=np.uint8) | np.frombuffer(r["flags"], dtype=np.uint8)
        out[at : at + chunk] = mine.tobytes()
    return bytes(out)
