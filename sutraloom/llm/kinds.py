"""Per-document text statistics and the text's kind: prose, list, table or junk.

Method: thresholds on the statistics are noisy labelling functions, each of which names the kinds that it speaks
for. How well each one tells the kinds apart is learned, without labels, by expectation-maximization on their
agreements over all documents; the output is the posterior of each kind.

Scale: a document is reduced to its vote pattern; patterns are counted by a partial aggregation, and there are at
most VOTES ** FUNCTIONS of them (a few hundred occur), whatever the size of the corpus. Only these counts reach the
driver, where the few parameters are fitted; the posteriors go back by a broadcast of the patterns.

Defined results: null and blank texts have null statistics, kind and posterior. Garbled text is judged as restored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.llm import encoding, lookalikes
from sutraloom.llm.words import WORD
from sutraloom.runtime import collect_bounded, cut_lineage, map_columns

KINDS = ("prose", "list", "table", "junk")

_MARKER = re.compile(r"\s*(?:[-–—*•·◦▪‣+]|\(?\d{1,4}[.)\]]|\(?[a-z][.)])\s+[^\W\d_]")
_SENTENCE_END = re.compile(r"[^\W\d_]['’”\")]*[.!?।॥|…](?=\s|$)")
_LINE_END = tuple(".!?…:;,।॥|")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_VOWEL = re.compile(r"[aeiouyAEIOUYÀ-ÖØ-öø-ÿāīūṛṝḷĀĪŪṚऀ-ॿͰ-Ͽ]")
_CASE_MIX = re.compile(r"[a-z][A-Z]|[A-Za-z][0-9][A-Za-z]")


@lru_cache(maxsize=200_000)
def _shapely(word: str) -> bool:
    """Whether a lower-case word has the shape of words: a vowel, a readable length."""
    return 2 <= len(word) <= 24 and bool(_VOWEL.search(word)) or word in ("a", "i", "o", "y", "e")


def _cells(line: str) -> tuple[int, int, int, int, int]:
    """Column marks of a line by kind: tabs, pipes, semicolons, commas, gaps. Marks of running text (a blank after
    comma or semicolon, a verse bar at the end) are none."""
    pipes = line.count("|")
    return (
        line.count("\t"),
        pipes if pipes >= 2 and "||" not in line else 0,
        line.count(";") - line.count("; "),
        line.count(",") - line.count(", "),
        len(_GAP.findall(line)) if "  " in line else 0,
    )


def statistics(text: str, common: frozenset[str]) -> dict[str, float]:
    """The statistics of a text that has a visible character."""
    lines = [x for x in text.split("\n") if x.strip()]
    words = WORD.findall(text.lower())
    n, letters = len(words), sum(map(len, words))
    solid = len(text) - sum(map(text.count, " \n\t\r\u00a0")) or 1
    digits = sum(map(text.count, "0123456789"))
    seen = Counter(words)
    best_cells = 0.0
    if len(lines) > 1:
        for column in zip(*map(_cells, lines)):
            tally = Counter(column)
            tally.pop(0, None)
            if tally:
                best_cells = max(best_cells, max(tally.values()) / len(lines))
    ends = len(_SENTENCE_END.findall(text))
    common_share = sum([c for w, c in seen.items() if w in common]) / n if n else 0.0
    return {
        "n_words": n,
        "mean_word_len": letters / n if n else 0.0,
        "symbol_share": max(0, solid - letters - digits) / solid,
        "punct_line_share": sum([x.rstrip(" \t\r'’”\")»").endswith(_LINE_END) for x in lines]) / len(lines),
        "common_share": common_share,
        "marker_share": sum([_MARKER.match(x) is not None for x in lines]) / len(lines),
        "item_share": sum([len(x) <= 48 and x.count(" ") <= 6 and not _SENTENCE_END.search(x) for x in lines]) / len(lines),
        "cell_share": best_cells,
        "shape_share": sum([c for w, c in seen.items() if _shapely(w)]) / n if n else 0.0,
        "distinct_share": len(seen) / n if n else 0.0,
        "sentence_rate": ends / max(1.0, n / 40),
        "words_per_line": n / len(lines),
        "mixed_share": len(_CASE_MIX.findall(text)) / max(1, n) if common_share < 0.1 else 0.0,
        "digit_share": digits / solid,
    }


STATS = ("n_words", "mean_word_len", "symbol_share", "punct_line_share", "common_share", "marker_share", "item_share", "cell_share", "shape_share", "distinct_share", "sentence_rate", "words_per_line", "mixed_share", "digit_share")

# Each labelling function: name -> list of (condition on the statistics, kinds that it speaks for); the first that
# holds is its vote, the number of the list's end its abstention.
FUNCTIONS: dict[str, list] = {
    "common words": [
        (lambda s: s["common_share"] >= 0.18, {"prose"}),
        (lambda s: s["common_share"] <= 0.04, {"list", "table", "junk"}),
    ],
    "sentence ends": [
        (lambda s: s["sentence_rate"] >= 0.8, {"prose"}),
        (lambda s: s["sentence_rate"] <= 0.1, {"list", "table", "junk"}),
    ],
    "line ends": [
        (lambda s: s["punct_line_share"] >= 0.6 and s["words_per_line"] > 6, {"prose"}),
        (lambda s: s["punct_line_share"] <= 0.05, {"list", "table", "junk"}),
    ],
    "items": [
        (lambda s: s["item_share"] >= 0.75 and s["cell_share"] < 0.6, {"list"}),
        (lambda s: s["item_share"] <= 0.3, {"prose", "junk"}),
    ],
    "markers": [
        (lambda s: s["marker_share"] >= 0.75, {"list"}),
        (lambda s: s["marker_share"] <= 0.05, {"prose", "list", "table", "junk"}),
    ],
    "columns": [
        (lambda s: s["cell_share"] >= 0.75 and s["marker_share"] < 0.5, {"table"}),
        (lambda s: s["cell_share"] <= 0.25, {"prose", "list", "junk"}),
    ],
    "word shapes": [
        (lambda s: s["shape_share"] >= 0.85, {"prose", "list", "table"}),
        (lambda s: s["shape_share"] <= 0.6 and s["cell_share"] < 0.6, {"junk"}),
    ],
    "symbols": [
        (lambda s: s["symbol_share"] >= 0.3 and s["cell_share"] < 0.6, {"junk"}),
        (lambda s: s["symbol_share"] <= 0.08, {"prose", "list", "table"}),
    ],
    "variety": [
        (lambda s: s["distinct_share"] <= 0.12 and s["n_words"] >= 12 and s["words_per_line"] > 6, {"junk"}),
    ],
    "words in a line": [
        (lambda s: s["words_per_line"] >= 6, {"prose", "junk"}),
        (lambda s: s["words_per_line"] <= 4, {"list", "table", "junk"}),
    ],
    "digits": [
        (lambda s: s["digit_share"] >= 0.5 and s["cell_share"] < 0.6, {"junk"}),
        (lambda s: s["digit_share"] <= 0.05, {"prose", "list", "junk"}),
    ],
    "word length": [
        (lambda s: s["mean_word_len"] < 2.4 or s["mean_word_len"] > 14 or s["mixed_share"] > 0.25 or s["n_words"] == 0, {"junk"}),
        (lambda s: 3 <= s["mean_word_len"] <= 10, {"prose", "list", "table"}),
    ],
}


def votes(stats: dict[str, float]) -> str:
    """One digit for each labelling function."""
    out = []
    for cases in FUNCTIONS.values():
        for i, (holds, _) in enumerate(cases):
            if holds(stats):
                out.append(str(i))
                break
        else:
            out.append(str(len(cases)))
    return "".join(out)


def fit(patterns: dict[str, int], rounds: int = 60, smooth: float = 0.5) -> dict[str, list[float]]:
    """Posterior of the kinds for each vote pattern, by expectation-maximization from the functions' own claims."""
    cases = list(FUNCTIONS.values())
    sizes = [len(c) + 1 for c in cases]
    prior = [0.7, 0.1, 0.1, 0.1]
    table = [[[0.0] * size for _ in KINDS] for size in sizes]
    for j, c in enumerate(cases):
        for k, kind in enumerate(KINDS):
            weights = [0.8 if kind in claim else 0.05 for _, claim in c] + [0.3]
            table[j][k] = [w / sum(weights) for w in weights]
    posterior: dict[str, list[float]] = {}
    for _ in range(rounds):
        log = [[[math.log(v) for v in row] for row in t] for t in table]
        base = [math.log(p) for p in prior]
        change = 0.0
        for p in patterns:
            score = [base[k] + sum(log[j][k][int(v)] for j, v in enumerate(p)) for k in range(len(KINDS))]
            top = max(score)
            raw = [math.exp(x - top) for x in score]
            now = [x / sum(raw) for x in raw]
            change = max(change, max(abs(a - b) for a, b in zip(now, posterior.get(p, [0.0] * 4))))
            posterior[p] = now
        mass = [sum(n * posterior[p][k] for p, n in patterns.items()) + 1.0 for k in range(len(KINDS))]
        prior = [m / sum(mass) for m in mass]
        for j, size in enumerate(sizes):
            for k in range(len(KINDS)):
                # the functions' claims stay as a weak prior, so that a kind keeps its meaning where it is rare
                claims = [0.8 if KINDS[k] in claim else 0.05 for _, claim in cases[j]] + [0.3]
                row = [smooth * 20 * c / sum(claims) for c in claims]
                for p, n in patterns.items():
                    row[int(p[j])] += n * posterior[p][k]
                table[j][k] = [v / sum(row) for v in row]
        if change < 1e-6:
            break
    return posterior


def common_words(df: DataFrame, word: str = "word", limit: int = 20_000) -> frozenset[str]:
    """The list of frequent function words; a fixed table, its size is checked."""
    return frozenset(r[0].lower() for r in collect_bounded(df.select(word).where(F.col(word).isNotNull()).distinct(), limit, "common words"))


def describe(df: DataFrame, key: str, text: str, common: frozenset[str]) -> DataFrame:
    """(key, statistics, pattern) of each record with a visible character."""
    key_type = df.schema[key].dataType.simpleString()

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {key: [], **{s: [] for s in STATS}, "pattern": []}
        for k, t in zip(cols[key], cols[text]):
            if t is None or not t.strip():
                continue
            if not t.isascii():
                # a lost character stands for a letter that was there
                t = lookalikes.normalise(encoding.restore(t)[0]).replace(encoding.LOST, "e")
            stats = statistics(t, common)
            out[key].append(k)
            for s in STATS:
                out[s].append(float(stats[s]))
            out["pattern"].append(votes(stats))
        return out

    schema = f"`{key}` {key_type}, " + ", ".join(f"{s} double" for s in STATS) + ", pattern string"
    return map_columns(df.select(key, text), kernel, schema)


def classify(df: DataFrame, key: str, text: str, common: frozenset[str]) -> DataFrame:
    """(key, statistics, kind, confidence, p_prose, p_list, p_table, p_junk) of each record with a visible character."""
    described = cut_lineage(describe(df, key, text, common))
    counted = described.groupBy("pattern").agg(F.count("*").alias("n"))
    patterns = {r["pattern"]: r["n"] for r in collect_bounded(counted, 200_000, "vote patterns")}
    posterior = fit(patterns)
    spark = df.sparkSession
    rows = [(p, KINDS[max(range(4), key=lambda k: q[k])], float(max(q)), *map(float, q)) for p, q in posterior.items()]
    side = spark.createDataFrame(rows, "pattern string, kind string, confidence double, " + ", ".join(f"p_{k} double" for k in KINDS))
    return described.join(F.broadcast(side), "pattern").drop("pattern")
