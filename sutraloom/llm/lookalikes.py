"""Text that looks the same but differs in its characters: bring it into one form.

Method: the distinct words of the corpus that are stored in plain characters form vocabulary tries. Every word that
holds a special character is walked through the trie of its bucket with a weighted edit automaton, for which
look-alike letters (some have several readings), other widths and styles, and ignorable characters cost nothing; the
cheapest (then most frequent, then first) vocabulary word is its canonical spelling. Words without a match are
normalised by the character table.

Scale: plain and special words meet by bucket, a prefix of the letters without accents, that is split by further
letters while it holds too many words; special words go to the bucket of each of their readings. A task holds one trie
at a time. Only spellings that differ from the table's leave the tries; up to LOOKUP_ROWS of them are broadcast and
texts are rewritten in place, beyond that the few texts that may change get theirs by a join.

Kept apart: spans garbled by a wrong encoding (encoding.py) and words wholly in another alphabet stay as they are.
Joiners between Indic letters, tabs and line ends stay. Defined results: null gives null, empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.llm import encoding
from sutraloom.llm.words import WORD, count_words, oversized
from sutraloom.runtime import LOOKUP_ROWS, cut_lineage, fresh_name, map_columns

# Letters of other alphabets and phonetic letters, with the Latin letter that each looks like.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "г": "r", "п": "n", "ь": "b", "в": "b", "н": "h",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q",
    "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "ү": "y", "Ԍ": "G", "Ɩ": "I", "Ӏ": "I",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o",
    "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "μ": "u", "ϱ": "p", "ς": "s",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʋ": "v", "ʏ": "y", "ʀ": "r", "ɴ": "n", "ʟ": "l", "ʙ": "b", "ɢ": "g", "ʜ": "h",
    "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ⅼ": "l", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮃ": "W",
}
# Letters that have another reading beside that in LOOKALIKES; which one holds, the vocabulary decides.
ALSO = {
    "ν": "n", "η": "h", "σ": "s", "ρ": "r", "υ": "v", "γ": "v", "μ": "m", "χ": "k", "ς": "c", "Ρ": "R", "Η": "E", "Υ": "U", "Χ": "K",
    "г": "g", "п": "p", "в": "v", "н": "n", "с": "s", "у": "u", "р": "r", "х": "h", "ӏ": "i", "В": "V", "Н": "N", "С": "S", "Р": "R", "У": "U", "Х": "H", "І": "l", "Ӏ": "l",
    "ʋ": "u", "ʏ": "u", "ʜ": "n", "ո": "o", "ց": "y", "զ": "g",
}
# Characters that show nothing.
IGNORABLE = "­͏᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# Spaces other than the plain one.
SPACES = "               　"
_JOINERS = "‌‍"

#: Any text that may need a change holds a character of these, or one of _DOTTED.
SUSPECT_RANGES = (
    (0x00A0, 0x00A0), (0x00AD, 0x00AD), (0x0132, 0x0133), (0x0149, 0x0149), (0x017F, 0x017F), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0250, 0x02AF),
    (0x0300, 0x036F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x0531, 0x0587), (0x1680, 0x1680), (0x180E, 0x180E),
    (0x13A0, 0x13FF), (0x1D00, 0x1DBF), (0x2000, 0x200F), (0x202A, 0x202F), (0x205F, 0x206F), (0x2100, 0x218F), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFE00, 0xFE0F),
    (0xFE50, 0xFE6F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1D400, 0x1D7FF),
)


# Fixed value: Indic letters that form one character with the mark below them; the mark is common after others.
_DOTTED = "[नरळ]\u093c"
SUSPECT = re.compile("[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in SUSPECT_RANGES) + f"]|{_DOTTED}")


def may_change(text: str | None) -> bool:
    return text is not None and not text.isascii() and SUSPECT.search(text) is not None


@lru_cache(maxsize=65536)
def plain_form(c: str) -> str | None:
    """The plain characters that c is another width, style or fusion of; None for all others. What visibly differs
    (raised digits, fractions, circled letters, signs such as the ellipsis) is none of these."""
    parts = unicodedata.decomposition(c).split()
    if not parts or not parts[0].startswith("<"):
        return None
    kind, plain = parts[0], unicodedata.normalize("NFKC", c)
    if kind in ("<wide>", "<narrow>", "<font>"):
        return plain
    if kind == "<compat>" and all(x.isalpha() and x < "ɐ" or x == "'" for x in plain) and c.isalpha():
        return plain
    return None


@lru_cache(maxsize=65536)
def _indic(c: str) -> bool:
    return "ऀ" <= c <= "෿"


@lru_cache(maxsize=65536)
def _latin(c: str) -> bool:
    p = plain_form(c) or c
    return p[0].isalpha() and (p[0] < "ɐ" or "Ḁ" <= p[0] <= "ỿ" or "Ⱡ" <= p[0] <= "Ɀ")


def _composed(base: str) -> str:
    return unicodedata.normalize("NFC", base)


def _compose(word: str) -> str:
    """Marks joined with their letters wherever one character exists; letters that are composed already, and those
    that composition would take apart, stay."""
    if word.isascii():
        return word
    made, i, n = [], 0, len(word)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(word[j]):
            j += 1
        piece = word[i:j]
        if j > i + 1:
            whole = _composed(piece)
            made.append(whole if len(whole) < len(piece) else piece)
        else:
            made.append(piece)
        i = j
    return "".join(made)


#: Letters, marks and ignorables in a row: what counts as one word for look-alikes.
_WORD = re.compile(r"(?:[^\W\d_]|[̀-ͯऀ-ॣ़​-‏­⁠-⁤﻿᠎͏])+")


def clean_word(word: str) -> str:
    """A word by the table alone: widths, styles and fusions, ignorables, look-alikes in Latin words, composition."""
    out, n = [], len(word)
    latin = any(_latin(c) for c in word)
    for i, c in enumerate(word):
        if c in IGNORABLE:
            if c in _JOINERS and 0 < i < n - 1 and _indic(word[i - 1]) and _indic(word[i + 1]):
                out.append(c)
            continue
        if (p := plain_form(c)) is not None:
            out.append(p)
        elif latin and c in LOOKALIKES:
            out.append(LOOKALIKES[c])
        else:
            out.append(c)
    return _compose("".join(out))


def _clean_rest(text: str) -> str:
    """Characters between words: spaces, widths of signs and digits, invisible characters."""
    if text.isascii():
        return text
    return "".join(" " if c in SPACES else "" if c in IGNORABLE else (plain_form(c) or c) for c in text)


def normalise(text: str, spelling: dict[str, str] | None = None) -> str:
    """Text in plain characters. spelling: canonical spellings found in the tries; others go by the table."""
    if not may_change(text):
        return text
    spelling = spelling or {}

    def fix(m: re.Match) -> str:
        w = m.group(0)
        if w.isascii():
            return w
        return spelling.get(w) or clean_word(w)

    done = []
    for piece, garbled in encoding.outside(text):
        if garbled:
            done.append(piece)
            continue
        at = 0
        for m in _WORD.finditer(piece):
            done += [_clean_rest(piece[at : m.start()]), fix(m)]
            at = m.end()
        done.append(_clean_rest(piece[at:]))
    return "".join(done)


def special_words(text: str) -> set[str]:
    """Words of a text that hold a character which the table would change."""
    found = set()
    if not may_change(text):
        return found
    for piece, garbled in encoding.outside(text):
        if not garbled and SUSPECT.search(piece):
            for w in _WORD.findall(piece):
                if not w.isascii() and SUSPECT.search(w) and clean_word(w) != w:
                    found.add(w)
    return found


# --- the tries and their automaton ---------------------------------------------------------------------------------


#: Letters that name a bucket, letters by which one is split, and words that it may hold.
HEAD, STEP, LIMIT = 4, 2, 20_000
#: Cost of reading a letter as in ALSO.
SECOND = 0.25


class Trie:
    """Vocabulary words with their counts; children by character."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, int] | None] = [None]

    def add(self, word: str, count: int) -> None:
        at = 0
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                to = len(self.next)
                self.next[at][c] = to
                self.next.append({})
                self.end.append(None)
            at = to
        self.end[at] = (word, count)

    def best(self, word: str) -> tuple[float, int, str] | None:
        """(cost, count below zero, word) of the cheapest vocabulary word, then the most frequent, then the first in
        code-point order."""
        # a state of the automaton: (position in word, trie node) -> cost
        latin = any(_latin(c) for c in word)
        layer = {(0, 0): 0.0}
        queue, n, ends = [(0, 0)], len(word), []
        while queue:
            i, node = queue.pop()
            cost = layer[i, node]
            if i == n:
                if self.end[node]:
                    ends.append((cost, -self.end[node][1], self.end[node][0]))
                continue
            for text, step, price in readings(word, i, latin):
                at: int | None = node
                for c in text:
                    at = self.next[at].get(c)
                    if at is None:
                        break
                if at is not None and cost + price < layer.get((i + step, at), float("inf")):
                    layer[(i + step, at)] = cost + price
                    queue.append((i + step, at))
        return min(ends) if ends else None


def readings(word: str, i: int, latin: bool) -> Iterator[tuple[str, int, float]]:
    """What the automaton may read at position i: (plain text, characters used, cost)."""
    c = word[i]
    yield c, 1, 0.0
    if c in IGNORABLE:
        yield "", 1, 0.0
    letters = [(p, 0.0)] if (p := plain_form(c)) is not None else []
    if latin and c in LOOKALIKES:
        letters.append((LOOKALIKES[c], 0.0))
        letters += [(x, SECOND) for x in ALSO.get(c, "")]
    for x, price in letters:
        yield x, 1, price
    j = i + 1
    while j < len(word) and (unicodedata.combining(word[j]) or word[j] in IGNORABLE):
        j += 1
    if j > i + 1:  # a letter with its marks as one character
        marks = "".join(x for x in word[i + 1 : j] if x not in IGNORABLE)
        for base, price in letters or [(c, 0.0)]:
            whole = _composed(base + marks)
            if len(whole) == 1:
                yield whole, j - i, price


def _bare(word: str) -> str:
    """A plain word without accents, in lower case: the same for all words that can match."""
    folded = unicodedata.normalize("NFD", word).lower()
    return folded if folded.isascii() else "".join([c for c in folded if not unicodedata.combining(c)])


def bucket_of(bare: str, split: frozenset[str]) -> str:
    """The bucket of a plain word: its first letters, more of them while that bucket is split."""
    depth = HEAD
    while bare[:depth] in split and depth < len(bare):
        depth += STEP
    return bare[:depth]


def buckets_of(word: str, split: frozenset[str]) -> set[str]:
    """The buckets of all readings of a special word."""
    latin = any(_latin(c) for c in word)
    found, seen, stack = set(), set(), [(0, "")]
    while stack:
        i, bare = stack.pop()
        if (i, bare) in seen:
            continue
        seen.add((i, bare))
        at = bucket_of(bare, split)
        if i == len(word) or len(at) >= HEAD and len(at) < len(bare) and at not in split:
            found.add(at)  # what follows is in no bucket's name
            continue
        # the vocabulary has no special characters
        stack += [(i + step, bare + _bare(text)) for text, step, _ in readings(word, i, latin) if not SUSPECT.search(text)]
    return found


# --- on tables -------------------------------------------------------------------------------------------------------


def spellings(df: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    """(word, canonical): the canonical spelling of each special word that the vocabulary has in another spelling than
    the table gives.

    One pass counts plain and special words inside each task before they move. Both meet by bucket; no vocabulary
    reaches the driver.
    """

    def words_of(text: str) -> list[str]:
        plain = WORD.findall(text)
        if may_change(text):
            return [w for w in plain if w.isascii() or not SUSPECT.search(w)] + [_DIRTY + w for w in special_words(text)]
        return plain

    def bare_of(cols: dict[str, list]) -> dict[str, list]:
        return {"word": cols["word"], "n": cols["n"], "bare": [_bare(clean_word(w[1:]) if w.startswith(_DIRTY) else w) for w in cols["word"]]}

    counted = cut_lineage(map_columns(count_words(df, text, words_of), bare_of, "word string, n bigint, bare string"))
    split = df.sparkSession.sparkContext.broadcast(frozenset(oversized(counted, "bare", limit, HEAD, STEP)))

    def place(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("word", "n", "bucket", "plain")}
        for w, n, bare in zip(cols["word"], cols["n"], cols["bare"]):
            special = w.startswith(_DIRTY)
            for at in buckets_of(w[1:], split.value) if special else (bucket_of(bare, split.value),):
                for name, v in zip(out, (w.removeprefix(_DIRTY), n, at, not special)):
                    out[name].append(v)
        return out

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, special, trie, rows = None, [], Trie(), []

        def found() -> list[tuple]:
            got = [(w, trie.best(w)) for w in special]
            return [(w, cost, less, canon, canon != clean_word(w)) for w, best in got if best for cost, less, canon in [best]]

        for b in batches:
            for w, n, at, plain in zip(*(b.column(i).to_pylist() for i in range(4))):
                if at != now:
                    rows += found()
                    now, special, trie = at, [], Trie()
                if not plain:
                    special.append(w)
                elif special:
                    trie.add(w, n)
            yield _rows(rows)
            rows = []
        yield _rows(found())

    placed = map_columns(counted, place, "word string, n bigint, bucket string, plain boolean")
    met = placed.repartition(F.col("bucket")).sortWithinPartitions("bucket", "plain").mapInArrow(match, "word string, cost double, less bigint, canonical string, other boolean")
    best = met.groupBy("word").agg(F.min(F.struct("cost", "less", "canonical", "other")).alias("best"))
    return best.where("best.other").select("word", "best.canonical")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["word", "cost", "less", "canonical", "other"])


#: Marks the special words in the one count of plain and special words.
_DIRTY = "\x00"


def unify(df: DataFrame, text: str, only_changed: bool = False, limit: int = LIMIT) -> DataFrame:
    """df with `text` in one form; every other column stays. only_changed: just the rows that the operator changes.

    Null texts stay null. Texts are rewritten where they are; only where more than LOOKUP_ROWS spellings differ from
    the table's do those that may change move, to meet theirs by a digest of the text.
    """
    spelled = cut_lineage(spellings(df, text, limit))
    old, own = fresh_name(df, "_old"), fresh_name(df, "_own")
    few = spelled.count() <= LOOKUP_ROWS
    held = df.sparkSession.sparkContext.broadcast({r["word"]: r["canonical"] for r in spelled.collect()} if few else {})

    @F.pandas_udf("string")
    def rewrite(s: pd.Series) -> pd.Series:
        return pd.Series([normalise(x, held.value) for x in s], dtype=object)

    @F.pandas_udf("string")
    def rewrite_by(s: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([normalise(x, dict(m) if m is not None else None) for x, m in zip(s, maps)], dtype=object)

    kept = df.withColumn(old, F.col(text))
    if few:
        made = kept.withColumn(text, rewrite(old))
    else:
        may = F.col(text).isNotNull() & F.col(text).rlike(SUSPECT.pattern)

        def specials(cols: dict[str, list]) -> dict[str, list]:
            rows = [(h, w) for h, t in zip(cols["_h"], cols["_t"]) for w in special_words(t)]
            return {"_h": [h for h, _ in rows], "word": [w for _, w in rows]}

        texts = df.where(may).select(F.md5(text).alias("_h"), F.col(text).alias("_t"))
        maps = map_columns(texts, specials, "_h string, word string").join(spelled, "word")
        maps = maps.groupBy("_h").agg(F.map_from_entries(F.collect_set(F.struct("word", "canonical"))).alias(own)).withColumnRenamed("_h", own + "_h")
        met = kept.where(may).join(maps, F.md5(text) == F.col(own + "_h"), "left").drop(own + "_h").withColumn(text, rewrite_by(old, own)).drop(own)
        made = met.unionByName(kept.where(~F.coalesce(may, F.lit(False))))
    if only_changed:
        made = made.where(F.col(text) != F.col(old))
    return made.drop(old)
