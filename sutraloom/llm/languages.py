"""Languages of documents and of their sentences, and classes of single words, each with a confidence.

Method: cross-parsing entropy. A suffix automaton of labelled text is built for every language; a text is parsed into
the longest pieces that occur in a language's automaton, and the language that needs the fewest pieces for the text's
length wins. Confidence is the lead over the second language, as a share of the second's pieces.

Training: the languages are the labels that the corpus has; LABELS only says which labels mean the same. A label needs
LEAST_CHARS letters of sentences, of which its own automaton reads OWN_SHARE best; what has less is no language of its
own. Labels are noisy, so automata are built twice: sample sentences that the first ones give to another language are
left out of the second ones. The samples are bounded (SAMPLE_ROWS records and SAMPLE_CHARS letters per language, as many
from a record at most, chosen by a hash of the id); everything else covers all rows.

Speed: automata are dense transition tables, and whole batches of sentences walk them in step. Texts of over LONGEST
characters do so in parts; where a piece runs over a cut, the next part is followed from there until both ways meet.
Batches of texts are one array of code points, in which site lines, sentences and their words are found by tables of what
a character is; `sentences`, `line_key` and `prepared` say the same for one text.

Defined results: null and blank texts, and texts without a letter, have no language. A text without a whole sentence has
the language of its letters, with no sentences and half the confidence. A sentence has at least MIN_WORDS words and ends
in sentence punctuation. Lines of any length that stand in SITE_SHARE of their own source's
records (SITE_RECORDS at least), or in COMMON_LINE of all records, count as site lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.llm import encoding, lookalikes
from sutraloom.llm.sitelines import BROADCAST_SOURCES
from sutraloom.llm.sitelines import MIN_RECORDS as SITE_RECORDS
from sutraloom.llm.sitelines import MIN_SHARE as SITE_SHARE
from sutraloom.llm.words import WORD
from sutraloom.runtime import attach, collect_bounded, cut_lineage, map_columns, ship_package

SAMPLE_ROWS, SAMPLE_CHARS = 250, 40_000
WORD_SAMPLE_ROWS, WORD_SAMPLE_CHARS = 8_000, 40_000
MIN_WORDS = 4
#: Letters of sentences that a label needs to be a language, and the share of them that it reads best itself.
LEAST_CHARS, OWN_SHARE = 1_000, 0.6
#: Labels that a corpus may have.
LABELS_MOST = 10_000
#: Texts that walk the automata together; a size at which their states stay near the processor.
BATCH = 4_096
#: Characters of a text that walk the automata in one go; longer texts do so in parts.
LONGEST = 2_000
#: Letters (with the blank) that a word has on average in a sentence; what has fewer is noise.
MIN_WORD_LENGTH = 3.2
MIN_CONFIDENCE = 0.12
COMMON_LINE = 0.01

# The ways in which a language is written in labels.
LABELS = {
    "en": ("en", "eng", "english"), "hi": ("hi", "hin", "hindi"), "sa": ("sa", "san", "sanskrit"),
    "de": ("de", "deu", "ger", "german", "deutsch"), "fr": ("fr", "fra", "fre", "french", "français"), "es": ("es", "spa", "spanish", "español"),
}
_BY_LABEL = {w: k for k, v in LABELS.items() for w in v}
_MISSING = ("", "und", "unknown", "none", "null")


def label_of(raw: str | None) -> str | None:
    """The language that a label names: None for missing, the label itself for one that is not in LABELS."""
    low = (raw or "").strip().lower()
    return None if low in _MISSING else _BY_LABEL.get(low, _BY_LABEL.get(re.split(r"[-_]", low)[0], low))


# --- automata ----------------------------------------------------------------------------------------------------------


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the start. Every walk from it spells a substring."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """The automata of all languages as dense tables; parses batches of texts."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.samples, self.names = samples, sorted(samples)
        self.tables, self.codes, self.has = [], [], []
        for name in self.names:
            nxt = suffix_automaton(samples[name])
            letters = sorted(set(samples[name]))
            where = {c: i + 1 for i, c in enumerate(letters)}  # 0: a character that the language does not have
            code = np.zeros(0x10000, dtype=np.int32)
            for c, i in where.items():
                if ord(c) < 0x10000:
                    code[ord(c)] = i
            width = len(letters) + 1
            to = np.zeros((len(nxt) + 1, width), dtype=np.int32)  # state 0: before and between pieces; the start is 1
            for st, out in enumerate(nxt):
                for c, t in out.items():
                    to[st + 1, where[c]] = t + 1
            # a step that fails begins a new piece, which the entry says in its lowest bit; a character that the
            # language does not have is a piece of its own
            miss = to == 0
            table = (np.where(miss, to[1][None, :], to) * width << 1) | miss
            self.tables.append(table.astype(np.int32).ravel())
            self.codes.append(code)
        # characters that some language has get small numbers, from which the codes of each language follow
        known = np.flatnonzero(sum([code > 0 for code in self.codes], np.zeros(0x10000, dtype=bool)))
        self.number = np.zeros(0x10000, dtype=np.intp)
        self.number[known] = np.arange(1, len(known) + 1)
        self.small = [np.concatenate(([0], code[known])).astype(np.int32) for code in self.codes]
        self.has = [small > 0 for small in self.small]
        for has in self.has:
            has[self.number[ord(" ")]] = False

    def __reduce__(self) -> tuple:
        """The samples travel, which are small; the tables, which are not, are built where they are used."""
        return Parser, (self.samples,)

    def pieces(self, texts: list[str]) -> np.ndarray:
        """Number of longest-match pieces of each text by language, (texts, languages)."""
        if not any([len(t) > LONGEST for t in texts]):
            return self._walked(texts)[0]
        parts = [t[i : i + LONGEST] for t in texts for i in range(0, len(t), LONGEST)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // LONGEST) for t in texts])
        counts, ends = self._walked(parts)
        for k in range(len(self.names)):
            for p in range(1, len(parts)):
                if owner[p] == owner[p - 1]:
                    more, end = self._joined(k, parts[p], int(ends[p - 1, k]), int(ends[p, k]))
                    counts[p, k] += more
                    ends[p, k] = end
        total = np.zeros((len(texts), len(self.names)))
        np.add.at(total, owner, counts)
        return total

    def _joined(self, k: int, part: str, at: int, end: int) -> tuple[int, int]:
        """What a part has more pieces if the state before it is `at` rather than none, and its last state; `end` is its
        last state without one."""
        table, code, alone, more = self.tables[k], self.codes[k], 0, 0
        for c in part:
            if at == alone:
                return more, end
            step = int(code[ord(c)]) if ord(c) < 0x10000 else 0
            went, other = int(table[at + step]), int(table[alone + step])
            more += (went & 1) - (other & 1)
            at, alone = went >> 1, other >> 1
        return more, at

    def _walked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each text by language, and the automaton's last state."""
        sizes = np.array([len(t) for t in texts], dtype=np.intp)
        return self._walk(code_points("".join(texts)), np.cumsum(sizes) - sizes, sizes)

    def spaced(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """`pieces` of texts that begin with a blank, which is left out: stretches of an array of code points."""
        if not (sizes > LONGEST).any():
            return self._walk(points, starts, sizes, True)[0]
        counts = np.zeros((len(sizes), len(self.names)))
        short, long = np.flatnonzero(sizes <= LONGEST), np.flatnonzero(sizes > LONGEST)
        counts[short] = self._walk(points, starts[short], sizes[short], True)[0]
        counts[long] = self.pieces([f" {_text(points[a : a + n])}" for a, n in zip(starts[long].tolist(), sizes[long].tolist())])
        return counts

    def _walk(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by language of stretches of an array of code points, and the automaton's last state; blank: as if a
        blank stood before each."""
        n = len(sizes)
        result, ends = np.zeros((n, len(self.names)), dtype=np.float64), np.zeros((n, len(self.names)), dtype=np.int32)
        if not n or not (blank or sizes.any()):
            return result, ends
        order = np.argsort(-sizes, kind="stable")
        if n > BATCH:  # texts of about one length together
            for mine in np.array_split(order, -(-n // BATCH)):
                result[mine], ends[mine] = self._walk(points, starts[mine], sizes[mine], blank)
            return result, ends
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()  # texts that still run at each step
        # the first characters of all texts, then the second ones, and so on: each step reads one stretch
        joined = points[np.concatenate([starts[:m] + step for step, m in enumerate(live)])] if live else points[:0]
        joined = self.number[np.where(joined < 0x10000, joined, 0)]
        ends_at = np.cumsum(live).tolist()
        held = np.zeros(len(self.small[0]), dtype=bool)
        held[joined] = True
        went, bit = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
        for k in range(len(self.names)):
            begin = int(self.tables[k][int(self.codes[k][ord(" ")])])
            if not (held & self.has[k]).any():  # no letter of this language: every character is a piece
                result[order, k] = sizes + blank
                last = points[starts + sizes - 1] == ord(" ") if len(points) else sizes > 0
                ends[order, k] = np.where(np.where(sizes > 0, last, blank), begin >> 1, 0)
                continue
            table, coded = self.tables[k], self.small[k].take(joined, mode="clip")
            at, count = np.full(n, begin >> 1 if blank else 0, dtype=np.intp), np.full(n, begin & 1 if blank else 0, dtype=np.int32)
            first = 0
            for last in ends_at:
                m = last - first
                at[:m] += coded[first:last]
                table.take(at[:m], out=went[:m], mode="clip")
                np.bitwise_and(went[:m], 1, out=bit[:m])
                count[:m] += bit[:m]
                np.right_shift(went[:m], 1, out=at[:m])
                first = last
            result[order, k], ends[order, k] = count, at
        return result, ends


def decide(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language with the fewest pieces, and its lead as a share of the second's pieces."""
    if not len(pieces):
        return np.zeros(0, dtype=int), np.zeros(0)
    best = pieces.argmin(axis=1)
    ordered = np.sort(pieces, axis=1)
    second = ordered[:, 1] if ordered.shape[1] > 1 else ordered[:, 0] * 2
    return best, (second - ordered[:, 0]) / np.maximum(second, 1)


# --- sentences -----------------------------------------------------------------------------------------------------------

# the blank first: what is tried at every place should fail soon
_CUT = re.compile(r"\s(?:(?<=[.!?।]\s)|(?<=[.!?।][\"'’”»)]\s)|(?<=\|\|\s)|(?<=[^\W\d_] \|\s))\s*")
_ENDS = tuple(".!?।|")
_REST = re.compile(r"[\W\d_]+")
_ASCII_REST = bytes(i for i in range(128) if not chr(i).isalpha())
_ASCII_REST_IN_LINES = _ASCII_REST.replace(b"\n", b"")
_INNER = re.compile(r"[.!?]\s")
_TAIL = "\"'’”»)† \t\r"


def letters(text: str) -> str:
    """A text's words in lower case with single blanks: what the automata read."""
    return " ".join(WORD.findall(text.lower()))


def prepared(text: str) -> str:
    """A text as meant: garbled spans restored, look-alikes made plain."""
    return text if text.isascii() else lookalikes.normalise(encoding.restore(text)[0])


def line_key(line: str) -> int | None:
    """Hash of a line's letters, for lines that end as sentences do; None for others."""
    if len(line) < 12 or not (line.rstrip(_TAIL).endswith(_ENDS) or _INNER.search(line)):
        return None
    low = line.lower()
    words = low.encode().translate(None, _ASCII_REST) if low.isascii() else _REST.sub("", low)
    return xxhash.xxh3_64_intdigest(words) >> 1 if len(words) > 11 else None


def unwrapped(lines: list[str]) -> list[str]:
    """Lines that were broken to a width, joined up to the end of their paragraph."""
    width = max(map(len, lines), default=0)
    joined, out = "", []
    for line in lines:
        bare = line.strip()
        if not bare:
            out.append(joined)
            joined = ""
            continue
        joined = f"{joined[:-1]}{bare}" if joined.endswith(("¬", "‐", "-")) and joined[-2:-1].isalpha() else f"{joined} {bare}"
        if len(line) < 0.45 * width and bare.endswith(_ENDS):
            out.append(joined)
            joined = ""
    return [*out, joined]


def sentences(text: str, wrapped: bool, common: frozenset[int]) -> list[str]:
    """Whole sentences of a text. wrapped: lines were broken to a width, so a sentence may run over their ends."""
    lines = text.split("\n")
    if common:
        lines = [x for x in lines if (k := line_key(x)) is None or k not in common]
    if wrapped:
        lines = unwrapped(lines)
    found = []
    for line in lines:
        for s in _CUT.split(line):
            if s and s.rstrip(_TAIL).endswith(_ENDS):
                bare = letters(s)
                gaps = bare.count(" ")
                if gaps >= MIN_WORDS - 1 and len(bare) >= MIN_WORD_LENGTH * (gaps + 1):
                    found.append(bare)
    return found


# --- the same for batches of texts --------------------------------------------------------------------------------------

#: Characters of texts that are laid out as one array of code points, and of those whose sentences are parsed together.
STRETCH, TOGETHER = 1 << 20, 1 << 23
# what a character is, as bits
_LETTER, _BARE, _BLANK, _STOP, _SIGN, _CLOSE, _END, _LEAD, _AFTER, _STRAY = (1 << i for i in range(10))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What each code point is, by the patterns that `sentences`, `line_key`, `letters` and `prepared` go by."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    flags = np.zeros(len(every), dtype=np.uint16)
    leads, after = encoding.lead_and_after()
    patterns = ((_LETTER, WORD), (_BARE, re.compile(r"[^\W\d_]+")), (_BLANK, re.compile(r"\s+")), (_STRAY, lookalikes.SUSPECT))
    for flag, pattern in patterns:
        for m in pattern.finditer(every):
            flags[m.start() : m.end()] |= flag
    # of look-alikes of two characters, the second tells
    for flag, chars in ((_STOP, ".!?।"), (_SIGN, "\"'’”»)"), (_CLOSE, _TAIL), (_END, _ENDS), (_LEAD, leads), (_AFTER, after), (_STRAY, "\u093c")):
        flags[[ord(c) for c in chars]] |= flag
    return flags


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Each letter in lower case, 0 for what is none; line ends stay. Not for "İ" and "Σ", whose lower case is two
    characters or depends on those beside it."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    low = np.frombuffer(every.replace("İ", "i").replace("Σ", "σ").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(((_classes()[low] & _BARE) != 0) | (low == 10), low, np.uint32(0))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def _stretches(texts: list[str | None], chars: int) -> Iterator[slice]:
    """Runs of texts of about so many characters, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _owners(texts: list[str]) -> np.ndarray:
    """For each line of the texts in a row, the number of its text."""
    return np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])


def all_prepared(texts: list[str]) -> list[str]:
    """`prepared` of each text. Only texts with a character that may need it are looked at one by one."""
    out = list(texts)
    rows = [i for i, t in enumerate(texts) if not t.isascii()]
    if rows:
        flags = _classes()[code_points("\n".join([texts[i] for i in rows]))]
        doubt = np.flatnonzero(flags & _STRAY)
        pairs = np.flatnonzero(((flags[:-1] & _LEAD) != 0) & ((flags[1:] & _AFTER) != 0))
        ends = np.cumsum([len(texts[i]) + 1 for i in rows])
        for n in set(np.searchsorted(ends, np.concatenate((doubt, pairs)), side="right").tolist()):
            out[rows[n]] = prepared(texts[rows[n]])
    return out


def _bare_lines(lines: list[str]) -> list[str] | list[bytes]:
    """The letters of each line, as `line_key` reads them."""
    plain = [x.isascii() for x in lines]
    done: list = "\n".join([x for x, p in zip(lines, plain) if p]).lower().encode().translate(None, _ASCII_REST_IN_LINES).split(b"\n")
    if not all(plain):
        whole = "\n".join([x for x, p in zip(lines, plain) if not p])
        if "İ" in whole or "Σ" in whole:
            whole = whole.lower()
        bare = _folded().take(code_points(whole), mode="clip")
        rest, done = iter(_text(bare[bare != 0]).split("\n")), iter(done)
        done = [next(done if p else rest) for p in plain]
    return done


def _ended(whole: str, flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each part of a text ends in sentence punctuation, closing signs aside."""
    at = ends - 1
    full = at >= starts
    for i in np.flatnonzero(full & ((flags[at] & _CLOSE) != 0)).tolist():
        at[i] = starts[i] + len(whole[starts[i] : ends[i]].rstrip(_TAIL)) - 1
    return (at >= starts) & ((flags[at] & _END) != 0)


def line_keys(texts: list[str]) -> list[tuple[int, int]]:
    """(number of the text, key) for each different line of each text that has a `line_key`."""
    whole = "\n".join(texts)
    points = code_points(whole)
    if not len(points):
        return []
    flags = _classes()[points]
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.concatenate(([0], ends[:-1] + 1))
    takes = _ended(whole, flags, starts, ends)
    inner = np.flatnonzero(((flags[:-1] & _STOP) != 0) & (points[:-1] != ord("।")) & ((flags[1:] & _BLANK) != 0) & (points[1:] != 10))
    takes[np.searchsorted(ends, inner)] = True
    takes &= ends - starts >= 12
    return list({(o, xxhash.xxh3_64_intdigest(b) >> 1) for o, b, take in zip(_owners(texts).tolist(), _bare_lines(whole.split("\n")), takes.tolist()) if take and len(b) > 11})


def without_lines(texts: list[str], common: list[frozenset[int]]) -> list[str]:
    """The texts without the lines whose key is in the text's set."""
    every = frozenset().union(*set(common))
    if not every or not any(texts):
        return texts
    out = list(texts)
    hits = [n for n, b in enumerate(_bare_lines("\n".join(texts).split("\n"))) if len(b) > 11 and xxhash.xxh3_64_intdigest(b) >> 1 in every]
    for i in set(_owners(texts)[hits].tolist()):
        out[i] = "\n".join([x for x in texts[i].split("\n") if (k := line_key(x)) is None or k not in common[i]])
    return out


class Sentences:
    """The whole sentences of texts, as `sentences` gives them, in one array of code points: `owner` has the number of
    each one's text, `starts` and `sizes` tell where it stands; a blank follows each, which `sizes` does not count."""

    def __init__(self, texts: list[str]) -> None:
        # line ends before the first text stand for what the patterns may look back at
        whole = "\n\n\n" + "\n".join(texts) + "\n"
        points = code_points(whole)
        flags = _classes()[points]
        before = np.flatnonzero(((flags[:-1] & (_END | _SIGN)) != 0) & ((flags[1:] & _BLANK) != 0) & (points[1:] != 10))
        here, one, bar = flags[before], flags[before - 1], points[before] == ord("|")
        stop = (here & _STOP) != 0
        stop |= ((here & _SIGN) != 0) & ((one & _STOP) != 0)
        stop |= bar & (points[before - 1] == ord("|"))
        stop |= bar & (points[before - 1] == ord(" ")) & ((flags[before - 2] & _BARE) != 0)
        ends = np.sort(np.concatenate((before[stop] + 1, np.flatnonzero(points == 10))))
        starts = np.concatenate(([0], ends[:-1] + 1))
        whole_ones = _ended(whole, flags, starts, ends)
        starts, ends = starts[whole_ones], ends[whole_ones]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]) + 3, starts, side="right")
        # the sentences alone, a line end after each
        step = np.zeros(len(points) + 1, dtype=np.int8)
        step[starts] = 1
        step[ends + 1] -= 1
        cut = points.copy()
        cut[ends] = 10
        points = code_points(_text(cut[np.cumsum(step[:-1], dtype=np.int8).view(bool)]).lower())
        # their words, one blank after each
        letter = (_classes()[points] & _LETTER) != 0
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        lasts, size = np.flatnonzero(points == 10), np.cumsum(kept, dtype=np.int64)
        gaps = np.flatnonzero(kept & ~letter)
        till = np.concatenate(([0], size[lasts]))
        words = np.diff(np.searchsorted(gaps, lasts, side="right"), prepend=0)
        sizes = np.diff(till) - 1
        right = (words >= MIN_WORDS) & (sizes >= MIN_WORD_LENGTH * words)
        self.points = np.where(letter, points, np.uint32(ord(" ")))[kept]
        self.starts, self.sizes, self.owner = till[:-1][right], sizes[right], owner[right]

    def add(self, other: Sentences, texts: int) -> None:
        """Those of further texts; `texts`: how many came before."""
        self.starts = np.concatenate((self.starts, other.starts + len(self.points)))
        self.owner = np.concatenate((self.owner, other.owner + texts))
        self.points, self.sizes = np.concatenate((self.points, other.points)), np.concatenate((self.sizes, other.sizes))

    def indic(self) -> np.ndarray:
        """Which of the sentences have an Indic letter."""
        at = np.flatnonzero((self.points >= 0x900) & (self.points < 0xE00))
        return np.searchsorted(at, self.starts) < np.searchsorted(at, self.starts + self.sizes)


# --- training --------------------------------------------------------------------------------------------------------------


def _sampled(df: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """About 3 * rows records of each label, chosen by a hash of the key: a pass over the labels alone sets the rate."""
    counts = collect_bounded(df.groupBy(label).agg(F.count("*").alias("n")), LABELS_MOST, "labels")
    rates = {r[label]: min(1.0, 3 * rows / r["n"]) for r in counts if r[label] is not None}
    if not rates:
        return df.where(F.lit(False))
    rate = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))])
    unit = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(F.col(label).isNotNull() & (unit < F.element_at(rate, F.col(label))))


def _keep(lists: dict[str, list[str]], chars: int, joint: str) -> dict[str, str]:
    out = {}
    for name, texts in lists.items():
        kept, size = [], 0
        for t in dict.fromkeys(texts):
            if size >= chars:
                break
            kept.append(t)
            size += len(t) + 1
        if kept:
            out[name] = joint + joint.join(kept) + joint
    return out


def _budget(lists: dict[str, list[str]], chars: int) -> int:
    """The same number of letters for each language, so that no automaton knows more for its size."""
    return min([chars, *[max(2_000, sum(len(t) + 1 for t in dict.fromkeys(v))) for v in lists.values()]])


def train_lists(lists: dict[str, list[str]], chars: int, joint: str, rounds: int = 2) -> dict[str, list[str]]:
    """Labelled pieces of text without those that another language reads better. Each half is judged by automata of
    the other half, as an automaton reads its own text in one piece."""
    lists = {k: v for k, v in lists.items() if v}
    for _ in range(rounds):
        halves = [{k: list(dict.fromkeys(v))[h::2] or v for k, v in lists.items()} for h in (0, 1)]
        kept: dict[str, list[str]] = {k: [] for k in lists}
        for mine, other in (halves, halves[::-1]):
            parser = Parser(_keep(other, _budget(other, chars), joint))
            for name, texts in mine.items():
                best, _ = decide(parser.pieces([joint + t + joint for t in texts]))
                kept[name] += [t for t, b in zip(texts, best) if parser.names[b] == name]
        lists = {k: v or lists[k] for k, v in kept.items()}
    return lists


def own_languages(lists: dict[str, list[str]], chars: int, joint: str) -> dict[str, list[str]]:
    """The labels that are languages of their own, purified once: while some label reads less than OWN_SHARE of its
    sentences best, the one of these with the least text is left out."""
    lists = {k: v for k, v in lists.items() if sum(len(t) + 1 for t in set(v)) >= LEAST_CHARS}
    while True:
        kept = train_lists(lists, chars, joint, 1)
        weak = [k for k, v in lists.items() if len(kept[k]) < OWN_SHARE * len(dict.fromkeys(v))]
        if not weak or len(lists) < 2:
            return kept
        del lists[min(weak, key=lambda k: (sum(map(len, lists[k])), k))]


def train(lists: dict[str, list[str]], chars: int, joint: str, rounds: int = 2) -> Parser | None:
    """Automata of labelled pieces of text, purified; None without any."""
    kept = train_lists(own_languages(lists, chars, joint), chars, joint, rounds - 1)
    return Parser(_keep(kept, _budget(kept, chars), joint)) if kept else None


def fit_documents(df: DataFrame, key: str, text: str, label: str, wrapped: str) -> Parser | None:
    """Automata of the languages in a labelled sample of documents. Sentences are cut where the texts are; a record
    sends as many letters at most as an automaton takes."""
    labelled = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(wrapped).alias("_w"), language(F.col(label)).alias("_label")).where(F.col(text).isNotNull())

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        made = []
        for t, w in zip(cols["_t"], cols["_w"]):
            size, mine = 0, []
            for x in sentences(prepared(t), bool(w), frozenset()):
                if size >= SAMPLE_CHARS:
                    break
                mine.append(x)
                size += len(x)
            made.append(mine)
        return {"h": cols["h"], "label": cols["_label"], "made": made}

    sample = _sampled(labelled, "_k", "_label", SAMPLE_ROWS).select(F.xxhash64("_k").alias("h"), "_t", "_w", "_label")
    rows = collect_bounded(map_columns(sample, kernel, "h bigint, label string, made array<string>"), LABELS_MOST * 6 * SAMPLE_ROWS, "language sample")
    lists: dict[str, list[str]] = defaultdict(list)
    taken: Counter = Counter()
    for r in sorted(rows, key=lambda r: (r["h"], r["made"])):
        if taken[r["label"]] < SAMPLE_ROWS:
            taken[r["label"]] += 1
            lists[r["label"]] += r["made"]
    # a sentence that stands under several labels is a site line; it tells nothing
    seen: dict[str, set] = defaultdict(set)
    for name, texts in lists.items():
        for t in texts:
            seen[t].add(name)
    return train({k: [t for t in v if len(seen[t]) == 1] for k, v in lists.items()}, SAMPLE_CHARS, " ")


def language(label) -> "F.Column":
    """label_of as a column."""
    low = F.lower(F.trim(label))
    known = F.create_map(*[x for k, v in _BY_LABEL.items() for x in (F.lit(k), F.lit(v))])
    return F.when(low.isNull() | low.isin(*_MISSING), None).otherwise(F.coalesce(F.try_element_at(known, low), F.try_element_at(known, F.element_at(F.split(low, "[-_]"), 1)), low))


# --- on tables ---------------------------------------------------------------------------------------------------------------


def _line_counts(df: DataFrame, text: str, source: str) -> DataFrame:
    """(s, h, n): records of each source (a hash, null without one) with each sentence-like line; h null: all its
    records. Combined inside each task, so that a source with a third of all rows moves one counter per line and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def give() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in seen], pa.int64()), pa.array([h for _, h in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["s", "h", "n"]
            )
            seen.clear()
            return made

        for b in batches:
            sites, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in _stretches(texts, STRETCH):
                mine = sites[part]
                seen.update([(s, None) for s in mine])
                seen.update([(mine[i], k) for i, k in line_keys([t or "" for t in texts[part]])])
                if len(seen) > 500_000:
                    yield give()
        yield give()

    return cut_lineage(df.select(source, text).mapInArrow(run, "s bigint, h bigint, n bigint").groupBy("s", "h").agg(F.sum("n").alias("n")))


def common_lines(counts: DataFrame, share: float = COMMON_LINE, least: int = 5) -> frozenset[int]:
    """Hashes of sentence-like lines that stand in `share` of all records: at most (lines per record) / share of them."""
    total = counts.where(F.col("h").isNull()).agg(F.sum("n")).first()[0] or 0
    lines = counts.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("n").alias("n"))
    return frozenset(r["h"] for r in collect_bounded(lines.where(F.col("n") >= max(least, share * total)), 100_000, "common lines"))


def source_lines(counts: DataFrame, share: float = SITE_SHARE, least: int = SITE_RECORDS) -> DataFrame:
    """(s, lines): hashes of the sentence-like lines that stand in `share` of the source's records; at most
    (lines per record) / share for a source."""
    totals = counts.where(F.col("h").isNull() & F.col("s").isNotNull()).select("s", F.col("n").alias("of"))
    lines = counts.where(F.col("h").isNotNull() & (F.col("n") >= least))
    return lines.join(totals, "s").where(F.col("n") >= F.col("of") * share).groupBy("s").agg(F.collect_list("h").alias("lines"))


def detect(df: DataFrame, key: str, text: str, label: str, wrapped: str, source: str | None = None, whole_only: bool = False) -> DataFrame:
    """(key, given, lang, sentences, share, confidence): one row for each language in which a record has whole
    sentences, and one with no sentences for a record with letters but no whole sentence, or none that any language reads
    better than another; whole_only leaves these out. given: the language that the label names, null where missing. source: the site or book of a record,
    whose own site lines are left out too. Extra columns of df are not read."""
    parser = fit_documents(df, key, text, label, wrapped)
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, given string, lang string, sentences int, share double, confidence double"
    if parser is None:
        return df.sparkSession.createDataFrame([], schema)
    site = F.when(F.col(source).isNotNull(), F.xxhash64(source)) if source else F.lit(None).cast("bigint")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"), F.col(wrapped).alias("wrapped"), site.alias("site"))
    counts = _line_counts(rows, "text", "site")
    held = df.sparkSession.sparkContext.broadcast((parser, common_lines(counts)))
    rows = attach(rows, "site", source_lines(counts), "s", "text", BROADCAST_SOURCES).drop("s")

    def found(texts: list[str], labels: list, broken: list, known: list[frozenset[int]]) -> Iterator[tuple]:
        """(number of the text, given, language, sentences, share, confidence)"""
        parser = held.value[0]
        names = parser.names
        meant, made = [], Sentences([])
        for part in _stretches(texts, STRETCH):
            meant += all_prepared(texts[part])
            lines = without_lines(meant[part], known[part])
            made.add(Sentences(["\n".join(unwrapped(t.split("\n"))) if w else t for t, w in zip(lines, broken[part])]), part.start)
        if not whole_only:
            whole = set(made.owner.tolist())
            bare = {i: s for i, t in enumerate(meant) if i not in whole and (s := letters(t))}
            if bare:
                for i, k, sure in zip(bare, *decide(parser.pieces([f" {s} " for s in bare.values()]))):
                    yield i, label_of(labels[i]), names[k], 0, 1.0, float(sure) / 2
        if not len(made.owner):
            return
        pieces, indic = np.zeros((len(made.owner), len(names))), made.indic()
        for at in (np.flatnonzero(~indic), np.flatnonzero(indic)):
            pieces[at] = parser.spaced(made.points, made.starts[at], made.sizes[at] + 1)
        best, lead = decide(pieces)
        first = np.flatnonzero(np.diff(made.owner, prepend=-1))  # where the sentences of each record begin
        record = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(made.owner))))
        total, chars = np.add.reduceat(pieces, first), np.add.reduceat(made.sizes, first)
        main = total.argmin(axis=1)
        # a sentence without a clear lead belongs to the record's main language
        of = np.where(lead >= MIN_CONFIDENCE, best, main[record])
        groups, group, n = np.unique(record * len(names) + of, return_inverse=True, return_counts=True)
        mine = np.add.reduceat(pieces[np.argsort(group, kind="stable")], np.cumsum(n) - n)
        share = np.bincount(group, weights=made.sizes) / chars[groups // len(names)]
        _, sure = decide(mine)
        told = sure >= MIN_CONFIDENCE / 2  # else no language reads it better than another: noise
        numbers = made.owner[first].tolist()
        for g, *rest in zip(groups[told].tolist(), n[told].tolist(), share[told].tolist(), sure[told].tolist()):
            r, k = divmod(g, len(names))
            yield numbers[r], label_of(labels[numbers[r]]), names[k], *rest
        if not whole_only:
            noise = np.setdiff1d(np.arange(len(first)), groups[told] // len(names))
            for r, k, x in zip(noise.tolist(), main[noise].tolist(), decide(total[noise])[1].tolist()):
                yield numbers[r], label_of(labels[numbers[r]]), names[k], 0, 1.0, x / 2

    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value[1]
        types = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64())
        for b in batches:
            texts, labels, broken, sites = (b.column(c).to_pylist() for c in ("text", "label", "wrapped", "site"))
            # all records of a site have its list; it is read once
            of = {s: i for i, s in enumerate(sites)}
            lists = {s: common.union(x) if (x := b.column("lines")[i].as_py()) else common for s, i in of.items()}
            for part in _stretches(texts, TOGETHER):
                rows = [i for i in range(part.start, part.stop) if texts[i]]
                out = list(found([texts[i] for i in rows], [labels[i] for i in rows], [bool(broken[i]) for i in rows], [lists[sites[i]] for i in rows]))
                keys = b.column("key").take(pa.array([rows[r[0]] for r in out], pa.int64()))
                made = [pa.array([r[n] for r in out], t) for n, t in enumerate(types, 1)]
                yield pa.RecordBatch.from_arrays([keys, *made], names=[key, "given", "lang", "sentences", "share", "confidence"])

    return rows.select("key", "text", "label", "wrapped", "site", "lines").mapInArrow(run, schema)


def wrong_or_mixed(detected: DataFrame, key: str) -> DataFrame:
    """(key, lang): the right language of records whose label is missing or names another, and each language of
    records that mix several. Records without a whole sentence are none."""
    n = F.size("langs")
    grouped = detected.where(F.col("sentences") > 0).groupBy(key).agg(F.first("given").alias("given"), F.collect_set("lang").alias("langs"))
    hits = grouped.where((n > 1) | F.col("given").isNull() | (F.element_at("langs", 1) != F.col("given")))
    return hits.select(key, F.explode("langs").alias("lang"))


# --- words -------------------------------------------------------------------------------------------------------------------


def word_form(word: str) -> str:
    """A word as the automata read it: plain characters without accents, lower case."""
    plain = word if word.isascii() else lookalikes.normalise(word)
    if not plain.isascii():
        plain = "".join([c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c)])
    return plain.lower().strip()


class WordParser:
    """Parses words from both ends: a short word has few pieces, and two parses tell more than one."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.ahead = Parser(samples)
        self.back = Parser({k: v[::-1] for k, v in samples.items()})
        self.names = self.ahead.names

    def pieces(self, words: list[str]) -> np.ndarray:
        marked = [f"\n{w}\n" for w in words]
        return self.ahead.pieces(marked) + self.back.pieces([w[::-1] for w in marked])


def fit_words(df: DataFrame, key: str, word: str, label: str) -> WordParser | None:
    labelled = df.select(key, F.col(word), F.col(label).cast("string").alias("_label")).where(F.col(word).isNotNull() & F.col(label).isNotNull())
    rows = collect_bounded(_sampled(labelled, key, "_label", WORD_SAMPLE_ROWS).select(F.xxhash64(key).alias("h"), word, "_label"), 60 * WORD_SAMPLE_ROWS, "word sample")
    lists: dict[str, list[str]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["h"], r[word])):
        if (w := word_form(r[word])) and len(lists[r["_label"]]) < WORD_SAMPLE_ROWS:
            lists[r["_label"]].append(w)
    if not lists:
        return None
    kept = train_lists(dict(lists), WORD_SAMPLE_CHARS, "\n", 3)
    return WordParser(_keep(kept, _budget(kept, WORD_SAMPLE_CHARS), "\n"))


def classify_words(df: DataFrame, key: str, word: str, label: str) -> DataFrame:
    """(key, word, given, right, confidence) of each non-null word; blank words keep a null class. Where two classes
    need equally few pieces, the given label stands."""
    parser = fit_words(df, key, word, label)
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, word string, given string, right string, confidence double"
    if parser is None:
        return df.sparkSession.createDataFrame([], schema)
    held = df.sparkSession.sparkContext.broadcast(parser)

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        parser = held.value
        rows = [i for i, w in enumerate(cols[word]) if w is not None]
        forms = [word_form(cols[word][i]) for i in rows]
        given = [None if cols[label][i] is None else str(cols[label][i]) for i in rows]
        distinct = sorted({f for f in forms if f})
        pieces = parser.pieces(distinct)
        best, lead = decide(pieces)
        where = {f: n for n, f in enumerate(distinct)}
        right, sure = [], []
        for f, g in zip(forms, given):
            n = where.get(f)
            if n is None:
                right.append(None)
                sure.append(0.0)
                continue
            b = int(best[n])
            if g in parser.names and pieces[n, parser.names.index(g)] == pieces[n, b]:
                b = parser.names.index(g)
            right.append(parser.names[b])
            sure.append(float(lead[n]))
        return {key: [cols[key][i] for i in rows], "word": [cols[word][i] for i in rows], "given": given, "right": right, "confidence": sure}

    return map_columns(df.select(key, word, label), kernel, schema)
