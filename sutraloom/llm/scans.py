"""Noise in text from scanned pages: find it, and give every page back as continuous paragraphs.

Method: each page is a sequence of lines, labelled by a hidden Markov model over layout features (shape of the line,
place on the page, case, ending, length against the page's width) as header, page number, body or break. Its weights
are stated beliefs about printed pages, the same for every corpus. Headers and page numbers leave the text; body lines
are joined to paragraphs at the breaks; words broken over a line end are made whole; words with misrecognised
characters are put right.

Words: a token is a misreading of a frequent word if undoing one or two typical confusions of characters gives that
word, and the word is RATIO times as frequent. Frequent words are those with at least SHARE of all tokens, so there are
at most 1 / SHARE of them, whatever the corpus: they may be broadcast. The misreadings found among all distinct tokens
are broadcast only after their number has been checked, beyond that they meet the tokens of the finished pages by a
join; both ways give the same rows.

Defined results: null and blank texts hold no noise and stay as they are. A page without a source is treated as
scanned if its lines are broken to a width. A hyphen that belongs to the word (a compound) is no noise. A header or page
number is one printed line: a line of more than LINE characters is running text or an item, whatever its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutraloom.llm import encoding, lookalikes
from sutraloom.llm.words import count_words
from sutraloom.runtime import collect_bounded, cut_lineage, map_columns

SHARE, LEAST_COUNT, RATIO = 5e-6, 3, 12
BROADCAST_ROWS = 300_000

STATES = ("header", "page_no", "body", "break")

# --- layout features ------------------------------------------------------------------------------------------------------

_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,8}|[0-9lIoO]{1,4})"
_PAGE = re.compile(rf"^[^\w,;\t]*(?:(?:page|pag|p|pg|seite|s)\b\.?\s*)?{_NUMBER}(?:\s*[|/]\s*(?:page|seite|\d{{1,4}}))?[^\w,;\t]*$", re.I)
_GAP_NUMBER = re.compile(r"^\s*\d{1,4}\s{2,}\S.*[^\W\d_]|[^\W\d_].*\S\s{2,}\d{1,4}\s*$")
_CHAPTER = re.compile(r"^\W*(?:\d{1,4}\s+)?(?:(?:chapter|chap\.|kapitel|chapitre|capítulo|adhy[aā]ya)\W|(?:book|part|section)\s+(?:\d+|[ivxlc]+)\b)", re.I)
_SMALL = frozenset("a an the of and in on upon from for to with by or at as de la le du des et der die das und von el los las y del".split())
_ITEM = re.compile(r"^\s*(?:[-–—*•·]|\(?\d{1,4}[.)])\s")
_HYPHEN = re.compile(r"([^\W\d_][^\W_]*)([-‐¬­])[ \t]*$")
_LEAD = re.compile(r"^[ \t]*([^\W\d_][^\W_]*)")


_LETTER = re.compile(r"[^\W\d_]")
#: Words, also those that begin with a misread letter.
_WORDS = re.compile(r"(?:[^\W\d_]|[015!@](?=[^\W\d_]))[\w!@’'-]*")
_CUTS = re.compile(r"[,;|\t]|\S {3,}\S.*\S {3,}\S|[A-Za-z0-9+/]{25}")
_STOPS = (".", "!", "?", ":", ";", ",", "।", "|")
_SIGNS = ("-", "‐", "¬", "­")


#: Characters that a printed line may have.
LINE = 160


def _shape(line: str) -> str:
    if len(line) > LINE:
        return "item" if _ITEM.match(line) else "text"
    if len(line) <= 24 and _PAGE.match(line):
        return "page"
    if "  " in line and _GAP_NUMBER.search(line):
        return "item" if _CUTS.search(line) else "gap"
    if _ITEM.match(line) or _CUTS.search(line) or not _LETTER.search(line):
        return "item"
    return "chapter" if _CHAPTER.match(line) else "text"


def _case(line: str) -> str:
    if len(line) > LINE:
        return "plain"
    words = _WORDS.findall(line)
    if not words:
        return "none"
    if _CUTS.search(line):
        return "plain"
    if sum(map(len, words)) > 3 and sum([c.isupper() for c in line]) > 0.6 * sum([c.isalpha() for c in line]):
        return "upper"
    if len(words) == 1:
        return "one"
    big = [w for w in words if w.lower() not in _SMALL]
    return "title" if big and all([w[0].isupper() or not w[0].isalpha() for w in big]) else "plain"


_BLANK = ("blank", "mid", "none", "open", "short")


def line_features(text: str) -> list[tuple[str, ...]]:
    """One tuple of layout features for each line of a page. Shape and case are looked at where a line can be
    furniture at all: it begins in no small letter, and has another end or length than running text."""
    lines = [x.strip() for x in text.split("\n")]
    solid = [i for i, x in enumerate(lines) if x]
    sizes = sorted([len(lines[i]) for i in solid])
    width = sizes[int(len(sizes) * 0.8)] if sizes else 0
    narrow = "narrow" if width < 34 else "wide"
    places = {}
    for i, name in ((solid[-1:], "last"), (solid[1:2], "second"), (solid[:1], "first")):
        if i:
            places[i[0]] = name
    short, mid = 0.5 * width, 0.8 * width
    out = []
    for i, s in enumerate(lines):
        if not s:
            out.append((*_BLANK, narrow))
            continue
        place = places.get(i, "mid")
        end = "stop" if s.endswith(_STOPS) else "hyphen" if s.endswith(_SIGNS) else "open"
        length = "short" if len(s) < short else "mid" if len(s) < mid else "long"
        if place == "mid" and (s[0].islower() or end != "open" or length == "long") and len(s) > 24:
            out.append(("item" if _ITEM.match(s) else "text", place, "plain", end, length, narrow))
        else:
            out.append((_shape(s), place, _case(s), end, length, narrow))
    return out


FEATURES: tuple[tuple[str, ...], ...] = (
    ("blank", "page", "gap", "chapter", "item", "text"),
    ("first", "second", "last", "mid"),
    ("none", "upper", "title", "one", "plain"),
    ("stop", "hyphen", "open"),
    ("short", "mid", "long"),
    ("narrow", "wide"),
)
_INDEX = [{v: i for i, v in enumerate(vs)} for vs in FEATURES]

# Weight of each feature value by state. 1e-9: never.
_BELIEFS = {
    "header": ((1e-9, 1e-9, 40, 20, 0.05, 20), (40, 8, 6, 1), (0.05, 30, 30, 0.3, 0.3), (0.3, 0.05, 20), (5, 10, 10), (0.3, 10)),
    "page_no": ((1e-9, 60, 1e-9, 1e-9, 1e-9, 1e-9), (20, 5, 25, 1), (10, 1, 1, 10, 1), (3, 1, 10), (40, 0.5, 0.2), (1, 5)),
    "body": ((1e-9, 0.02, 0.3, 0.05, 3, 100), (1, 2, 2, 40), (1, 1, 1.5, 8, 60), (30, 8, 30), (15, 15, 60), (5, 20)),
    "break": ((100, 1e-9, 1e-9, 1e-9, 1e-9, 1e-9), (1, 1, 1, 20), (20, 0.01, 0.01, 0.01, 0.01), (0.1, 0.1, 20), (20, 1, 1), (5, 20)),
}
_MOVES = {"header": (1, 4, 30, 10), "page_no": (6, 1, 20, 10), "body": (1, 2, 60, 12), "break": (1, 2, 40, 1)}
_START = (10, 8, 40, 1)


class Model:
    """Log probabilities of start, moves and feature values; features of a line are independent given its state."""

    def __init__(self) -> None:
        norm = lambda w: np.log(np.array(w, dtype=float) / sum(w))
        self.start = norm(_START)
        self.move = np.stack([norm(_MOVES[s]) for s in STATES])
        self.emit = [np.stack([norm(_BELIEFS[s][f]) for s in STATES]) for f in range(len(FEATURES))]

    def scores(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        return sum(self.emit[f][:, [_INDEX[f][r[f]] for r in rows]].T for f in range(len(FEATURES)))

    def decode(self, rows: list[tuple[str, ...]]) -> list[int]:
        """The most probable states (Viterbi)."""
        e = [self._emitted(r) for r in rows]
        if not e:
            return []
        (m00, m01, m02, m03), (m10, m11, m12, m13), (m20, m21, m22, m23), (m30, m31, m32, m33) = self._moves()
        a, b, c, d = [float(x) + y for x, y in zip(self.start, e[0])]
        back = []
        for e0, e1, e2, e3 in e[1:]:
            # the best predecessor of each state; ties go to the earlier state
            k0, v0 = 0, a + m00
            k1, v1 = 0, a + m01
            k2, v2 = 0, a + m02
            k3, v3 = 0, a + m03
            for p, x, (y0, y1, y2, y3) in ((1, b, (m10, m11, m12, m13)), (2, c, (m20, m21, m22, m23)), (3, d, (m30, m31, m32, m33))):
                if x + y0 > v0:
                    k0, v0 = p, x + y0
                if x + y1 > v1:
                    k1, v1 = p, x + y1
                if x + y2 > v2:
                    k2, v2 = p, x + y2
                if x + y3 > v3:
                    k3, v3 = p, x + y3
            back.append((k0, k1, k2, k3))
            a, b, c, d = v0 + e0, v1 + e1, v2 + e2, v3 + e3
        best = [a, b, c, d]
        path = [best.index(max(best))]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def _moves(self) -> list[list[float]]:
        if not hasattr(self, "_move_list"):
            self._move_list = self.move.tolist()
            self._emit_cache: dict[tuple[str, ...], list[float]] = {}
        return self._move_list

    def _emitted(self, row: tuple[str, ...]) -> list[float]:
        self._moves()
        got = self._emit_cache.get(row)
        if got is None:
            got = self._emit_cache[row] = [float(sum(self.emit[f][s, _INDEX[f][row[f]]] for f in range(len(FEATURES)))) for s in range(len(STATES))]
        return got


# --- words --------------------------------------------------------------------------------------------------------------------

# What a scanner reads, and what may stand there.
CONFUSIONS = (
    ("c", "e"), ("0", "o"), ("!", "i"), ("5", "s"), ("ii", "n"), ("@", "a"), ("1", "l"), ("li", "h"), ("vv", "w"), ("cl", "d"), ("rn", "m"), ("ii", "u"), ("9", "g"), ("b", "h"),
    ("m", "in"), ("6", "b"), ("8", "b"), ("$", "s"), ("|", "l"), ("1", "i"), ("!", "l"), ("ri", "n"), ("tl", "d"), ("q", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("€", "e"), ("nn", "m"), ("m", "rn"), ("I", "l"),
)
_EDGE = ".,;:()[]{}<>\"“”„‘’'?*•·–—-‐¬­_~/\\|»«†‡#…"
_DIGIT = re.compile(r"\d")


def tokens(text: str) -> list[str]:
    """Lower-case tokens between blanks, without the signs at their ends."""
    return [w for x in text.lower().split() if (w := x.strip(_EDGE))]


class Frequent(dict):
    """Frequent words with their counts, and by length."""

    def of_size(self, size: int) -> list[str]:
        """The words whose length differs by two at most, which is as much as two confusions change."""
        if not hasattr(self, "_sizes"):
            self._sizes: dict[int, list[str]] = {}
            for w in self:
                self._sizes.setdefault(len(w), []).append(w)
        return [w for n in range(size - 2, size + 3) for w in self._sizes.get(n, ())]


def confusable(token: str) -> list[tuple[int, str, str]]:
    """(place, read, true) of each confusion that a token may hold; they may overlap."""
    return [(at, read, true) for read, true in CONFUSIONS if read in token for at in range(len(token)) if token.startswith(read, at)]


def undone(token: str, spots: list[tuple[int, str, str]], most: int) -> Iterator[str]:
    """The token with one confusion undone, then with two (`most`)."""
    for at, read, true in spots:
        yield token[:at] + true + token[at + len(read) :]
    if most > 1:
        for (a, ra, ta), (b, rb, tb) in product(spots, spots):
            if a + len(ra) <= b:
                yield token[:a] + ta + token[a + len(ra) : b] + tb + token[b + len(rb) :]


def reads_as(token: str, word: str, most: int) -> bool:
    """Whether a token with at most so many confusions undone is the word. What a scanner reads and what stands there
    never begin alike, so a confusion is where the two first differ."""
    at = next((i for i, (a, b) in enumerate(zip(token, word)) if a != b), min(len(token), len(word)))
    if at == len(token) == len(word):
        return True
    return most > 0 and any(token.startswith(r, at) and word.startswith(t, at) and reads_as(token[at + len(r) :], word[at + len(t) :], most - 1) for r, t in CONFUSIONS)


#: Places of confusions in a token up to which undoing all pairs costs less than reading all words of its length.
_SPOTS = 40


def misread_as(token: str, count: int, frequent: Frequent) -> str | None:
    """The frequent word that a token misreads: by the fewest confusions, then the most frequent, then the first."""
    solid = sum(c.isalpha() for c in token)
    if len(token) < 2 or solid == 0 or (len(token) == 2 and not any(c in "0@!" for c in token)):
        return None
    if len(token) - solid > max(1, len(token) // 2):
        return None
    near = frequent.of_size(len(token)) if len(token) > _SPOTS // 2 else None
    if near is not None and not near:
        return None
    spots = confusable(token)
    for tries in (1, 2):
        if near is not None and len(spots) > _SPOTS:
            found = {v for v in near if reads_as(token, v, tries)} - {token}
        else:
            found = set(undone(token, spots, tries))
        found = {v for v in found if len(v) >= 2 and frequent.get(v, 0) >= RATIO * count}
        if found:
            return min(found, key=lambda v: (-frequent[v], v))
    return None


def frequent_words(df: DataFrame, text: str, share: float = SHARE) -> tuple[DataFrame, Frequent]:
    """All distinct tokens with their counts (a table), and those with at least `share` of all tokens (at most
    1 / share of them)."""
    counts = cut_lineage(count_words(df, text, tokens))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(LEAST_COUNT, share * total)
    rows = collect_bounded(counts.where(F.col("n") >= bound), int(1 / share) + 1, "frequent words")
    return counts, Frequent({r["word"]: r["n"] for r in rows})


def misreadings(counts: DataFrame, frequent: Frequent) -> DataFrame:
    """(token, word): each distinct token that misreads a frequent word."""
    held = counts.sparkSession.sparkContext.broadcast(frequent)

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"token": [], "word": []}
        for w, n in zip(cols["word"], cols["n"]):
            if (v := misread_as(w, n, held.value)) is not None:
                out["token"].append(w)
                out["word"].append(v)
        return out

    return map_columns(counts.select("word", "n"), kernel, "token string, word string")


# --- pages --------------------------------------------------------------------------------------------------------------------


def broken_to_width(text: str) -> bool:
    """Whether a page's lines look broken to a width: most lines that are followed by another stop inside a sentence."""
    lines = [x.rstrip() for x in text.split("\n")]
    inner = [a for a, b in zip(lines, lines[1:]) if a.strip() and b.strip()]
    return len(inner) >= 2 and max(map(len, lines)) <= 100 and sum(not a.endswith((".", "!", "?", ":", "।", "|")) for a in inner) >= 0.6 * len(inner)


def _lined(body: list[str]) -> bool:
    """Whether body lines are items or rows rather than running text broken to a width."""
    rows = sum([not x.endswith(_STOPS) and (x[0].isupper() or x[0].isdigit() or len(x) <= 400 and _CUTS.search(x) is not None or _ITEM.match(x) is not None) for x in body])
    return len(body) >= 3 and rows >= 0.7 * len(body)


class Page:
    """A labelled page: its noise and its text."""

    def __init__(self, text: str, model: Model, frequent: Frequent) -> None:
        if not text.isascii():
            text = lookalikes.normalise(encoding.restore(text)[0])
        self.frequent = frequent
        self.lines = text.split("\n")
        self.labels = [STATES[s] for s in model.decode(line_features(text))]
        self.hyphens = 0
        self.paragraphs: list[str] = []
        body = [x.strip() for x, label in zip(self.lines, self.labels) if label == "body" and x.strip()]
        if _lined(body):  # a list or table: its lines are its paragraphs
            self.paragraphs = body
            return
        parts: list[str] = []  # of the paragraph at hand
        left = None  # the last part's word before a sign at its end
        for line, label in zip(self.lines, self.labels):
            if label in ("header", "page_no"):
                continue
            if label == "break":
                if parts and not left:
                    self.paragraphs.append("".join(parts))
                    parts = []
                continue
            bare = line.strip()
            if left and (m := _LEAD.match(bare)):
                if self._broken(left.group(1), left.group(2), m.group(1), frequent):
                    self.hyphens += 1
                    parts[-1] = parts[-1][: left.start(2)]
                else:
                    parts[-1] = parts[-1][: left.end(2)]
                parts.append(bare)
            elif parts and _ITEM.match(bare):
                self.paragraphs.append("".join(parts))
                parts = [bare]
            else:
                parts += [" ", bare] if parts else [bare]
            left = _HYPHEN.search(bare) if bare.endswith(_SIGNS) else None
        if parts:
            self.paragraphs.append("".join(parts))

    @staticmethod
    def _broken(left: str, sign: str, right: str, frequent: Frequent) -> bool:
        """Whether the sign breaks one word, rather than join two."""
        if sign != "-":
            return True
        a, b = left.lower(), right.lower()
        whole, compound = frequent.get(a + b, 0), frequent.get(f"{a}-{b}", 0)
        if whole or compound:
            return whole >= compound
        for form in (a + b, f"{a}-{b}"):
            if misread_as(form, 1, frequent):
                return "-" not in form
        return not (frequent.get(a, 0) and frequent.get(b, 0)) or len(a) <= 2 or len(b) <= 2

    def words(self) -> set[str]:
        """The distinct tokens of the running text; none where less than half of them are frequent words, as in
        tables and noise."""
        found = {w for p in self.paragraphs for w in tokens(p)}
        return found if 2 * len(found & self.frequent.keys()) >= len(found) else set()

    def text(self, wrong: dict[str, str]) -> str:
        wrong = wrong if self.words() else {}

        def fix(x: str) -> str:
            bare = x.strip(_EDGE)
            word = wrong.get(bare.lower())
            if not word:
                return x
            word = word.upper() if bare.isupper() and len(bare) > 1 else word.capitalize() if bare[:1].isupper() else word
            at = x.index(bare)
            return x[:at] + word + x[at + len(bare) :]

        return "\n\n".join(" ".join(map(fix, p.split())) for p in self.paragraphs)


def _may_be_scanned(text: str, scanned: str) -> Column:
    """Pages that may be scanned; `scanned` null means that the layout decides."""
    return F.col(text).isNotNull() & F.coalesce(F.col(scanned), F.lit(True))


def _takes(text: str | None, scanned: bool | None) -> bool:
    return bool(text) and bool(text.strip()) and (scanned is True or (scanned is None and broken_to_width(text)))


def _prepare(df: DataFrame, text: str) -> tuple[Broadcast, DataFrame, bool]:
    """(model, frequent words and known misreadings) for all tasks; the misreadings; whether those are few. Known ones
    are None beyond BROADCAST_ROWS."""
    counts, frequent = frequent_words(df, text)
    wrong = cut_lineage(misreadings(counts, frequent))
    small = wrong.count() <= BROADCAST_ROWS
    known = {r["token"]: r["word"] for r in wrong.collect()} if small else None
    return df.sparkSession.sparkContext.broadcast((Model(), frequent, known)), wrong, small


def find_noise(df: DataFrame, key: str, text: str, scanned: str) -> DataFrame:
    """(key, noise): each kind of noise that a scanned page holds."""
    held, wrong, small = _prepare(df, text)
    key_type = df.schema[key].dataType.simpleString()

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        model, frequent, known = held.value
        out: dict[str, list] = {key: [], "noise": [], "tokens": []}
        for k, t, s in zip(cols[key], cols[text], cols[scanned]):
            if not _takes(t, s):
                continue
            page = Page(t, model, frequent)
            found = [n for n in ("header", "page_no") if n in page.labels]
            if page.hyphens:
                found.append("hyphen")
            rest = None
            if known is None:
                rest = sorted(page.words())
            elif not known.keys().isdisjoint(page.words()):
                found.append("misread")
            for n in found:
                for name, v in zip(out, (k, n, None)):
                    out[name].append(v)
            if rest:
                for name, v in zip(out, (k, "words", rest)):
                    out[name].append(v)
        return out

    pages = df.select(key, text, scanned).where(_may_be_scanned(text, scanned))
    made = map_columns(pages, kernel, f"`{key}` {key_type}, noise string, tokens array<string>")
    if small:
        return made.drop("tokens")
    made = cut_lineage(made)
    misread = made.where(F.col("noise") == "words").select(key, F.explode("tokens").alias("token")).join(wrong, "token", "left_semi")
    return made.where(F.col("noise") != "words").drop("tokens").unionByName(misread.select(key, F.lit("misread").alias("noise")).distinct())


def _own_misreadings(pages: DataFrame, held: Broadcast, wrong: DataFrame) -> DataFrame:
    """(_h, _wrong): the misreadings on each of the pages (_h: the text's digest, _text, _scanned)."""

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        model, frequent, _ = held.value
        rows = [(h, w) for h, t, s in zip(cols["_h"], cols["_text"], cols["_scanned"]) if _takes(t, s) for w in Page(t, model, frequent).words()]
        return {"_h": [h for h, _ in rows], "token": [w for _, w in rows]}

    own = map_columns(pages, kernel, "_h string, token string").join(wrong, "token")
    return own.groupBy("_h").agg(F.map_from_entries(F.collect_set(F.struct("token", "word"))).alias("_wrong"))


def repair(df: DataFrame, key: str, text: str, scanned: str) -> DataFrame:
    """(key, text): every scanned page as paragraphs of whole words without furniture. Pages that are not scanned come
    back as they are. Beyond BROADCAST_ROWS distinct misreadings, each page that may be scanned gets its own by a join
    on its text's digest; the others do not move."""
    held, wrong, small = _prepare(df, text)
    key_type = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(scanned).alias("_scanned"))
    none = F.lit(None).cast("map<string,string>").alias("_wrong")
    if small:
        source = source.select("*", none)
    else:
        may = _may_be_scanned("_text", "_scanned")
        pages = source.where(may).withColumn("_h", F.md5("_text"))
        own = _own_misreadings(pages.select("_h", "_text", "_scanned"), held, wrong)
        source = pages.join(own, "_h", "left").drop("_h").unionByName(source.where(~may).select("*", none))

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        model, frequent, known = held.value
        made = []
        for t, s, own in zip(cols["_text"], cols["_scanned"], cols["_wrong"]):
            wrong = known if known is not None else dict(own or ())
            made.append(Page(t, model, frequent).text(wrong) if _takes(t, s) else t)
        return {key: cols["_key"], text: made}

    return map_columns(source, kernel, f"`{key}` {key_type}, `{text}` string")
