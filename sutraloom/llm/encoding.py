"""Text decoded with the wrong character encoding: find the spans, give back the text as first written.

Method: characters are mapped back to the bytes of a legacy encoding, an automaton over those bytes finds the
longest well-formed UTF-8 spans of multibyte characters, and only those spans are decoded. Repeated until nothing
changes, so that twice-garbled text is restored too. U+FFFD marks what cannot be restored.

Defined results: null text gives null and no finding; empty text and text without a span come back unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.runtime import fresh_name, map_columns

#: Legacy encodings tried, in order of preference for spans of one length.
CODECS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15")
#: Times that one text may have been garbled.
MAX_ROUNDS = 4
LOST = "�"

# The automaton: state -> (first byte, last byte) -> next state. 0 is both start and end of a character.
_STEPS = {
    0: ((0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)),
    1: ((0x80, 0xBF, 0),),
    2: ((0xA0, 0xBF, 1),),
    3: ((0x80, 0xBF, 1),),
    4: ((0x80, 0x9F, 1),),
    5: ((0x90, 0xBF, 3),),
    6: ((0x80, 0xBF, 3),),
    7: ((0x80, 0x8F, 3),),
}


@lru_cache(maxsize=1)
def automaton() -> list[list[int]]:
    """Transition table [state][byte]; -1 where the byte structure breaks."""
    rows = []
    for state in range(8):
        row = [-1] * 256
        for low, high, to in _STEPS[state]:
            row[low : high + 1] = [to] * (high + 1 - low)
        rows.append(row)
    return rows


@lru_cache(maxsize=1)
def byte_maps() -> dict[str, dict[str, int]]:
    """For each legacy encoding: character -> byte, for bytes of 0x80 and above. Bytes that the encoding leaves
    open count as the control characters of the same number, as browsers read them."""
    maps = {}
    for codec in CODECS:
        back = {chr(b): b for b in range(0x80, 0xA0)}
        for b in range(0x80, 0x100):
            try:
                back[bytes([b]).decode(codec)] = b
            except UnicodeDecodeError:
                pass
        maps[codec] = back
    return maps


def _char_class(chars: set[str]) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(chars)) + "]"


def lead_and_after() -> tuple[set[str], set[str]]:
    """Characters that stand for a leading byte in one of the encodings, and those that stand for a following byte."""
    leads = {c for back in byte_maps().values() for c, b in back.items() if 0xC2 <= b <= 0xF4}
    after = {c for back in byte_maps().values() for c, b in back.items() if 0x80 <= b <= 0xBF}
    return leads, after


@lru_cache(maxsize=1)
def suspect() -> re.Pattern:
    """What every text with a span or a lost character matches: a character that stands for a leading byte in one of
    the encodings, then one that stands for a following byte."""
    leads, after = lead_and_after()
    return re.compile(f"{LOST}|{_char_class(leads)}(?={_char_class(after)})")


def _common(c: str) -> bool:
    """Characters that may stand alone among Latin, Greek or Indic letters. Those of other scripts must come in runs:
    a dash or quote next to an accented letter has the bytes of one Cyrillic or Armenian letter."""
    o = ord(c)
    return o < 0x0180 or 0x0370 <= o < 0x0400 or 0x0900 <= o < 0x0E00 or 0x1E00 <= o < 0x2200 or c in "ƒˆ˜\ufeffﬁﬂ" or unicodedata.category(c)[0] == "S"


def plausible(text: str) -> bool:
    """Whether decoded characters can be text: no unassigned, private or control characters, and no letter of a
    far script on its own (which chance sequences of accented letter and sign decode to). Control characters of the
    upper half may stand: text garbled twice has them until its next round."""
    if any(unicodedata.category(c) in ("Cn", "Co", "Cs") or c < " " or c == "\x7f" for c in text):
        return False
    far = sum(not _common(c) for c in text)
    return far == 0 or (far >= 3 and far * 2 > len(text))


def spans(text: str) -> list[tuple[int, int, str]]:
    """Maximal well-formed spans as (start, end, decoded), left to right; the longest span of any encoding wins."""
    found, done, n, table, maps = [], 0, len(text), automaton(), byte_maps()
    for m in suspect().finditer(text):
        i = m.start()
        if i < done:
            continue
        best = None
        for back in maps.values():
            state, j, end, raw = 0, i, i, bytearray()
            while j < n and (b := back.get(text[j])) is not None and (state := table[state][b]) >= 0:
                raw.append(b)
                j += 1
                if state == 0:
                    end = j
            if end > i and (best is None or end > best[0]):
                decoded = bytes(raw[: end - i]).decode("utf-8")
                if plausible(decoded):
                    best = (end, decoded)
        if best:
            found.append((i, best[0], best[1]))
            done = best[0]
    return found


def restore(text: str | None, rounds: int = MAX_ROUNDS) -> tuple[str | None, int, int]:
    """The text with all spans decoded, the number of spans, the number of lost characters."""
    if text is None:
        return None, 0, 0
    if text.isascii():
        return text, 0, 0
    count = 0
    for _ in range(rounds):
        hits = spans(text)
        if not hits:
            break
        count += len(hits)
        pieces, at = [], 0
        for start, end, decoded in hits:
            pieces += [text[at:start], decoded]
            at = end
        text = "".join([*pieces, text[at:]])
    return text, count, text.count(LOST)


def outside(text: str) -> list[tuple[str, bool]]:
    """Pieces of text as (piece, whether it is garbled): spans and lost characters apart from the rest."""
    if text.isascii() or not (hits := spans(text)):
        return [(text, False)]
    pieces, at = [], 0
    for start, end, _ in hits:
        pieces += [(text[at:start], False), (text[start:end], True)]
        at = end
    return [p for p in [*pieces, (text[at:], False)] if p[0]]


def with_repaired(df: DataFrame, text: str, out: str = "repaired") -> DataFrame:
    """df with `out` (text restored where it was garbled), `<out>_spans` and `<out>_lost`. Texts without a garbled
    character come back from Python as null and are taken over in the JVM. Rows and other columns are kept."""

    @F.pandas_udf("struct<t string, n int, lost int>")
    def fix(s: pd.Series) -> pd.DataFrame:
        made = [restore(x) for x in s]
        return pd.DataFrame([(t if n else None, n, lost) for t, n, lost in made], columns=["t", "n", "lost"])

    tmp = fresh_name(df, "_fix")
    made = df.withColumn(tmp, fix(F.col(text)))
    return (
        made.withColumn(out, F.coalesce(F.col(f"{tmp}.t"), F.col(text)))
        .withColumn(f"{out}_spans", F.col(f"{tmp}.n"))
        .withColumn(f"{out}_lost", F.col(f"{tmp}.lost"))
        .drop(tmp)
    )


def repair_encoding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text restored, spans, lost) of each record that holds garbled characters, restorable or not."""
    key_type = df.schema[key].dataType.simpleString()

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {key: [], text: [], "spans": [], "lost": []}
        for k, t in zip(cols[key], cols[text]):
            fixed, n, lost = restore(t)
            if n or lost:
                for name, v in ((key, k), (text, fixed), ("spans", n), ("lost", lost)):
                    out[name].append(v)
        return out

    return map_columns(
        df.select(key, text), kernel, f"`{key}` {key_type}, `{text}` string, spans int, lost int"
    )
