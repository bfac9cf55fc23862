"""Column functions for text: cleaning, gates, splitting. All stay in the JVM; a null text gives null.

Word characters are letters, numbers and the underscore of any script; blanks are Unicode's. The regular expressions
state both, as the JVM's own shorthand classes are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
# Fixed value: Unicode's blanks.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Marks of page and volume numbers and of scanning, each of which becomes one blank, in this order.
OCR_MARKS = (
    r"(?U)Vol\.\s*Page\.",
    r"(?U)Vol\.\s*Rage\.",
    r"(?U)Page\.\s*\d+",
    r"(?U)\d+\s*Vol\.",
    r"INDEX\.",
    r"i{2,}",
    r"\^+",
    r"\.{3,}",
    r"(?U)\s{3,}",
    r"[■□●○▪▫◆◇★☆]+",
    r"\x{fffd}+",
    r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]",
)
# Letters with an apostrophe that stand for other spellings.
APOSTROPHES = (("S'", "Sh"), ("s'", "sh"), ("A'", "A"), ("a'", "a"))
# Letters fused into one character.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"))
# Fixed value: letters that may stand spaced out.
SPACED = "a-zA-Zāīūṛṝḷḹēōṃḥṅñṭḍṇśṣ"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once. An expression that a lambda mentions is computed anew for each element,
    and one that is mentioned twice may be computed twice; a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Every run of blanks as one plain blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Tokens between blanks; an empty array for a blank text."""
    return let(squeeze(c), lambda flat: F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ")))


def replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def ligatures(c: Column) -> Column:
    return replace_all(c, LIGATURES)


def drop_intrusive(c: Column) -> Column:
    """Signs that scanning put between word characters."""
    return F.regexp_replace(c, rf"[\^<>*~¬¦§¶](?<={W}.)[\^<>*~¬¦§¶]*(?={W})", "")


def join_spaced_letters(c: Column) -> Column:
    """Runs of two or more single letters with a blank after each become one word; the last blank goes, too."""
    return F.regexp_replace(c, rf" (?:(?<=(?<!{W}){W} )(?={W}\s)|(?<=(?<!{W}){W}\s{W} ))", "")


def join_spaced_pairs(c: Column) -> Column:
    """A single letter joins the next one if that one is followed by a blank."""
    return F.regexp_replace(c, rf"(?<!{W})([{SPACED}]) +(?=[{SPACED}]\s)", "$1")


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)-\s*\n\s*", "")


def rejoin_broken(c: Column) -> Column:
    return F.regexp_replace(c, rf"({W}+)-\s*\n\s*({W}+)", "$1$2")


def drop_repeated_words(c: Column) -> Column:
    """A word that follows itself, in any case, stays once."""
    return F.regexp_replace(c, rf"(?iu)(?<!{W})({W}++)(?:\s+\1)+(?!{W})", "$1")


def drop_repeated_signs(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?![a-zA-Z0-9 ])([^\p{L}\p{N}_\s])\1{2,}", "$1")


def drop_single_letters(c: Column) -> Column:
    # the letter first: what is tried at every place should fail soon
    return F.regexp_replace(c, rf"[a-zA-Z](?!{W})(?<!{W}[a-zA-Z])", "")


def drop_page_marks(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?m)(?<!{W})\d+\s*\|\s*Page(?!{W})|\[Page\s+\d+\]|^[\d\s|]+$", "")


def drop_devanagari(c: Column) -> Column:
    return F.regexp_replace(c, r"[ऀ-ॿ]+", " ")


def ocr_clean(c: Column, repair: Callable[[Column], Column] | None = None) -> Column:
    """Marks of scanning, single letters, apostrophe spellings, blanks and repeated signs, in this order; before them
    the caller's repair of wrong encodings, if any."""
    c = repair(c) if repair else c
    for pattern in OCR_MARKS:
        c = F.regexp_replace(c, pattern, " ")
    return F.btrim(drop_repeated_signs(squeeze(replace_all(drop_single_letters(c), APOSTROPHES))))


# --- gates ---------------------------------------------------------------------------------------------------------------


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.lit(1), F.length(c))


_SIGNS = r"[^a-zA-Z0-9\s.,;:'\"!?()-]"


def symbol_share(c: Column) -> Column:
    return _share(c, _SIGNS)


def latin_share(c: Column) -> Column:
    return _share(c, "[a-zA-Z]")


def is_gibberish(c: Column) -> Column:
    """Of a line without Devanagari: more than a quarter of signs, or less than two fifths of Latin letters."""
    return let(c, lambda x: (symbol_share(x) > 0.25) | (latin_share(x) < 0.4))


def is_foreign(c: Column) -> Column:
    return let(c, lambda x: (symbol_share(x) > 0.3) | (latin_share(x) < 0.4))


def is_noise(c: Column) -> Column:
    """Fewer than three Latin words, and less than a quarter of letters and digits."""

    def judge(x: Column) -> Column:
        solid = F.regexp_count(x, F.lit("[a-zA-Z0-9]"))
        return (F.regexp_count(x, F.lit("[a-zA-Z]+")) < 3) & ((solid == 0) | (solid / F.greatest(F.lit(1), F.length(x)) < 0.25))

    return let(c, judge)


def is_meaningful(c: Column, min_words: int = 5, min_mean_length: float = 2.5) -> Column:
    """At least 20 characters, `min_words` words of `min_mean_length` on average, and 70 % letters and blanks."""
    def long_enough(w: Column) -> Column:
        letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        return (F.size(w) >= min_words) & (letters >= F.size(w) * min_mean_length)

    readable = F.regexp_count(c, F.lit(r"(?U)[\p{L}\s]"))
    ok = (F.length(strip(c)) >= 20) & (readable >= F.length(c) * 0.7) & let(words(c), long_enough)
    return F.coalesce(ok, F.lit(False))


def readable_tokens(c: Column, longest: int = 25) -> Column:
    """Tokens of plain letters, digits and signs, at least four fifths of which are letters or digits."""
    plain = lambda t: F.regexp_like(t, F.lit(r"^[A-Za-z0-9.,;:()'\"-]+$")) & (F.length(t) <= longest) & (F.regexp_count(t, F.lit("[A-Za-z0-9]")) >= F.length(t) * 0.8)
    return F.array_join(F.filter(words(c), plain), " ")


def or_raw(clean: Column, raw: Column) -> Column:
    """The cleaned text, or the raw one where cleaning left nothing."""
    return F.when(strip(clean) == "", raw).otherwise(clean)


# --- sentences -----------------------------------------------------------------------------------------------------------


def sentences(c: Column) -> Column:
    return F.split(c, r"(?U)\s(?<=[.!?]\s)\s*")


def capitalise(c: Column) -> Column:
    return let(c, lambda x: F.when(F.length(x) > 1, F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))).otherwise(x))


def paragraphs(sentence_list: Column, size: int = 3) -> Column:
    """Every `size` sentences joined by blanks, the groups by a blank line."""

    def join(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(xs) - 1), F.lit(size))
        return F.array_join(F.transform(starts, lambda i: F.array_join(F.slice(xs, i + 1, size), " ")), "\n\n")

    return let(sentence_list, join)


# --- transliteration and term keys -------------------------------------------------------------------------------------------

# Letters with diacritics in plain letters.
IAST = (
    ("ā", "aa"), ("ī", "ii"), ("ū", "uu"), ("ṛ", "ri"), ("ṝ", "rri"), ("ḷ", "li"), ("ḹ", "lli"), ("ṅ", "n"), ("ñ", "n"),
    ("ṭ", "t"), ("ḍ", "d"), ("ṇ", "n"), ("ś", "sh"), ("ṣ", "sh"), ("ṃ", "m"), ("ḥ", "h"),
)
# The public one-letter code of Sanskrit sounds (SLP1) in letters with diacritics (IAST).
SLP1 = {
    "a": "a", "A": "ā", "i": "i", "I": "ī", "u": "u", "U": "ū", "f": "ṛ", "F": "ṝ", "x": "ḷ", "X": "ḹ", "e": "e", "E": "ai", "o": "o", "O": "au",
    "M": "ṃ", "H": "ḥ", "k": "k", "K": "kh", "g": "g", "G": "gh", "N": "ṅ", "c": "c", "C": "ch", "j": "j", "J": "jh", "Y": "ñ", "w": "ṭ", "W": "ṭh",
    "q": "ḍ", "Q": "ḍh", "R": "ṇ", "t": "t", "T": "th", "d": "d", "D": "dh", "n": "n", "p": "p", "P": "ph", "b": "b", "B": "bh", "m": "m",
    "y": "y", "r": "r", "l": "l", "v": "v", "S": "ś", "z": "ṣ", "s": "s", "h": "h", "L": "ḻ",
}


def iast_to_plain(c: Column) -> Column:
    return replace_all(c, IAST)


def underscored(c: Column) -> Column:
    """Hyphens and blanks as single underscores, none at the ends."""
    joined = F.regexp_replace(F.regexp_replace(c, r"(?U)-|\s+", "_"), "_+", "_")
    return F.btrim(joined, F.lit("_"))


def term_to_ascii(c: Column) -> Column:
    return F.lower(underscored(iast_to_plain(c)))


def term_key(c: Column) -> Column:
    """Lower case; each run of blanks and each hyphen is an underscore of its own."""
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s+|-", "_"))


def slp1_word(c: Column) -> Column:
    """A dictionary word in letters only; null for fewer than three letters or no vowel."""
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), "[-—]", ""), "srs+", ""), "[^a-zA-Z]", "")
    return let(made, lambda bare: F.when((F.length(bare) >= 3) & F.regexp_like(bare, F.lit("[aAiIuUfFxXeEoO]")), bare))


def slp1_to_iast(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SLP1.items() for x in pair])
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a word between # marks."""

    def cut(marked: Column) -> Column:
        last = F.length(marked) - 2
        made = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(marked, i, F.lit(3))))
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))

    return let(F.concat(F.lit("#"), c, F.lit("#")), cut)
