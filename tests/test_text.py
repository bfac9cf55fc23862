"""Column functions against plain Python on random strings, and golden rows for their quirks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sutraloom.functions import text as T
from sutraloom.functions.unicode import nfkc, with_nfkc, without_accents


def strings(n, alphabet, seed=0, longest=24):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)] + [""]


def run(spark, rows, f):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").select("v").collect()]


def is_word(c):
    return c.isalnum() or c == "_"


def runs(s, kind):
    """(kind of a run, its text) of the runs of characters of one kind."""
    return [(k, "".join(g)) for k, g in itertools.groupby(s, key=kind)]


def drop_intrusive(s):
    parts = runs(s, lambda c: "sign" if c in "^<>*~¬¦§¶" else "word" if is_word(c) else "other")
    inner = [i for i in range(1, len(parts) - 1) if parts[i][0] == "sign" and parts[i - 1][0] == parts[i + 1][0] == "word"]
    return "".join(t for i, (_, t) in enumerate(parts) if i not in inner)


def join_spaced(s):
    out, i = [], 0
    while i < len(s):
        j = i
        while j + 1 < len(s) and is_word(s[j]) and s[j + 1].isspace() and (j == 0 or not is_word(s[j - 1])):
            j += 2
        if j - i >= 4:
            out.append(s[i:j].replace(" ", ""))
            i = j
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def dehyphenate(s):
    parts = runs(s, lambda c: "space" if c.isspace() else "-" if c == "-" else "other")
    out = []
    for k, t in parts:
        if k == "space" and "\n" in t and out and out[-1].endswith("-"):
            out[-1] = out[-1][:-1]
        else:
            out.append(t)
    return "".join(out)


def drop_repeated_words(s):
    parts = runs(s, lambda c: "word" if is_word(c) else "space" if c.isspace() else "other")
    out = []
    for k, t in parts:
        if k == "word" and len(out) > 1 and out[-1][0] == "space" and out[-2][0] == "word" and out[-2][1].lower() == t.lower():
            out.pop()
        else:
            out.append((k, t))
    return "".join(t for _, t in out)


def drop_repeated_signs(s):
    return "".join(t[0] if len(t) >= 3 and not is_word(t[0]) and not t[0].isspace() else t for t in ("".join(g) for _, g in itertools.groupby(s)))


def drop_single_letters(s):
    return "".join(t for k, t in runs(s, is_word) if not (k and len(t) == 1 and t.isascii() and t.isalpha()))


LETTERS = "aAbis ā.-' \n"
CASES = {
    "intrusive": (T.drop_intrusive, drop_intrusive, "ab ^~¬ā_1"),
    "spaced": (T.join_spaced_letters, join_spaced, "ab ā  "),
    "dehyphenate": (T.dehyphenate, dehyphenate, "ab- \n"),
    "repeated words": (T.drop_repeated_words, drop_repeated_words, "abA  "),
    "repeated signs": (T.drop_repeated_signs, drop_repeated_signs, "a.-—! "),
    "single letters": (T.drop_single_letters, drop_single_letters, LETTERS),
    "squeeze": (T.squeeze, lambda s: " ".join(s.split()), "ab \n\t\xa0 "),
    "strip": (T.strip, lambda s: s.strip(), "a \n\xa0 "),
    "devanagari": (T.drop_devanagari, lambda s: "".join(" " if k else t for k, t in runs(s, lambda c: "\u0900" <= c <= "\u097f")), "aक ्ख"),
    "underscored": (T.underscored, lambda s: "_".join(t for t in s.replace("-", " ").replace("_", " ").split()), "ab-_ "),
    "term key": (T.term_key, lambda s: "".join("_" if k else t for k, t in runs(s.strip(), str.isspace)).replace("-", "_").lower(), "aB- "),
}


def rejoin(s):
    """Walks from hyphen to hyphen; a word that was the right half of a break is not the left half of the next."""
    out, done, i = "", 0, s.find("-")
    while i >= 0:
        k = i + 1
        while k < len(s) and s[k].isspace():
            k += 1
        e = k
        while e < len(s) and is_word(s[e]):
            e += 1
        if i > done and is_word(s[i - 1]) and "\n" in s[i:k] and e > k:
            out, done = out + s[done:i] + s[k:e], e
        i = s.find("-", max(i + 1, done))
    return out + s[done:]


def page_marks(s):
    def skip(i, kind):
        while i < len(s) and kind(s[i]):
            i += 1
        return i

    def mark(p):
        """End of a mark that begins at p, or p."""
        d = skip(p, str.isdigit)
        bar = skip(d, str.isspace)
        if d > p and not (p and is_word(s[p - 1])) and s[bar : bar + 1] == "|":
            word = skip(bar + 1, str.isspace)
            if s[word : word + 4] == "Page" and not is_word(s[word + 4 : word + 5] or " "):
                return word + 4
        if s.startswith("[Page", p):
            d = skip(p + 5, str.isspace)
            e = skip(d, str.isdigit)
            if d > p + 5 and e > d and s[e : e + 1] == "]":
                return e + 1
        if p == 0 or s[p - 1] == "\n":
            e = skip(p, lambda c: c.isdigit() or c.isspace() or c == "|")
            return max([k for k in range(p + 1, e + 1) if k == len(s) or s[k] == "\n"], default=p)
        return p

    out, p = "", 0
    while p < len(s):
        e = mark(p)
        out, p = (out, e) if e > p else (out + s[p], p + 1)
    return out


CASES["rejoin_broken"] = (T.rejoin_broken, rejoin, ["ab", "-", "-", "\n", " ", "c1", "."])
CASES["drop_page_marks"] = (T.drop_page_marks, page_marks, ["12", "3", " ", "|", " | ", "\n", "Page", "Pages", "[Page 4]", "[Page", "]", "x"])


@pytest.mark.parametrize("name", sorted(CASES))
def test_like_python(spark, name):
    column, python, alphabet = CASES[name]
    rows = strings(3000, alphabet, seed=len(name))
    got = run(spark, rows, column)
    wrong = [(s, g, python(s)) for s, g in zip(rows, got) if g != python(s)]
    assert not wrong, wrong[:3]


def test_words_like_python(spark):
    rows = strings(1000, "ab \n\xa0")
    assert run(spark, rows, T.words) == [s.split() for s in rows]


def test_gates(spark):
    latin = lambda c: c.isascii() and c.isalpha()

    def noise(line):
        solid = sum(latin(c) or c.isascii() and c.isdigit() for c in line)
        return sum(k for k, _ in runs(line, latin)) < 3 and (solid == 0 or 4 * solid < len(line))

    def meaningful(t):
        w = t.split()
        readable = sum(c.isalpha() or c.isspace() for c in t)
        return len(t.strip()) >= 20 and len(w) >= 5 and sum(map(len, w)) >= 2.5 * len(w) and readable >= 0.7 * len(t)

    rows = strings(2000, "aB1 .#|", longest=30)
    assert run(spark, rows, T.is_noise) == [noise(s) for s in rows]
    rows = strings(2000, "abcdefg  .1", longest=60) + ["good words make a sentence here"]
    assert run(spark, rows, T.is_meaningful) == [meaningful(s) for s in rows]


def test_filters_for_foreign_lines_and_noise_follow_from_the_script_filter(spark):
    rows = strings(4000, "aB1 .#|é", longest=30)
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    left = df.where(~T.is_gibberish(F.col("s")))
    assert left.where(T.is_foreign(F.col("s")) | T.is_noise(F.col("s"))).count() == 0


def test_quirks(spark):
    one = lambda s, f: run(spark, [s], f)[0]
    assert one("s u t r a was", T.join_spaced_letters) == "sutrawas"
    assert one("a - b", T.term_key) == "a___b"
    assert one("a [Page 3] 12 | Page b\n 1 | 2 \nc", T.drop_page_marks) == "a   b\n\nc" and one("x12 | Pages", T.drop_page_marks) == "x12 | Pages"
    assert one("over-\n turn and well-\nknown", T.rejoin_broken) == "overturn and wellknown" and one("end -\nx", T.rejoin_broken) == "end -\nx"
    assert one("word's S'ira A'yur", lambda c: T.replace_all(c, T.APOSTROPHES)).startswith("word's Sh") is True
    assert one("One. two? three! four", lambda c: T.paragraphs(T.sentences(c))) == "One. two? three!\n\nfour"
    assert one("", lambda c: T.paragraphs(T.sentences(c))) == ""
    assert run(spark, ["x", "xy", ""], T.capitalise) == ["x", "Xy", ""]
    assert one("ab", T.trigrams) == ["#ab", "ab#"] and one("", T.trigrams) == [] and sorted(one("aaaa", T.trigrams)) == ["#aa", "aa#", "aaa"]
    assert one("<agni>", lambda c: T.slp1_word(c)) == "agni" and one("st", T.slp1_word) is None and one("drptk", T.slp1_word) is None
    assert one("DanvantariH", T.slp1_to_iast) == "dhanvantariḥ" and one("kfzRa", lambda c: T.iast_to_plain(T.slp1_to_iast(c))) == "krishna"
    assert one("good t@xt w0rd " + "x" * 26, T.readable_tokens) == "good w0rd"
    assert run(spark, [None], T.ocr_clean) == [None]


def test_unicode(spark):
    df = spark.createDataFrame([("ﬁne ²",), (None,), ("ā",)], "s string")
    assert [r[0] for r in df.select(nfkc("s")).collect()] == ["fine 2", None, "ā"]
    assert [r[0] for r in df.select(without_accents("s")).collect()] == ["ﬁne ²", None, "a"]
    assert [r[0] for r in with_nfkc(df, "s").collect()] == ["fine 2", None, "ā"]
