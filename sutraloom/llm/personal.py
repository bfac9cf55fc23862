"""Personal information inside free text: find it by kind, and put typed placeholders in its place.

Method: generators of high recall propose overlapping spans of each kind; boosted trees, one model per kind, judge each
span by features of its format and context; thresholds calibrated on held-out cases select, and of overlapping
selected spans the most probable stays.

Training: there are no labelled texts, so the trees learn from made-up ones (training_texts), seeded, of a fixed size.
These repeat no sentences: their words are syllables in a row, their layout is that of forms, letters and lists, a cue
before a piece is drawn from the lists below, and what is not personal is made by kind (numbers that count or name
goods, places, works, headings). Two lists are features: the known names, and the corpus's ordinary words (words that
are often written in lower case, counted over all texts). Up to KNOWN_WORDS of these are broadcast; beyond, only those
with COMMON_SHARE of all words, and each text gets its others by a join.

Defined results: null text gives null and no finding; a piece that occurs twice in a text is one finding and is
replaced at both places. A name has at most NAME_PARTS parts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutraloom.llm.boosting import Boosted
from sutraloom.llm.words import count_words
from sutraloom.runtime import collect_bounded, cut_lineage, map_columns

KINDS = ("email", "phone", "id_number", "address", "name")
#: Ordinary words that may be broadcast; beyond, those with a share of all words (at most 1 / share of them) are.
KNOWN_WORDS, COMMON_SHARE = 200_000, 5e-6
#: A word is ordinary whatever its case from this share of all words on, and from this share of its own places in
#: lower case on; both surely so (SURE standard errors, one case in a hundred), which is the same test for a small corpus and a large one.
STARTER, LOWER, SURE = 2e-4, 0.3, 2.33
#: Parts that a name may have.
NAME_PARTS = 8

# --- generators ----------------------------------------------------------------------------------------------------------

_L = r"[^\W\d_]"
_DOMAIN = r"[A-Za-z0-9][A-Za-z0-9-]*"
_TOWN = rf"{_L}[\w’'-]*"
_PIN = r"(?:\d{3}[ ]?\d{3}|\d{5,6}|[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2})(?!\d)"
_HOUSE = r"\d{1,4}(?:[/-]\d{1,4})?[A-Za-z]?"
_STREET = rf"(?:{_L}[\w’'.-]*[ ]){{0,3}}{_L}[\w’'.-]*"

_DOTS = rf"(?:(?:\s?(?:\(dot\)|\[dot\]|\{{dot\}}|<dot>|(?<=\s)dot(?=\s))\s?|\.){_DOMAIN})+"

_EMAIL = (
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*[ ]?@[ ]?(?:{_DOMAIN}\.)+[A-Za-z]{{2,}}(?![\w-])"),
    re.compile(
        rf"(?i)(?<![\w.+-])[a-z0-9_][\w.+-]*\s?(?:\(at\)|\[at\]|\{{at\}}|<at>|(?<=\s)at(?=\s))\s?{_DOMAIN}{_DOTS}(?![\w-])"
    ),
)
_PHONE = re.compile(r"(?<![\w/.+(-])(?:\+[ ]?)?\(?\d(?:[ ./-]?[()]?[ ]?[()]?\d){6,15}(?![\w/-])")
_ID = (
    re.compile(r"(?<![\w/-])[A-Z]{1,3}\d{5,9}[A-Z]?(?![\w/-])"),
    re.compile(r"(?<![\w/-])[A-Z]{1,3}(?:[ ]\d{2}){3}[ ][A-Z](?![\w/-])"),
    re.compile(r"(?<![\w/-])[A-Z]{2,4}-\d{5,10}(?![\w/-])"),
    re.compile(r"(?<![\w/-])[A-Z]{1,3}/\d{1,4}/\d{3,8}(?![\w/-])"),
    re.compile(r"(?<![\w/-])[A-Z]{1,2}\d{1,2}[ ]\d{4,6}(?![\w/-])"),
    re.compile(r"(?<![\w/.+-])\d{3}([- ])\d{2}\1\d{4}(?![\w/-])"),
    re.compile(r"(?<![\w/.+-])\d{2}-\d{7}(?![\w/-])"),
    re.compile(r"(?<![\w/.+-])\d{4}([- ])\d{4}\1\d{4}(?![\w/-])"),
    re.compile(r"(?<![\w/.+-])\d{9,12}(?![\w/-])"),
)
_ADDRESS = (
    re.compile(rf"(?i)(?<!\w)(?:flat|apt\.?|apartment|unit|suite|room)[ ]\d+[a-z]?,[ ]{_HOUSE},?[ ]{_STREET},[ ]{_TOWN}(?:,[ ]|[ ]-[ ]|[ ]){_PIN}"),
    re.compile(rf"(?i)(?<!\w)(?:house|door|plot)[ ](?:no\.?|number)[ ]?{_HOUSE},[ ]{_STREET},[ ]{_TOWN}(?:,[ ]|[ ]-[ ]|[ ]){_PIN}"),
    re.compile(rf"(?i)(?<!\w)(?:p\.?[ ]?o\.?[ ]box|postbox|postfach|apartado)[ ]\d+,[ ]{_TOWN}(?:,[ ]|[ ]-[ ]|[ ]){_PIN}"),
    re.compile(rf"(?<![\w/]){_HOUSE},?[ ]{_STREET},[ ]{_TOWN}(?:,[ ]|[ ]-[ ]|[ ]){_PIN}"),
    re.compile(rf"(?<!\w)[A-ZÄÖÜ][\w-]*(?:[ ][A-ZÄÖÜ][\w-]*){{0,2}}[ ]\d{{1,4}}[a-z]?,[ ]\d{{5}}[ ][A-ZÄÖÜ][\w]*(?:-[A-ZÄÖÜ]\w*)*"),
)

# Words before a name that are not part of it.
TITLES = frozenset("mr mrs ms miss dr prof professor nurse vaidya shri sri smt sir herr frau señor señora sr sra don doña mme mlle monsieur madame m".split())
# Words that often come right before a person (roles, kin, openings and ends of letters, labels of forms),
# and those that come before the other kinds.
CUES = {
    "name": frozenset(
        "patient patients patientin paciente patiente client cliente klient klientin kunde kundin applicant antragsteller member mitglied miembro membre student schüler alumno élève tenant mieter inquilino locataire employee mitarbeiter empleado employé "
        "guest gast huésped invité brother sister mother father son daughter wife husband uncle aunt cousin friend neighbour "
        "dear lieber liebe estimado estimada cher chère attn regards sincerely faithfully truly grüßen saludos atentamente salutations signed signé firmado gezeichnet unterzeichnet "
        "name nombre nom named called contact contacto kontakt ansprechpartner ansprechpartnerin thank thanks danke gracias merci by for and".split()
    ),
    "phone": frozenset("tel telephone phone mobile cell fax telefon handy mobil téléphone portable teléfono móvil sms call ring text dial dialled rufen anrufen appelez appeler llame llamar number nummer número numéro at under".split()),
    "id_number": frozenset("id identity identification ssn social security seguridad sécurité tax tin steuer fiscal passport pass reisepass passeport pasaporte nino ni national insurance aadhaar pan licence license card karte tarjeta carte registration reg member patient hospital record number no nr nummer número numéro".split()),
}
# Words around numbers that are nobody's: of publications, of goods, of measures, of times, of buildings.
NEVER = frozenset(
    "isbn issn doi edition volume vol issue page pages pp leaf folio verse verses chapter section paragraph figure fig plate table line "
    "batch lot serial order invoice article item model part version sku ratio dose doses scale degrees percent grams kilograms litres metres miles copies pieces "
    "year years century born died room floor building gate platform flight".split()
)
# Nouns that end the names of places and houses, of bodies, of works, and of plants and what is made of them.
PLACES = frozenset(
    "street road lane avenue square court row alley steps hill mount mountain valley gate bridge cross river lake sea bay island forest garden park view village town city district county province state temple church school college university hospital clinic ward library museum hotel station market "
    "society institute company press journal review association office house "
    "book tale story history guide handbook manual dictionary samhita samgraha sutra tantra nighantu shastra veda purana kosha gita "
    "tree flower leaf root seed bark fruit oil powder tea".split()
)
PLACES |= frozenset(w + "s" for w in PLACES)

# Words after which a capitalised pair is rather a subject than a person.
SUBJECTS = frozenset("of on upon in into from about über von sobre sur".split())

_TOKEN = re.compile(rf"{_L}+(?:[-’']{_L}+)*")
_PREV = re.compile(r"[^\W_]+")

#: (start, end, kind, number of the generator)
Span = tuple[int, int, str, int]


class Lists:
    """Known names and ordinary words, all in lower case. The later words of a given name of several words count
    only after its first."""

    def __init__(self, given: set[str], family: set[str], common: set[str]) -> None:
        parts = [g.lower().split() for g in given]
        self.given = frozenset(p[0] for p in parts if p)
        self.pairs = frozenset(pair for p in parts for pair in zip(p, p[1:]))
        self.family = frozenset(f.lower() for f in family)
        tails = {b for _, b in self.pairs}
        self.common = frozenset(w for w in common if len(w) > 1) - self.given - self.family - tails
        self.names = self.given | self.family
        letters = frozenset(w for w in common if len(w) == 1) | frozenset("abcdefghijklmnopqrstuvwxyz")
        self.usual = frozenset(w for w in self.common if _TOKEN.fullmatch(w)) | letters - self.names

    def may_name(self, words: set[str]) -> bool:
        """Whether a text of these words (what stands between blanks, without signs, in lower case) can hold a name. A
        name has a title, a known word, or a word that is not usual and is capitalised or (in scripts without capitals
        too) stands after a cue."""
        if not words.isdisjoint(TITLES):
            return True
        plain = []
        for w in words - self.usual:
            if w.upper() != w:
                return True
            if not w.isascii():
                plain.append(w)
        if not plain:
            return False
        cued = not words.isdisjoint(CUES["name"])
        return any([cued or t in self.names or t[0].isupper() for w in plain for t in _TOKEN.findall(w)])

    def known(self, w: str) -> bool:
        return w in self.given or w in self.family


def _number_spans(text: str) -> Iterator[Span]:
    for n, pattern in enumerate(_ADDRESS):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), "address", n
    for n, pattern in enumerate(_ID):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), "id_number", n
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group(0))
        if 7 <= digits <= 15 and m.group(0).count("(") == m.group(0).count(")"):
            yield m.start(), m.end(), "phone", 0


def _name_spans(text: str, lists: Lists) -> Iterator[Span]:
    """Runs of up to NAME_PARTS tokens that may be a person: capitalised, known, or after a title or cue. Runs of nothing
    but ordinary words are none."""
    tokens = list(_TOKEN.finditer(text))
    words = [t.group(0) for t in tokens]
    low = [w.lower() for w in words]
    shown = [w[0].isupper() for w in words]
    known_names, common, cues = lists.names, lists.common, CUES["name"]
    starts = [i for i, w in enumerate(low) if shown[i] or w in known_names or (i and (low[i - 1] in cues or low[i - 1] in TITLES))]
    for i in starts:
        if low[i] in TITLES and len(low[i]) > 1:
            continue
        if low[i] in common and len(low[i]) > 1 and (i + 1 >= len(low) or low[i + 1] in common) and low[i - 1] not in TITLES:
            continue
        t = tokens[i]
        titled = i > 0 and low[i - 1] in TITLES and len(text[tokens[i - 1].end() : t.start()]) <= 2
        cued = i > 0 and low[i - 1] in CUES["name"] and len(text[tokens[i - 1].end() : t.start()]) <= 3
        if not shown[i] and not lists.known(low[i]) and not ((cued or titled) and i + 1 < len(tokens) and low[i] not in lists.common and low[i + 1] not in lists.common):
            continue
        commas, known = 0, 0
        for j in range(i, min(i + NAME_PARTS, len(tokens))):
            if j > i:
                gap = text[tokens[j - 1].end() : tokens[j].start()]
                if len(low[j - 1]) == 1:  # a letter on its own is an initial, with its point
                    if gap != ". " or not shown[j - 1]:
                        break
                elif gap == ", " and not commas:
                    commas += 1
                elif gap != " ":
                    break
                if not (shown[j] or lists.known(low[j]) or (low[j - 1], low[j]) in lists.pairs or (not shown[i] and low[j] not in lists.common)):
                    break
            known += lists.known(low[j])
            width = j - i + 1
            if len(low[j]) == 1:
                continue
            if width == 1 and not (titled or lists.known(low[i])):
                continue
            if width > 1 and not known and all(w in common or len(w) == 1 for w in low[i : j + 1]):
                continue
            if width > 1 and not (known or titled or cued) and not (low[i] not in lists.common and low[j] not in lists.common):
                continue
            yield t.start(), tokens[j].end(), "name", width


#: What every text with a number span holds: five digits with at most four other characters between two, a number with
#: strokes, or a postal code of letters and digits.
_DIGITS = re.compile(r"(?:\d\D{0,4}){4}\d|/\d{1,4}/\d{3}|(?i:[A-Z]\d[A-Z\d]?[ ]\d[A-Z]{2})")
_ANY_DIGIT = re.compile(r"\d")
#: What every address with a spelt sign holds, from the sign on.
_SPELT = re.compile(rf"[aA][tT](?<=[\s(\[{{<]..)[\s)\]}}>]\s?(?i:{_DOMAIN}{_DOTS})")
_SIGNS = ".,;:!?()[]{}<>\"'“”‘’„«»*/|-–—"


def candidates(text: str, lists: Lists) -> list[Span]:
    """All spans of a text. The generators of a kind run only where the text holds what each of their spans must hold."""
    found: list[Span] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", 0) for m in _EMAIL[0].finditer(text)]
    if _SPELT.search(text):
        found += [(m.start(), m.end(), "email", 1) for m in _EMAIL[1].finditer(text)]
    if _ANY_DIGIT.search(text) and _DIGITS.search(text):
        found += _number_spans(text)
    if lists.may_name({w.strip(_SIGNS) for w in set(text.lower().split())}):
        found += _name_spans(text, lists)
    return sorted(set(found))


# --- features --------------------------------------------------------------------------------------------------------------

def features(text: str, span: Span, lists: Lists, others: list[Span]) -> list[float]:
    """Format and context of a span; the same numbers for every kind."""
    start, end, kind, source = span
    piece = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 24]
    prev = [w.lower() for w in _PREV.findall(before.rsplit("\n", 1)[-1])][-4:]
    nxt = [w.lower() for w in _PREV.findall(after)][:2]
    tokens = [t.lower() for t in _TOKEN.findall(piece)]
    groups = [len(g) for g in re.findall(r"\d+", piece)] or [0]
    digits = sum(groups)
    cue = CUES.get(kind, frozenset())
    next_token = _TOKEN.match(after.lstrip(" ,")) if after[:1] in (" ", ",") else None
    prev_token = re.search(rf"({_L}+(?:-{_L}+)*)([ ,.]+)$", before)
    nt, pt = (next_token.group(0) if next_token else ""), (prev_token.group(1) if prev_token else "")
    wider = [k for s, e, k, _ in others if s <= start and end <= e and (e - s) > (end - start)]
    inside = len(wider) - wider.count(kind)
    return [
        source,
        end - start,
        digits,
        len(tokens),
        len(groups),
        min(groups),
        max(groups),
        groups[0],
        piece.count("-"),
        piece.count(" "),
        piece.count("."),
        piece[0] in "+(",
        piece.startswith("0"),
        piece.startswith("000"),
        any(p in cue for p in prev[-1:]),
        sum(p in cue for p in prev[-3:]),
        any(p in NEVER for p in prev[-2:]),
        any(n in NEVER or n in PLACES for n in nxt[:1]),
        any(t in PLACES for t in tokens),
        sum(len(t) > 1 and t not in lists.common and not lists.known(t) for t in tokens),
        any(t in NEVER for t in tokens),
        any(t in cue for t in tokens),
        bool(prev) and prev[-1] in TITLES,
        bool(prev) and prev[-1] in SUBJECTS,
        sum(t in lists.given or pair in lists.pairs for t, pair in zip(tokens, [("", ""), *zip(tokens, tokens[1:])])),
        sum(t in lists.family for t in tokens),
        sum(t in lists.common for t in tokens),
        bool(tokens) and tokens[0] in lists.common,
        bool(tokens) and tokens[-1] in lists.common,
        bool(tokens) and lists.known(tokens[0]),
        bool(tokens) and lists.known(tokens[-1]),
        ", " in piece,
        any(len(t) == 1 for t in tokens),
        piece.isupper(),
        piece.islower(),
        bool(nt) and (lists.known(nt.lower()) or (nt[0].isupper() and nt.lower() not in lists.common and nt.lower() not in TITLES)),
        bool(pt) and (lists.known(pt.lower()) or (len(pt) == 1 and pt.isupper() or pt[0].isupper() and pt.lower() not in lists.common and pt.lower() not in TITLES and pt.lower() not in cue)),
        after[:1] in (",", ".", ";", "\n", "") and not after[:2].strip(".,;\n "),
        not before.strip() or before.rstrip(" ")[-1:] in ".!?\n:-",
        inside,
        kind == "address" and wider.count(kind),
    ]


# --- training ----------------------------------------------------------------------------------------------------------------


class Maker:
    """Made-up words, people and personal data of a seeded generator. Words are syllables in a row."""

    ONSETS = "b c d f g h j k l m n p r s t v w z br ch dr gl kr pl sh st th tr".split()
    NUCLEI = "a e i o u aa ai ee ou ä ö ü é ā ī".split()
    CODAS = ["", "", "", "l", "m", "n", "r", "s", "t", "nd", "rk", "sh"]
    STREETS = "Street Road Lane Avenue Row Hill Court View Square Close Terrace Rd St Alley Steps Cross Marg Nagar".split()
    GERMAN = "straße weg gasse platz allee ring hof rain zeile".split()
    MAIL = "org com net info example test".split()

    def __init__(self, seed: int) -> None:
        r = self.r = random.Random(seed)
        self.given = [self.name() + (f" {self.name()[: r.choice((2, 3))]}" if r.random() < 0.1 else "") for _ in range(40)]
        self.family = [self.name() + r.choice(("", "", "", "-" + self.name())) for _ in range(40)]
        self.rare = [self.name() for _ in range(500)]
        self.ordinary = [self.word() for _ in range(400)]
        # nouns that are always capitalised, as in German, and so in no list
        self.nouns = [self.name() for _ in range(150)]
        # ordinary words that are names, too, stand in lower case in running text
        self.plain = self.ordinary + [g.lower() for g in self.given[:6] if " " not in g]

    def word(self) -> str:
        pick = self.r.choice
        return "".join(pick(self.ONSETS) + pick(self.NUCLEI) + pick(self.CODAS) for _ in range(pick((1, 2, 2, 3))))

    def name(self) -> str:
        return (self.word() + self.word()).capitalize()

    def words(self, least: int, most: int) -> str:
        noun = 0.25 if self.r.random() < 0.2 else 0.0
        return " ".join(self.r.choice(self.nouns if self.r.random() < noun else self.plain) for _ in range(self.r.randint(least, most)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def capitals(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))

    def cased(self, text: str, upper: float, lower: float) -> str:
        x = self.r.random()
        return text.upper() if x < upper and "ß" not in text else text.lower() if x > 1 - lower else text

    def surname(self) -> str:
        r = self.r
        return r.choice(self.family if r.random() < 0.6 else self.rare) + (f"-{self.name()}" if r.random() < 0.04 else "")

    def person(self) -> str:
        r = self.r
        first, last, form = r.choice(self.given if r.random() < 0.6 else self.rare), self.surname(), r.random()
        if form < 0.15:
            return self.cased(f"{last}, {first}", 0.1, 0)
        if form < 0.3:
            return self.cased("".join(f"{r.choice(self.rare)[0]}. " for _ in range(r.choice((1, 1, 2)))) + last, 0.05, 0)
        middle = "".join(f" {r.choice(self.given + self.rare)}" for _ in range(r.choice((0, 0, 0, 0, 1, 2))))
        return self.cased(f"{first}{middle} {last}", 0.1, 0.1)

    def email(self) -> str:
        r = self.r
        part = lambda: r.choice((r.choice(self.given), self.surname(), r.choice(self.ordinary), r.choice(self.rare)[0])).replace(" ", "")
        ascii_only = lambda t: re.sub(r"[^a-z0-9._+-]", "x", t.lower())
        user = ascii_only(r.choice(("", "", ".", "_", "-", "+")).join((part(), part())) + r.choice(("", "", self.digits(2))))
        host = ascii_only(r.choice(("", "", f"{part()}.", f"{part()}-")) + self.word() + r.choice(("", "", self.digits(1)))) + "." + r.choice(self.MAIL)
        signs = r.choice((("@", "."),) * 6 + ((" @ ", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", ".")))
        return self.cased(user + signs[0] + host.replace(".", signs[1]), 0.06, 0)

    def phone(self) -> str:
        """Groups of two to six digits, seven to thirteen in all, after a country's or a trunk number or none."""
        r = self.r
        gap = r.choice((" ", " ", "-", ".", ""))
        while True:
            groups = [self.digits(r.randint(2, 6)) for _ in range(r.randint(2, 5))]
            if 7 <= sum(map(len, groups)) <= 11:
                break
        lead = r.choice(("", "", "0", f"+{r.randint(1, 99)}", f"+{r.randint(1, 99)}", "(", "+(0)"))
        if lead == "(":
            return f"({groups[0]}){r.choice((' ', ''))}" + gap.join(groups[1:])
        if lead == "+(0)":
            return f"+{r.randint(1, 99)} (0){groups[0]} " + gap.join(groups[1:])
        return lead + (gap if lead.startswith("+") else "") + gap.join(groups)

    def number(self) -> tuple[str, str]:
        """A label and a number as states and houses give them out."""
        r, d, u = self.r, self.digits, self.capitals
        sep = r.choice(("-", " "))
        label, made = r.choice((
            (("aadhaar", "Aadhaar", "national id", "identity"), (d(12), f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}")),
            (("SSN", "social security", "ssn", "Social Security"), (f"{d(3)}{sep}{d(2)}{sep}{d(4)}", d(9))),
            (("tax id", "tax", "TIN", "Tax identification"), (f"{d(2)}-{d(7)}", d(11), u(2) + d(9))),
            (("passport", "Passport", "Pasaporte", "Reisepass", "passeport"), (u(1) + d(8), u(2) + d(7), u(1) + d(7), f"{u(1)}{d(2)} {d(5)}")),
            (("national insurance", "NI", "NINO", "insurance"), (u(2) + d(6) + u(1), f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}")),
            (("patient", "hospital", "record", "patient record"), (f"{u(r.randint(1, 3))}/{d(r.randint(2, 4))}/{d(r.randint(3, 6))}", f"{u(r.randint(2, 4))}-{d(r.randint(5, 8))}")),
        ))
        return r.choice(label) + r.choice(("", "", " no.", " number", " nr", ":", " no:")), r.choice(made)

    def address(self) -> str:
        r = self.r
        town = r.choice(self.rare) + r.choice(("", "", "", "-" + self.name(), "pur", "ville"))
        pin = r.choice((self.digits(6), self.digits(5), f"{self.digits(3)} {self.digits(3)}", f"{self.capitals(2)}{self.digits(1)} {self.digits(1)}{self.capitals(2)}"))
        end = town + r.choice((" ", " ", ", ", " - ")) + pin
        if r.random() < 0.2:
            first = r.choice((f"{self.name()}{r.choice(self.GERMAN)}", f"{r.choice(('Am', 'Alte', 'An der', 'Neue', 'Im'))} {self.name()}{r.choice(self.GERMAN)}"))
            return f"{first} {r.randint(1, 250)}{r.choice(('', '', 'a', 'b'))}, {self.digits(5)} {r.choice(self.rare)}{r.choice(('', '', '-' + self.name()))}"
        if r.random() < 0.12:
            return self.cased(f"{r.choice(('P.O. Box', 'PO Box', 'Postfach', 'Apartado'))} {r.randint(1, 900)}, {end}", 0.08, 0)
        house = r.choice((str(r.randint(1, 300)),) * 2 + (f"{r.randint(1, 300)}{r.choice('ABCab')}", f"{r.randint(1, 200)}/{r.randint(1, 20)}"))
        street = " ".join(r.choice(self.rare + [w.capitalize() for w in self.ordinary]) + r.choice(("", "", "", "s'")) for _ in range(r.choice((1, 1, 2)))) + " " + r.choice(self.STREETS)
        lead = r.choice(("", "", "", f"Flat {r.randint(1, 40)}, ", f"Apt {r.randint(1, 40)}, ", f"Unit {r.randint(1, 40)}, "))
        if not lead and r.random() < 0.25:
            return self.cased(f"{r.choice(('House No.', 'House number', 'Door No.', 'Plot No.'))} {house}, {street}, {end}", 0.08, 0)
        return self.cased(f"{lead}{house}{r.choice((' ', ' ', ', '))}{street}, {end}", 0.08, 0)


#: A part of a text: plain, or (kind, piece).
Part = str | tuple[str, str]


def _placed(m: Maker, kind: str, piece: str, label: str = "") -> list[Part]:
    """A piece in a form, in a sentence with or without a cue, at its start or end, in brackets or on a line."""
    r, value = m.r, (kind, piece)
    cue = label or r.choice(sorted(CUES.get(kind, ("mail", "e-mail", "write", "to")) if kind != "address" else ("address", "lives", "at", "to", "wohnt", "vive", "habite")))
    labels = [
        [f"{cue.capitalize() if r.random() < 0.7 else cue}{r.choice((': ', ' ', ' - ', ': '))}", value, r.choice((".", "", ";", ","))],
        [f"{m.words(1, 4).capitalize()} {cue} ", value, f" {m.words(1, 5)}."],
        [f"{m.words(2, 5).capitalize()} {cue} ", value, "."],
        [f"{cue.capitalize()} ", value, f", {m.words(1, 3)}."],
        [f"{m.words(1, 4)} {cue} ".capitalize(), value, f" {m.words(1, 2)}, {m.words(1, 1)} ", (kind, getattr(m, "person" if kind == "name" else kind)() if kind != "id_number" else m.number()[1]), "."],
    ]
    if label:
        return r.choice(labels)
    return r.choice([*labels, [f"{m.words(1, 5).capitalize()} ", value, f" {m.words(1, 5)}."], [f"{m.words(2, 5).capitalize()} (", value, ")."], [f"{m.words(1, 3).capitalize()}: ", value], [value, f" {m.words(2, 6)}."], [value], [f"{m.words(1, 4).capitalize()}, ", value, f", {m.words(1, 4)}."]])


def _personal_part(m: Maker) -> list[Part]:
    r = m.r
    kind = r.choice(("name",) * 6 + ("email", "email", "phone", "phone", "id_number", "id_number", "address", "address"))
    if kind == "id_number":
        label, piece = m.number()
        return _placed(m, kind, piece, label)
    if kind == "email":
        return [f"{m.words(1, 2).capitalize()}: mailto:", (kind, m.email())] if r.random() < 0.08 else _placed(m, kind, m.email())
    if kind != "name":
        return _placed(m, kind, getattr(m, kind)())
    form, person = r.random(), ("name", m.person())
    if form < 0.4:
        return _placed(m, kind, person[1])
    if form < 0.6:  # after a title, whole or the family name alone
        title = r.choice(sorted(t for t in TITLES if len(t) > 1)).capitalize() + r.choice(("", "", "."))
        return [r.choice((f"{m.words(1, 4).capitalize()} ", "", "Dear ")) + f"{title} ", r.choice((person, ("name", m.surname()))), r.choice((f" {m.words(1, 5)}.", ",", f", {m.words(2, 4)}."))]
    if form < 0.66:  # two
        return [r.choice((f"{m.words(1, 3).capitalize()} ", "")), person, r.choice((" and ", " und ", " et ", " y ", " & ")), ("name", m.person()), f" {m.words(1, 5)}."]
    if form < 0.88:  # with an address, a telephone or a number beside
        label, piece = m.number()
        other = r.choice(([("address", m.address())], [("address", m.address())], [("phone", m.phone())], [("email", m.email())], [f"{label} ", ("id_number", piece)]))
        return [r.choice((f"{m.words(1, 3).capitalize()} ", "", f"{m.words(1, 2).capitalize()}: ")), person, r.choice((", ", "\n", " - ", f" {m.words(1, 3)} ")), *other, r.choice((".", "", f" {m.words(1, 3)}."))]
    # the end of a letter, with running text right behind
    return [r.choice(("Signed", "Signed:", "Regards", "Sincerely", "Firmado:", "Gezeichnet:")) + r.choice((" ", "\n", ", ")), person, r.choice((f" {m.words(3, 6).capitalize()}.", f"\n{m.words(2, 4).capitalize()}.", f" {r.choice(m.rare)} {m.words(2, 4)}.", "."))]


def _other_part(m: Maker) -> list[Part]:
    """What is not personal, by kind: numbers, signs of addresses, and capitalised words."""
    r, d = m.r, m.digits
    kind, never = r.random(), r.choice(sorted(NEVER))
    if kind < 0.4:
        shape = r.choice((
            f"{d(r.randint(2, 7))}{r.choice('-./: ')}{d(r.randint(1, 5))}", f"{d(3)}-{d(1)}-{d(r.randint(3, 5))}-{d(r.randint(3, 5))}-{d(1)}", f"{r.randint(1, 99)} 000 {r.choice(('000', d(2)))}", f"{d(2)}.{d(2)}.{d(r.randint(2, 4))}",
            f"{d(r.randint(1, 2))}.{d(r.randint(4, 6))}.{d(1)}", f"{d(4)}-{d(4)}", f"{d(2)}-{d(2)}-{d(2)}", d(r.randint(5, 12)), f"{d(2)}:{d(2)}-{d(2)}:{d(2)}", f"{m.capitals(r.randint(1, 3))}{r.choice(('', '-', '/'))}{d(r.randint(4, 8))}", f"{d(r.randint(2, 5))}:{d(r.randint(1, 3))}", f"{d(1)},{d(3)},{d(3)}",
        ))
        lead = r.choice((f"{m.words(1, 4).capitalize()} {never}", never.capitalize(), f"{never.capitalize()} no.", f"{m.words(0, 2)} {never} no.".strip().capitalize(), *[f"{m.words(2, 4).capitalize()}"] * 3))
        tail = r.choice((f", {r.choice(sorted(NEVER))} {d(2)}", f" {r.choice(sorted(NEVER))}", f" {m.words(1, 4)}", ""))
        return [f"{lead} {shape}{tail}."]
    if kind < 0.5:
        return [r.choice((
            f"{m.words(1, 3).capitalize()} @{m.word()} {m.words(1, 3)}.", f"{d(2)} {m.word()} @ {d(2)} {m.word()}.", f"{m.words(1, 3).capitalize()} at {m.word()}.{r.choice(m.MAIL)} {m.words(1, 3)}.", f"{m.words(1, 2).capitalize()} at {m.word()} dot {m.words(2, 3)}.".replace("at", "at the", 1),
            *[f"{r.randint(1, 999)} {m.words(1, 2)}, {m.words(1, 1)} {r.choice((d(2), d(5), d(6)))} {m.words(0, 2)}."] * 2, f"{never.capitalize()} {r.randint(1, 99)}, {m.word()} {m.word()}, {r.choice(m.rare)} {r.choice(sorted(PLACES)).capitalize()}.",
        ))]
    noun = r.choice(sorted(PLACES)).capitalize()
    cap = lambda: r.choice((r.choice(m.ordinary).capitalize(), r.choice(m.rare), r.choice(m.nouns)))
    work = r.choice(("Notes", "Letters", "Tales", "Studies", "Essays", "Songs", "Lectures", "Principles", "The Art", "A History", "The Book", "Lessons", noun))
    return [r.choice((
        f"{r.choice(m.rare)} {noun} {m.words(2, 4)}.", f"{m.words(1, 4).capitalize()} {r.choice(m.rare)} {noun}.", f"{m.words(1, 4).capitalize()} {cap()} {noun} {m.words(1, 3)}.", f"{work} {r.choice(sorted(SUBJECTS))} {cap()} {cap()}", f"{work} {r.choice(sorted(SUBJECTS))} {cap()}\n{m.words(2, 5).capitalize()}.",
        f"{m.words(1, 3).capitalize()} {r.choice(sorted(SUBJECTS))} {r.choice(m.rare)} {m.words(1, 4)}.", f"{r.choice(m.given)} {noun.lower()} {m.words(2, 4)}.", f"{r.choice(m.given)} and {r.choice(m.given)} {noun.lower()} {m.words(2, 4)}.", f"{m.words(1, 4).capitalize()} {r.choice(m.given).lower()} {m.words(2, 4)}.",
        f"{cap()} {r.choice(m.ordinary).capitalize()} {r.choice(m.ordinary).capitalize()}\n{m.words(2, 5).capitalize()}.", f"{m.words(2, 4).upper()}\n{m.words(2, 5).capitalize()}.", f"{r.choice(m.ordinary).capitalize()} {r.choice(m.ordinary).capitalize()} {m.words(2, 4)}.", f"{r.choice(m.rare)} {m.words(2, 5)}.", f"{m.words(1, 4).capitalize()} {r.choice(m.rare)} {m.words(1, 4)}.",
        *[f"{cap()} {r.choice(m.nouns)} {m.words(2, 5)}.", f"{m.words(1, 4).capitalize()} {cap()} {r.choice(m.nouns)} {m.words(1, 3)}.", f"{r.choice(m.nouns)} {r.choice((' und ', ' and '))} {cap()} {m.words(1, 4)}.", f"{cap()} {r.choice(m.nouns)}\n{m.words(2, 5).capitalize()}."] * 2,
    ))]


def training_texts(count: int = 3000, seed: int = 11) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], Lists]:
    """Made-up texts with the true spans of their personal data, and the lists that belong to them."""
    m = Maker(seed)
    r, texts = m.r, []
    for _ in range(count):
        text, true = m.words(3, 9).capitalize() + r.choice((". ", ".\n", ".\n\n")), []
        for _ in range(r.randint(1, 3)):
            for part in _personal_part(m) if r.random() < 0.6 else _other_part(m):
                if isinstance(part, tuple):
                    true.append((len(text), len(text) + len(part[1]), part[0]))
                    text += part[1]
                else:
                    text += part
            text += r.choice((" ", "\n", "\n\n")) + m.words(3, 8).capitalize() + r.choice((". ", ".\n", ", "))
        texts.append((text, true))
    # of the words in the lists above, a corpus has some often enough to know them as ordinary, and others not
    listed = sorted({*"mailto the at dot and und et y no an der am im".split()}.union(*CUES.values(), NEVER, PLACES, SUBJECTS, TITLES))
    return texts, Lists(set(m.given), set(m.family), {*m.ordinary, *r.sample(listed, len(listed) // 2)})


@lru_cache(maxsize=1)
def models() -> dict[str, Boosted]:
    """The trees of each kind, trained on two thirds of the invented texts and calibrated on the rest."""
    texts, lists = training_texts()
    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}
    for n, (text, true) in enumerate(texts):
        exact = set(true)
        spans = candidates(text, lists)
        for span in spans:
            x, y, part = rows[span[2]]
            x.append(features(text, span, lists, spans))
            y.append((span[0], span[1], span[2]) in exact)
            part.append(n % 3 == 0)
    made = {}
    for kind, (x, y, part) in rows.items():
        xs, ys, held = np.array(x, dtype=float), np.array(y, dtype=float), np.array(part)
        made[kind] = Boosted(rounds=100).fit(xs[~held], ys[~held]).calibrate(xs[held], ys[held])
    return made


# --- on texts and tables -----------------------------------------------------------------------------------------------------


def find_all(texts: list[str | None], lists: Lists, trees: dict[str, Boosted]) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, probability) of the personal data in each text, in order."""
    spans: list[list[Span]] = [candidates(t, lists) if t else [] for t in texts]
    pools: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
    for n, (t, s) in enumerate(zip(texts, spans)):
        for k, span in enumerate(s):
            pools[span[2]][0].append((n, k))
            pools[span[2]][1].append(features(t, span, lists, s))
    chosen: list[list[tuple[float, int, int, str, float]]] = [[] for _ in texts]
    for kind, (where, x) in pools.items():
        if x:
            p = trees[kind].probability(np.array(x, dtype=float))
            for (n, k), v in zip(where, p):
                if v >= trees[kind].threshold:
                    start, end, _, _ = spans[n][k]
                    chosen[n].append((-(v - trees[kind].threshold) / (1 - trees[kind].threshold), start, end, kind, float(v)))
    result = []
    for picks in chosen:
        kept: list[tuple[int, int, str, float]] = []
        for _, start, end, kind, v in sorted(picks, key=lambda c: (round(c[0], 2), c[1] - c[2], c[1])):
            if all(end <= s or start >= e for s, e, _, _ in kept):
                kept.append((start, end, kind, v))
        result.append(sorted(kept))
    return result


def redact(text: str | None, found: list[tuple[int, int, str, float]]) -> str | None:
    """The text with [KIND] in the place of each finding."""
    if not text or not found:
        return text
    parts, at = [], 0
    for start, end, kind, _ in found:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def free_words(text: str) -> list[str]:
    """Words that stand free in running text, compounds too, not inside addresses of any kind."""
    return [w for x in text.split() if (w := x.rstrip(".,;:!?)")).isalpha() or w.replace("-", "").replace("’", "").replace("'", "").isalpha() and w[0].isalpha()]


def ordinary_words(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(w, n) of the words of all texts that are surely written in lower case in LOWER of their places, or that are too
    frequent for any one name (words that often begin sentences); and the number of all words. Surely: by the lower
    bound of Wilson's interval for a share, and by twice so many standard errors for a count."""
    counts = count_words(df, text, free_words)
    low = F.lower("word")
    forms = cut_lineage(counts.groupBy(low.alias("w")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("word") == low, F.col("n")).otherwise(0)).alias("lower")))
    total = forms.agg(F.sum("n")).first()[0] or 0
    n, share, z2 = F.col("n"), F.col("lower") / F.col("n"), SURE**2
    bound = (share + z2 / (2 * n) - SURE * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    ordinary = (bound >= LOWER) | (n - 2 * SURE * F.sqrt(n) >= total * STARTER)
    return forms.where(ordinary).select("w", "n"), total


def _looked_up(text: str) -> set[str]:
    """The words of a text that are looked up among the ordinary ones."""
    words = {t.lower() for t in set(_TOKEN.findall(text))}
    return words.union(*[re.split("[’']", w) for w in words if "’" in w or "'" in w])


def _own_words(df: DataFrame, text: str, words: DataFrame, known: frozenset[str]) -> DataFrame:
    """(h, own): the words of the table `words` that each text holds, beside the known ones; texts by a hash."""
    held = df.sparkSession.sparkContext.broadcast(known)

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        pairs = [(h, w) for h, t in zip(cols["h"], cols["t"]) for w in _looked_up(t) - held.value]
        return {"h": [h for h, _ in pairs], "w": [w for _, w in pairs]}

    texts = df.where(F.col(text).isNotNull()).select(F.md5(text).alias("h"), F.col(text).alias("t"))
    return map_columns(texts, kernel, "h string, w string").join(words, "w").groupBy("h").agg(F.collect_set("w").alias("own"))


def name_lists(names: DataFrame, name: str, part: str, limit: int = 200_000) -> tuple[set[str], set[str]]:
    rows = collect_bounded(names.select(name, part).where(F.col(name).isNotNull()), limit, "known names")
    return {r[0] for r in rows if r[1] == "given"}, {r[0] for r in rows if r[1] != "given"}


def _prepared(df: DataFrame, key: str, text: str, names: DataFrame, name: str, part: str):
    """(given names, family names, ordinary words, trees) for all tasks, and df as (key, text, own): the ordinary
    words of each text that are not among them, null where all are."""
    given, family = name_lists(names, name, part)
    words, total = ordinary_words(df, text)
    words, few = cut_lineage(words), words.count() <= KNOWN_WORDS
    frequent = F.col("n") >= total * COMMON_SHARE
    rows = words.collect() if few else collect_bounded(words.where(frequent), int(1 / COMMON_SHARE) + 1, "frequent words")
    known = frozenset(r["w"] for r in rows)
    held = df.sparkSession.sparkContext.broadcast((given, family, known, models()))
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if few:
        return held, source.withColumn("own", F.lit(None).cast("array<string>"))
    own = _own_words(df, text, words.where(~frequent).select("w"), known)
    return held, source.join(own, F.md5("text") == own["h"], "left").select("key", "text", "own")


def _batch(held: tuple, cols: dict[str, list], last: list) -> list[list[tuple[int, int, str, float]]]:
    """find_all of a batch. An ordinary word is one in all texts, so the batch's own words count together. last: the
    lists of the known words alone, made once for a task."""
    given, family, known, trees = held
    own = [w for x in cols["own"] if x for w in x]
    if not last:
        last.append(Lists(given, family, known))
    return find_all(cols["text"], Lists(given, family, known.union(own)) if own else last[0], trees)


def find_personal(df: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", part: str = "name_part") -> DataFrame:
    """(key, kind, found_text, confidence): each distinct piece of personal data of each record."""
    held, source = _prepared(df, key, text, names, name, part)
    key_type, last = df.schema[key].dataType.simpleString(), []

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in (key, "kind", "found_text", "confidence")}
        for k, t, found in zip(cols["key"], cols["text"], _batch(held.value, cols, last)):
            best: dict[tuple[str, str], float] = {}
            for start, end, kind, p in found:
                piece = (kind, t[start:end])
                best[piece] = max(p, best.get(piece, 0.0))
            for (kind, piece), p in best.items():
                for name, v in zip(out, (k, kind, piece, p)):
                    out[name].append(v)
        return out

    return map_columns(source, kernel, f"`{key}` {key_type}, kind string, found_text string, confidence double")


def redact_personal(df: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", part: str = "name_part") -> DataFrame:
    """(key, text with placeholders, n_found); every record has its row."""
    held, source = _prepared(df, key, text, names, name, part)
    key_type, last = df.schema[key].dataType.simpleString(), []

    def kernel(cols: dict[str, list]) -> dict[str, list]:
        found = _batch(held.value, cols, last)
        return {key: cols["key"], text: [redact(t, f) for t, f in zip(cols["text"], found)], "n_found": [len(f) for f in found]}

    return map_columns(source, kernel, f"`{key}` {key_type}, `{text}` string, n_found int")
