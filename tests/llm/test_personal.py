"""Personal data in texts of other kinds than those that the trees learn from, and training texts that owe nothing to
the tables."""

import os
import random
import re

import pyarrow.parquet as pq
import pytest

from sutraloom.llm import personal

GIVEN = "Agnes Bruno Clara Dario Elsa Felix Greta Hugo Irina Jonas Katya Leon Maren Nils Oona Pavel Renata Silvan Tilda Ulric".split()
FAMILY = "Abernow Birkfeld Castrel Dunmore Eschbach Fenwald Gorley Halvers Ilmenau Jarrow Kestrin Lomond Marwick Norring Ostrava Pellman Quarrie Rosmund Stavrin Tolmeck".split()
TOWNS = "Ashwick Brenford Calderby Dorning Eastmere Farholt".split()
STREETS = "Chapel Street,Station Road,Orchard Lane,Brook Avenue,Quarry Hill,Old Mill Road".split(",")

PEOPLE = (
    "The caretaker {name} will unlock the bicycle cellar at seven.", "Minutes were taken by {name} and read aloud.", "Lost umbrella, black handle: please tell {name}, {address}.", "Your parcel was left with our neighbour {name} downstairs.", "Dear Mr {family},\nyour bicycle has been repaired.",
    "We met Mrs {family} beside the ferry and shared a sandwich.", "Winner of the raffle: {name}", "Invoice to {name}, {address}", "Tenant: {name}\nPhone: {phone}\nEmail: {email}", "For bookings call {phone} before noon.", "Spare keys? Mobile {phone}.", "Fax: {phone}; the office closes early.",
    "The deposit goes back to {address} by cheque.", "New address: {address}", "He forgot his passport {passport} on the tram.", "Membership needs your social security number {ssn} and a photo.", "Aadhaar: {aadhaar}", "Send the rota to {email} tonight.", "Contact {email} with questions about parking.", "Reply to {email}, not to the newsletter.",
    "Regards,\n{name}", "Thanks to {name} for watering the tomatoes.", "Der Schlüssel liegt bei Frau {family} im Laden.", "Le locataire {name} paie chaque mois.", "El alumno {name} llegó tarde.", "Her sister {name} sings tenor.", "Tax ID {tin} must appear on the receipt.",
)
OTHERS = (
    "Order 4471-{d5} shipped on pallet nine.", "ISBN 978-1-{d3}-{d5}-4 is out of print.", "Bus 12 leaves at 07:45 and 18:20.", "The {town} Bridge was closed for painting.", "Turn left behind {town} Station and wait.", "Chapter 14, page 233, figure 7.", "Serial {d7} is engraved below the saddle.", "A Short History of {town} was on the shelf.",
    "Rent rose by 3.5 percent in 1998-2003.", "Platform 4, coach 12, seat 56.", "The {town} Choral Society meets on Tuesdays.", "Mix 250 grams of flour with 125 ml of milk.", "Summer Timetable\nThe ferry runs hourly.", "Lot {d5} sold for 12 000 crowns.", "See volume 3, issue 12, pages 101-117.", "Meet at noon beside the fountain.",
)


def other_texts(count, seed):
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    capital = lambda n: "".join(r.choice("ABCDEFGH") for _ in range(n))

    def made(slot):
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        return {
            "name": ("name", r.choice((f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}"))), "family": ("name", f), "phone": ("phone", r.choice((f"+1 {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"+44 20 {d(4)} {d(4)}"))),
            "email": ("email", r.choice((f"{g}.{f}@postbox.example", f"{f}{d(2)}@choir.org", f"{g} (at) club (dot) net")).lower()), "address": ("address", f"{r.randint(1, 90)} {r.choice(STREETS)}, {r.choice(TOWNS)} {d(6)}"),
            "passport": ("id_number", capital(1) + d(8)), "ssn": ("id_number", f"{d(3)}-{d(2)}-{d(4)}"), "aadhaar": ("id_number", f"{d(4)} {d(4)} {d(4)}"), "tin": ("id_number", f"{d(2)}-{d(7)}"),
        }[slot]

    texts = []
    for _ in range(count):
        text, true = "", []
        for frame in (r.choice(OTHERS), r.choice(PEOPLE), r.choice(OTHERS)):
            for part in re.split(r"(\{\w+\})", frame):
                slot = part[1:-1] if part.startswith("{") else ""
                if slot == "town":
                    text += r.choice(TOWNS)
                elif slot.startswith("d"):
                    text += d(int(slot[1:]))
                elif slot:
                    kind, piece = made(slot)
                    true.append((len(text), len(text) + len(piece), kind))
                    text += piece
                else:
                    text += part
            text += "\n"
        texts.append((text, true))
    plain = {w.lower() for f in (*PEOPLE, *OTHERS) for w in re.findall(r"[^\W\d_]+", re.sub(r"\{\w+\}", " ", f))} - {"history", "choral"}
    return texts, personal.Lists(set(GIVEN[:12]), set(FAMILY[:12]), plain)


def test_other_texts_than_those_learnt_from():
    trees = personal.models()
    texts, lists = other_texts(500, 3)
    found = personal.find_all([t for t, _ in texts], lists, trees)
    for kind in personal.KINDS:
        true = {(i, s, e) for i, (_, spans) in enumerate(texts) for s, e, k in spans if k == kind}
        mine = {(i, s, e) for i, spans in enumerate(found) for s, e, k, _ in spans if k == kind}
        hit = len(true & mine)
        assert hit >= 0.9 * len(true) and hit >= 0.9 * len(mine), (kind, hit, len(true), len(mine))


def runs(text, n=4):
    """Every n words in a row, without digits between."""
    for part in re.split(r"\d+", text.casefold()):
        words = re.findall(r"[^\W\d_]{2,}", part)
        yield from (tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_no_frame_stands_in_a_table(data):
    frames = {run for t, _ in personal.training_texts()[0] for run in runs(t)} | {run for f in (*PEOPLE, *OTHERS) for run in runs(f)}
    for file in sorted(os.listdir(data)):
        table = pq.read_table(f"{data}/{file}")
        for c in table.column_names:
            if str(table.schema.field(c).type) == "string":
                for t in table.column(c).to_pylist():
                    assert not t or frames.isdisjoint(runs(t)), file


@pytest.mark.parametrize("name", ["Ada Bo Cleo Dora Emil Fay", "Ada Bo Cleo Dora Emil Fay Gus Hal"])
def test_names_of_many_parts(name):
    lists = personal.Lists(set(name.split()[:-1]), {name.split()[-1]}, {"the", "old", "keeper"})
    assert (8, 8 + len(name), "name", len(name.split())) in personal.candidates(f"Keeper: {name} the old keeper", lists)
