"""The operators on tables: nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns
with clashing names."""

import pytest
from pyspark.sql import functions as F

from sutraloom.llm import copies, encoding, kinds, languages, leaks, lookalikes, packing, personal, scans, sitelines

CLASH = ("_key", "_text", "_new", "_source", "_hashes", "hash", "word", "words", "n", "lang", "kind", "source", "spans", "lost", "pattern", "tokens", "noise", "_fix", "_k", "_t", "maps", "token")


def table(spark, rows, schema="id bigint, text string", clash=True):
    df = spark.createDataFrame(rows, schema)
    for c in CLASH if clash else ():
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


ROWS = [(1, "plain"), (2, None), (3, ""), (4, "   \n"), (None, "ｗｉｄｅ plain"), (5, "long " * 20_000), (6, "plаin wоrd\xa0x"), (6, "plаin wоrd\xa0x"), (7, "dÃ©jÃ  vu")]


@pytest.mark.parametrize("few,limit", [(True, 20_000), (False, 20_000), (True, 1)])
def test_lookalikes(spark, monkeypatch, few, limit):
    if not few:
        monkeypatch.setattr(lookalikes, "LOOKUP_ROWS", -1)
    extra = [(8, "nose rose noseband nosebleed"), (9, "a νοsе and a νοsеbаnd"), (None, "a νοsе"), (10, "wаter"), (10, "νοsеs")]
    df = table(spark, ROWS + extra)
    made = lookalikes.unify(df, "text", limit=limit)
    assert made.columns == df.columns and made.count() == len(ROWS + extra)
    got = {(r["id"], r["text"]) for r in made.collect()}
    assert {(6, "plain word x"), (None, "wide plain"), (2, None), (7, "dÃ©jÃ  vu"), (9, "a nose and a noseband"), (None, "a nose"), (10, "water"), (10, "voses"), (3, ""), (4, "   \n")} < got
    changed = lookalikes.unify(df, "text", only_changed=True, limit=limit)
    assert sorted(r["id"] or 0 for r in changed.collect()) == [0, 0, 6, 6, 9, 10, 10]
    assert lookalikes.unify(df.limit(0), "text", limit=limit).count() == 0
    spelled = {r["word"]: r["canonical"] for r in lookalikes.spellings(df, "text", limit).collect()}
    assert spelled == {"νοsе": "nose", "νοsеbаnd": "noseband"}


def test_encoding(spark):
    df = table(spark, ROWS)
    made = encoding.repair_encoding(df, "id", "text").collect()
    assert [(r["id"], r["text"]) for r in made] == [(7, "déjà vu".replace("à ", "Ã "))] or made[0]["text"].startswith("déj")
    whole = encoding.with_repaired(df, "text")
    assert whole.count() == len(ROWS) and set(df.columns) < set(whole.columns)
    assert {r["text"]: r["repaired"] for r in whole.select("text", "repaired").collect()}["plain"] == "plain"
    assert encoding.repair_encoding(df.limit(0), "id", "text").count() == 0


def pages(spark, n=20):
    rows = [(i, "site", f"Share this!\nown text {'abcdefghij'[i % 10]}{'klmno'[i // 10]}\n12\nShare   THIS") for i in range(n)]
    rows += [(100, None, "Share this!"), (101, "site", None), (102, "few", "Share this"), (103, "site", ""), (104, "site", "own text ak"), (104, "site", "own text ak")]
    return table(spark, rows, "id bigint, site string, text string")


@pytest.mark.parametrize("small", [True, False])
def test_site_lines(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(sitelines, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(sitelines, "BROADCAST_SOURCES", -1)
    df = pages(spark)
    found = {(r["id"], r["line_no"]) for r in sitelines.find_lines(df, "id", "site", "text").collect()}
    assert found == {(i, k) for i in range(20) for k in (1, 4)}
    made = sitelines.remove_lines(df, "site", "text")
    assert made.columns == df.columns and made.count() == df.count()
    got = {r["id"]: r["text"] for r in made.collect()}
    assert got[0] == "own text ak\n12" and got[100] == "Share this!" and got[101] is None and got[102] == "Share this" and got[103] == ""
    assert sitelines.find_lines(df.limit(0), "id", "site", "text").count() == 0


def test_site_lines_need_records_and_share(spark):
    rows = [(i, "s", "head line\nx" + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (i // 26 + 1)) for i in range(4)] + [(i, "t", ("foot line\n" if i < 5 else "") + "y" + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (i // 26 + 1)) for i in range(40)]
    assert sitelines.frequent_lines(table(spark, rows, "id bigint, site string, text string"), "site", "text").count() == 0


def test_kinds(spark):
    prose = "The leaf of the plant is given for the cough and a little water is taken in the morning with the food."
    rows = [(i, prose) for i in range(8)] + [(20, None), (21, " \n"), (22, "1. Ginger\n2. Neem\n3. Rice\n4. Salt\n5. Milk"), (23, "|_^~#" * 40), (24, "a\tb\n1\t2\n3\t4\n5\t6"), (25, "!"), (26, "x " * 50_000)]
    df = table(spark, rows)
    got = {r["id"]: r["kind"] for r in kinds.classify(df, "id", "text", frozenset("the of and a in is for with".split())).collect()}
    assert got[0] == "prose" and got[22] == "list" and got[23] == "junk" and got[24] == "table" and not {20, 21} & got.keys() and {25, 26} < got.keys()
    assert kinds.classify(df.limit(0), "id", "text", frozenset()).count() == 0
    with pytest.raises(ValueError):
        kinds.common_words(spark.range(50).select(F.col("id").cast("string").alias("word")), limit=10)


def sentence(n, german):
    who, does, what, when = (
        (["Die Wurzel der Pflanze", "Ein wenig Wasser", "Der alte Arzt", "Das Pulver aus Kurkuma", "Die warme Asche"], ["beruhigt meistens", "verringert sofort", "schützt immer", "löst langsam"], ["den Husten", "das Fieber", "die müden Gelenke", "den schweren Kopf", "das Blut"], ["am frühen Morgen", "nach dem Essen", "über sieben Tage", "in der kalten Jahreszeit"])
        if german
        else (["The leaf of the plant", "A little water", "The old physician", "Fresh juice of ginger", "The warm ash"], ["often calms", "slowly loosens", "clears", "works well on"], ["the cough", "a fever", "stiff joints", "heaviness of the head", "thirst"], ["in the morning", "after a long journey", "for seven nights", "when the pulse is slow"])
    )
    return f"{who[n % 5]} {does[n % 4]} {what[n // 3 % 5]} {when[n // 7 % 4]}."


def test_languages(spark):
    en, de = (lambda n: sentence(n, False)), (lambda n: sentence(n, True))
    rows = [(i, f"{en(3 * i)} {en(5 * i + 1)} {en(7 * i + 2)}", "en" if i % 2 else "English", False) for i in range(30)]
    rows += [(100 + i, f"{de(3 * i)} {de(5 * i + 1)} {de(7 * i + 2)}", "deu", None) for i in range(30)]
    rows += [(50, en(131) + " " + de(132), "en", False), (51, de(133), "en", False), (52, en(134), None, False), (53, None, "en", None), (54, "", "de", True), (55, "word word", "de", False), (56, en(135) + " " + "the leaf of ginger " * 6_000 + ".", "en", False)]
    df = table(spark, rows, "id bigint, text string, tag string, wrapped boolean")
    detected = languages.detect(df, "id", "text", "tag", "wrapped")
    got = {}
    for r in languages.wrong_or_mixed(detected, "id").collect():
        got.setdefault(r["id"], set()).add(r["lang"])
    assert got == {50: {"en", "de"}, 51: {"de"}, 52: {"en"}}
    assert languages.detect(df.limit(0), "id", "text", "tag", "wrapped").count() == 0
    whole = {r["id"]: (r["lang"], r["sentences"]) for r in detected.collect()}
    assert whole[55][1] == 0 and not {53, 54} & whole.keys() and whole[56] == ("en", 2)  # each text with a letter has its language


def test_languages_are_the_labels(spark):
    """Labels in no list are languages, also in another alphabet; a label that only repeats another language is none."""
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyzäöüß", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύ")
    en, de = (lambda n: sentence(n, False)), (lambda n: sentence(n, True))
    rows = [(i, f"{en(3 * i)} {en(5 * i + 1)} {en(7 * i + 2)}", "en") for i in range(40)]
    rows += [(100 + i, f"{de(3 * i)} {de(5 * i + 1)} {de(7 * i + 2)}", "tlh") for i in range(40)]
    rows += [(200 + i, " ".join(de(k).lower().translate(greek) for k in (3 * i, 5 * i + 1, 7 * i + 2)), "Greekish") for i in range(40)]
    rows += [(300 + i, f"{en(2 * i + 900)} {en(5 * i + 77)}", "blog") for i in range(12)]
    rows += [(400, f"{en(131)} {de(132)}", "en"), (401, de(133).lower().translate(greek), None), (402, "η ωέρζελ", "en")]
    got = {}
    for r in languages.detect(table(spark, [(*r, False) for r in rows], "id bigint, text string, tag string, wrapped boolean"), "id", "text", "tag", "wrapped").collect():
        got.setdefault(r["id"], set()).add((r["lang"], r["sentences"] > 0))
    assert got[400] == {("en", True), ("tlh", True)} and got[401] == {("greekish", True)} and got[402] == {("greekish", False)}
    assert {x for i, v in got.items() if 300 <= i < 400 for x in v} == {("en", True)}


def test_notices_of_small_sites(spark):
    en, notice = (lambda n: sentence(n, False)), " ".join(sentence(n, True) for n in (131, 132, 133))
    assert len(notice) > 160
    rows = [(i, f"{en(3 * i)} {en(5 * i + 1)} {en(7 * i + 2)}", "en", f"site{i % 90}") for i in range(900)]
    rows += [(1000 + i, f"{sentence(3 * i, True)} {sentence(5 * i + 1, True)} {sentence(7 * i + 2, True)}", "de", None) for i in range(60)]
    rows += [(2000 + i, f"{en(3 * i)} {en(5 * i + 1)}\n{notice}\n{sentence(131, True)}", "en", "small") for i in range(6)]
    rows += [(2100 + i, f"{en(3 * i)} {en(5 * i + 1)}\n{notice}", "en", None) for i in range(2)]
    df = table(spark, [(*r, False) for r in rows], "id bigint, text string, tag string, site string, wrapped boolean")
    hits = {r["id"] for r in languages.wrong_or_mixed(languages.detect(df, "id", "text", "tag", "wrapped", "site"), "id").collect()}
    assert hits == {2100, 2101}


def test_words(spark):
    english = ["unlight", "lightful", "breaking", "unbreaking", "lighting", "breakful", "unhelpful", "helping"]
    other = ["khaadiitu", "thaakiinu", "khiithaanu", "naakhiitaa", "thiikhaadu", "daathiikhu", "niithaakhu", "kaathiidu"]
    rows = [(i, w, 0) for i, w in enumerate(english * 6)] + [(100 + i, w, 1) for i, w in enumerate(other * 6)] + [(200, "unlighting", 1), (201, "khaathiinu", None), (202, None, 0), (203, "", 1), (204, "ｌｉｇｈｔｉｎｇ", 0)]
    got = {r["id"]: r["right"] for r in languages.classify_words(table(spark, rows, "id bigint, text string, label int"), "id", "text", "label").collect()}
    assert got[200] == "0" and got[201] == "1" and 202 not in got and got[203] is None and got[204] == "0"
    assert languages.classify_words(table(spark, [], "id bigint, text string, label int"), "id", "text", "label").count() == 0


@pytest.mark.parametrize("limit,hot", [(50_000, 100_000), (3, 4), (1, 100_000)])
def test_copies(spark, limit, hot):
    forms = ["Kafa", "kafa ", "KA-FA", "“kafa”", "ka_fa"]
    rows = [(i, forms[i % 5] if i % 3 == 0 else f"term {i % 40:04d}x{i % 7}", None) for i in range(300)] + [(900, None, None), (901, "", "{}"), (902, "kafa", '{"a": "b"}'), (5, "term 0005x5", None)]
    df = table(spark, rows, "id bigint, text string, fields string").repartition(4)
    keyed = copies.with_key(df, "id", ["text", "fields"], copies.canonical_entry, "t")
    counted = {r["key"]: (r["n_copies"], r["first_id"]) for r in copies.count_records(keyed, limit).collect()}
    want: dict = {}
    for i, t, f in rows:
        if (k := copies.canonical_entry(t, f)) is not None:
            want.setdefault(k, []).append(i)
    assert {bytes(k): v for k, v in counted.items()} == {k: (len(v), min(v)) for k, v in want.items()}
    links = {(r["first_id"], r["copy_id"]) for r in copies.find_copies(keyed, limit, hot).collect()}
    assert links == {(min(v), i) for v in want.values() for i in v if i > min(v)}
    assert copies.find_copies(keyed.limit(0)).count() == 0


def test_packing(spark):
    rows = [(i, "word " * (i % 90 + 1)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "word " * 2000), (1003, "x" * 100_000)]
    df = table(spark, rows)
    limits = spark.createDataFrame([(1, 64), (2, 256), (3, None), (4, 0)], "limit_id int, capacity int")
    packed = packing.pack(df, "id", "text", limits, "limit_id", "capacity", shard=150)
    sizes = {r["id"]: r["n"] for r in packing.count_tokens(df, "id", "text").collect()}
    assert not {1000, 1001} & sizes.keys()
    for limit, capacity in ((1, 64), (2, 256)):
        mine = packed.where(F.col("limit_id") == limit).collect()
        fill, parts = {}, {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
            parts.setdefault(r["id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
        assert max(fill.values()) <= capacity and parts.keys() == sizes.keys()
        for i, p in parts.items():
            assert sum(x[2] for x in p) == sizes[i] and (len(p) == 1) == (sizes[i] <= capacity) and [x[1] for x in sorted(p)] == [k * capacity for k in range(len(p))]
        assert len(fill) <= 1.03 * sum(fill.values()) / capacity + 5
    assert packed.where("limit_id > 2").count() == 0
    assert packing.usage(packed, limits, "limit_id", "capacity").count() == 2
    assert packing.pack(df.limit(0), "id", "text", limits, "limit_id", "capacity").count() == 0


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, item), (None, item)], "item bigint, question string")
    docs = table(spark, [(1, "before " + item.upper() + " after"), (2, None), (3, ""), (4, " ".join(item.split()[:15])), (5, "y " * 100_000), (1, "before " + item + " after")])
    for block in (4_000, 1):
        found = leaks.find_leaks(docs, "id", "text", items, "item", "question", block=block)
        assert sorted({(r["id"], r["item"]) for r in found.collect()}) == [(1, 1), (1, 4)]
    for block in (4_000, -1):
        assert leaks.find_leaks(docs.limit(0), "id", "text", items, "item", "question", block=block).count() == 0
        assert leaks.find_leaks(docs, "id", "text", items.limit(0), "item", "question", block=block).count() == 0


@pytest.mark.parametrize("bits", [30, 6])
def test_leaks_in_buckets_like_the_matcher(spark, data, monkeypatch, bits):
    """Beyond a block of items: the same rows over the whole tables, also where the table of windows is full."""
    monkeypatch.setattr(leaks, "SLOT_BITS", bits)
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    ways = [sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text", block=b).collect())) for b in (4_000, 10)]
    assert ways[0] == ways[1] and ways[0]


def test_personal(spark):
    names = spark.createDataFrame([("Ada", "given"), ("Quillfeather", "family"), (None, "given")], "name string, name_part string")
    text = "Questions? ada.quill@post.example or ring +1 617 555 0131. Signed: Ada Quillfeather"
    df = table(spark, [(1, text), (1, text), (2, None), (3, ""), (4, "the root of the plant " * 5_000)])
    found = {(r["id"], r["kind"], r["found_text"]) for r in personal.find_personal(df, "id", "text", names).collect()}
    assert found == {(1, "email", "ada.quill@post.example"), (1, "phone", "+1 617 555 0131"), (1, "name", "Ada Quillfeather")}
    redacted = personal.redact_personal(df, "id", "text", names).collect()
    assert len(redacted) == 5 and {r["text"] for r in redacted if r["id"] == 1} == {"Questions? [EMAIL] or ring [PHONE]. Signed: [NAME]"}
    assert personal.find_personal(df.limit(0), "id", "text", names.limit(0)).count() == 0


def test_ordinary_words_have_no_last_place(spark, monkeypatch):
    word = lambda i: "".join("bcdfghklmn"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:05d}")
    rows = [(b * 8 + k, " ".join(word(i) for i in range(b * 500, b * 500 + 500))) for b in range(70) for k in range(5)]
    heads = [(10_000 + i, f"{word(i).capitalize()} {word(i + 1).capitalize()} Quillfeather, {word(i).capitalize()} {word(i + 1).capitalize()}'s") for i in range(0, 35_000, 1_400)]
    df = table(spark, rows + heads, "id bigint, text string")
    assert personal.ordinary_words(df, "text")[0].count() == 35_000
    names = spark.createDataFrame([("Ada", "given"), ("Quillfeather", "family")], "name string, name_part string")
    ways = []
    for most, share in ((200_000, 5e-6), (-1, 5e-6), (-1, 1.0)):  # all broadcast, the frequent ones, none
        monkeypatch.setattr(personal, "KNOWN_WORDS", most)
        monkeypatch.setattr(personal, "COMMON_SHARE", share)
        ways.append((sorted(map(tuple, personal.find_personal(df, "id", "text", names).collect())), sorted(map(tuple, personal.redact_personal(df, "id", "text", names).collect()))))
    assert ways[0] == ways[1] == ways[2] and len(ways[0][1]) == len(rows + heads)


@pytest.mark.parametrize("small", [True, False])
def test_scans(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(scans, "BROADCAST_ROWS", -1)
    body = "the leaf of the plant is given for the cough and the root\nis taken in the morning with a little water when the body\nis warm and the mind is still in the rainy months."
    rows = [(100 + i, body, True) for i in range(90)] + [(0, body, True)]
    rows += [(50, "THE LAMP OF REMEDIES    7\n" + body, True), (51, body + "\n[12]", True), (52, body.replace("morning", "mor¬\nning"), True), (53, body.replace("with", "witli"), True), (54, body.replace("with", "witli"), False), (55, None, True), (56, "", None), (57, "web page line", None), (58, body.replace("with", "witli"), None), (58, body.replace("with", "witli"), None)]
    df = table(spark, rows, "id bigint, text string, scanned boolean")
    found = sorted((r["id"], r["noise"]) for r in scans.find_noise(df, "id", "text", "scanned").distinct().collect())
    assert found == [(50, "header"), (51, "page_no"), (52, "hyphen"), (53, "misread"), (58, "misread")]
    made = {r["id"]: r["text"] for r in scans.repair(df, "id", "text", "scanned").collect()}
    assert made[50] == made[51] == made[52] == made[53] == made[0] == body.replace("\n", " ") and made[54] == body.replace("with", "witli") and made[55] is None and made[57] == "web page line"
    assert scans.find_noise(df.limit(0), "id", "text", "scanned").count() == 0
