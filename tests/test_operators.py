"""Operators against brute force and on hand-made rows: nulls, empty tables, ties, long inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from sutraloom.operators import chunks, dialogue, pages, questions, retrieval, vocabulary, wordclass
from sutraloom.streaming import sessions


def test_chunks_like_python(spark):
    def chunk(text, size=60):
        """Chunks by looking for the longest run of sentences that fits, rather than by a running state."""
        marked = "".join(" \0" if c in ".!?" and text[i + 1 : i + 2].isspace() else c for i, c in enumerate(text))
        parts = [s.strip() for s in marked.replace("\0 ", "\0").split("\0")]
        lengths = [(s, len(s)) for s in parts if len(s) > 15]
        done, first, last = [], 0, 1
        while first < len(lengths):  # a chunk has the carried sentence, the one that did not fit before, and what fits
            total = sum(n for _, n in lengths[first:last])
            while last < len(lengths) and total + lengths[last][1] <= size:
                total += lengths[last][1]
                last += 1
            done.append(" ".join(s for s, _ in lengths[first:last]))
            if last == len(lengths):
                break
            first, last = (last - 1 if last - first > 1 else last), last + 1
        return done

    r = random.Random(3)
    texts = [". ".join("w" * r.randint(3, 45) for _ in range(r.randint(0, 9))) for _ in range(300)] + ["", "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string")
    got = df.where("id >= 0").select("id", chunks.chunk_array(F.col("text"), 60).alias("c")).orderBy("id").collect()
    assert [r["c"] for r in got] == [chunk(t) for t in texts]
    ids = chunks.chunk(df, "id", "text", 60, 30).collect()
    assert all(len(r["text"]) >= 30 and chunk(texts[r["id"]])[r["chunk_id"]] == r["text"] for r in ids)


def test_last_wins_and_ids(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "id int, seq int, v string")
    assert {tuple(r) for r in chunks.last_wins(df, ["id"], ["seq"]).select("id", "v").collect()} == {(1, "c"), (2, "z")}
    one = spark.range(1).select(chunks.vector_id(F.lit(r"C:\books/vol\one.pdf"), F.lit(None).cast("int"), F.lit(7), F.lit(2)))
    assert one.first()[0] == "one.pdf|p-1|d7|c2"


def test_small_sources_lose_every_line_unless_it_names_a_term(spark):
    df = spark.createDataFrame([(1, "s", "Head\nbody one\n\nAgni line"), (2, "s", "head\nbody two\nagni line"), (3, None, "head"), (4, "s", None)], "id int, source string, text string")
    got = {r["id"]: r["lines"] for r in pages.drop_repeated(df, "id", "source", "text", ["agni"], 0.5).collect()}
    assert got == {1: ["body one", "Agni line"], 2: ["body two", "agni line"], 3: ["head"], 4: None}
    assert pages.repeated_lines(df.limit(0), "source", "text").count() == 0


def test_integrated_and_clean_pages(spark):
    df = spark.createDataFrame([(1, "a", "ﬁne text अ here. fine fine words\nmore words here"), (2, "a", "अअअ"), (3, None, None), (4, "b", "")], "id int, source string, text string")
    got = {r["id"]: (r["text"], r["entities"]) for r in pages.clean_pages(df, "id", "source", "text", ["words"], 0.9).collect()}
    assert got[1] == ("Fine text here. Fine words more words here", ["words"]) and got[2][0] == "अअअ" and got[3] == (None, None) and got[4][0] == ""
    assert df.select(pages.integrated_clean(F.col("text"))).collect()[0][0] == "fine text here. fine fine words more words here"


def test_lexicon_spelling_and_fuzzy(spark):
    lex = spark.createDataFrame([(1, "vata", ["vaata"]), (2, "Pitta", ["vata", "pittam"]), (3, "--- x ---", [])], "ord int, canonical string, variants array<string>")
    names, variants = pages.lexicon_keys(lex)
    df = spark.createDataFrame([(1, "VATA, vaata pittam. PITTAM other"), (2, None), (3, "")], "id int, text string")
    assert [r[0] for r in df.select(pages.normalise_spelling(F.col("text"), names, variants)).collect()] == ["vata vata Pitta PITTAM other", None, ""]
    assert pages.indel_similarity("kitten", "sitting") == 200 * 4 / 13
    long = spark.createDataFrame([(1, "shirodhaara shirodharx zzz")], "id int, text string")
    one = spark.createDataFrame([(1, "shirodhara", [])], "ord int, canonical string, variants array<string>")
    assert {r["word"] for r in pages.fuzzy_lexicon(long, "id", "text", one).collect()} == {"shirodhaara", "shirodharx"}


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)).round(1)
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(900, None), (901, [0.0] * 8), (902, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    got = {}
    for x in retrieval.top_k(df, "id", "v", asked, "q", "v", 7, block=4).collect():
        got.setdefault(x["q"], []).append((-x["score"], x["id"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        want = sorted((-round(float(s), 6) + 0.0, i) for i, s in enumerate(unit @ unit[q]))[:7]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert retrieval.top_k(df.limit(0), "id", "v", asked, "q", "v").count() == 0
    assert retrieval.top_k(df, "id", "v", asked.limit(0), "q", "v").count() == 0


def test_rerank_and_confidence(spark):
    rows = [(1, 1, -0.5, "food diet", "a", 1), (1, 2, -0.7, "x" * 300, "a", 2), (2, 3, 0.9, None, None, None), (2, 4, 0.9, "y" * 2000, "b", 3)]
    df = spark.createDataFrame(rows, "q int, id int, score double, text string, source string, page int")
    got = {r["id"]: r for r in retrieval.rerank(df, "q", "id", "text", "source", F.lit("diet"), 2).collect()}
    assert got[1]["semantic_score"] == 0 and abs(got[1]["intent_score"] - 2 / 6) < 1e-9 and got[1]["diversity_score"] == 0.5
    assert got[4]["quality_score"] == 0.8 and got[3]["quality_score"] == 0 and got[4]["rank"] == 1 and got[3]["semantic_score"] == 1
    reranked = retrieval.rerank(df, "q", "id", "text", "source", F.lit("diet"), 2)
    assert {r["q"] for r in retrieval.confidence(reranked, "q", "text").collect()} == {1, 2}
    context = {r["q"]: r["context"] for r in retrieval.rendered_context(reranked, "q", "text", "source", "page").collect()}
    assert context[2].startswith("[Source 1: b, Page 3]\n") and "[Source 2: unknown, Page -1]\n" in context[2]


def test_pooling(spark):
    df = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert [round(x, 6) for x in df.select(retrieval.pooled(F.col("v"), F.col("m"))).first()[0]] == [0.6, 0.8]


def test_questions(spark):
    rows = [("Can I eat in this heat and avoid vata?",), ("hello",), (None,), ("treat or prevent",)]
    df = spark.createDataFrame(rows, "q string")
    assert [r[0] for r in df.select(questions.intent(F.col("q"))).collect()] == ["diet", "general", None, "treatment"]
    made = df.select(questions.phrasings(F.col("q"), questions.intent(F.col("q")), questions.entities(F.col("q"))).alias("p")).collect()
    assert made[0]["p"] == ["Can I eat in this heat and avoid vata?", "Ayurvedic diet recommendations Can I eat in this heat and avoid vata?", "Foods to eat and avoid Can I eat in this heat and avoid vata?", "vata classical Ayurvedic texts"]
    assert made[3]["p"] == ["treat or prevent", "Ayurvedic treatment for treat or prevent"]
    follow = df.where("q is not null").select(questions.is_follow_up(F.col("q"), F.lit(True))).collect()
    assert [r[0] for r in follow] == [True, True, True]


def messages(spark, n=30):
    rows = [("s", i, "user" if i % 2 else "assistant", f"note {i} about sleep" if i == 1 else f"cold drink number {i}", i, i) for i in range(1, n + 1)]
    rows += [("s", 3, "user", "late copy", 3, 99), ("t", 1, None, None, 1, 1)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, role string, content string, a int, b int")
    return df.withColumn("ts", F.timestamp_seconds("a")).withColumn("arrived_at", F.timestamp_seconds("b"))


def test_memory(spark):
    once = dialogue.delivered_once(messages(spark))
    assert once.count() == 31 and once.where("seq = 3").first()["content"] == "cold drink number 3"
    kept = [r["seq"] for r in dialogue.last_messages(once).where("session_id = 's'").orderBy("seq").collect()]
    assert kept == list(range(11, 31))
    profile = {r["session_id"]: r for r in dialogue.profile(once).collect()}
    assert profile["s"]["conditions"] == ["sleep", "cold"] and profile["s"]["summary"] == "USER PROFILE: Concerns: sleep, cold" and profile["t"]["summary"] == ""
    last = dialogue.relevant_history(once).where("seq = 29").first()["relevant"].split("\n")
    assert last[0] == "RELEVANT HISTORY:" and last[1] == "USER: cold drink number 9..." and len(last) == 4
    assert dialogue.history(once).where("session_id = 't'").first()["history"] == ": "
    assert dialogue.relevant_history(once.limit(0)).count() == 0


def test_stream_memory_equals_batch(spark, tmp_path):
    once = dialogue.delivered_once(messages(spark)).where("role is not null")
    source = str(tmp_path / "in")
    columns = ["session_id", "seq", "role", "content"]
    once.where("seq <= 12").select(columns).coalesce(1).write.parquet(source)
    once.where("seq > 12").select(columns).coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema("session_id string, seq bigint, role string, content string").option("maxFilesPerTrigger", 1).parquet(source)
    made = sessions.remember(rows).writeStream.format("memory").queryName("memory_state").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    made.awaitTermination()
    state = spark.sql("SELECT * FROM memory_state ORDER BY seen DESC LIMIT 1").first()
    batch = dialogue.last_messages(once).where("session_id = 's'").orderBy("seq").collect()
    assert state["seen"] == 30 and len(state["remembered"]) == 20
    assert sorted(state["conditions"]) == ["cold", "sleep"] and set(state["remembered"]) == {f"{r['role'].upper()}: {r['content']}" for r in batch}


def test_stream_counters(spark, tmp_path):
    source = str(tmp_path / "in")
    messages(spark).write.parquet(source)
    rows = spark.readStream.schema(messages(spark).schema).parquet(source)
    made = sessions.counters(rows).writeStream.format("memory").queryName("counters").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    made.awaitTermination()
    assert made.exception() is None


def test_html_and_dictionary_terms(spark):
    html = "<p class=x>Abhy-anga (oil massage) - rub<br><p>Rasa–<b>taste</b></p><strong>Agni-sara:</strong><strong> </strong><pre>no - no</pre>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert {r[0] for r in vocabulary.glossary_terms(df, "html").collect()} == {"Agni_sara"}
    assert {r[0] for r in vocabulary.entry_terms(df, "html").collect()} == {"abhy", "rasa"}
    assert spark.range(1).select(vocabulary.entry_parts(F.lit("Term (variant) - text"))).first()[0] == ["Term", "variant"]
    lines = spark.createDataFrame([("<s>Darma</s> x <k1>kfzRa</k1><s>st</s>",), (None,)], "line string")
    assert {tuple(r) for r in vocabulary.dictionary_terms(lines, "line").collect()} == {("dharma", "dharma"), ("kṛṣṇa", "krishna")}
    cells = spark.createDataFrame([("rasa - dhātu",), ("Sanskrit term",), (None,), ("",)], "c string")
    assert [tuple(r) for r in vocabulary.table_terms(cells, "c").collect()] == [("rasa_dhātu", "rasa_dhaatu")]


def test_vocabulary(spark):
    first = spark.createDataFrame([("agni", 1), ("kapha", 1)], "ascii string, label int")
    second = spark.createDataFrame([("agni", 0), ("fire", 0)], "ascii string, label int")
    assert {tuple(r) for r in vocabulary.labelled_words(first, second).collect()} == {("agni", 1), ("kapha", 1), ("fire", 0)}
    lists = [spark.createDataFrame([("Ab c",), (None,), ("a-b",)], "t string"), spark.createDataFrame([("ab_c",)], "u string")]
    assert {tuple(r) for r in vocabulary.union_of_terms(lists).collect()} == {("ab_c", 1), ("a_b", 1)}


def test_spelling(spark):
    known = spark.createDataFrame([("Haridra",), ("haridra",), ("triphala",), ("triphala",), ("agni",), (None,)], "v string")
    asked = spark.createDataFrame([("HARIDRA,",), ("triphalla",), ("agni",), ("xx",), ("zzzzzz",), (None,), ("!",)], "w string")
    got = {r["word"]: (r["corrected"], r["score"]) for r in vocabulary.correct_words(asked, "w", known, "v").collect()}
    assert got["HARIDRA"] == ("Haridra", 1.0) and got["agni"] == ("agni", 1.0) and got["triphalla"][0] == "triphala" and got["xx"] == (None, None) == got["zzzzzz"]
    texts = spark.createDataFrame([(1, "take triphalla, now"), (2, None), (3, "")], "id int, t string")
    assert {r["id"]: r["t"] for r in vocabulary.correct_texts(texts, "id", "t", known, "v").collect()} == {1: "taketriphala,now", 2: None, 3: ""}
    assert vocabulary.correct_texts(texts, "id", "t", known, "v", " ").where("id = 1").first()["t"] == "take triphala , now"
    assert vocabulary.correct_words(asked.limit(0), "w", known, "v").count() == 0


def test_word_classes(spark):
    df = spark.createDataFrame([(1, "aab", 0), (2, "B" * 45 + "c", 1), (3, None, None), (4, "", 2)], "id int, w string, label int")
    assert [tuple(r) for r in wordclass.character_index(df, "w").orderBy("rank").collect()] == [("b", 46, 1), ("a", 2, 2), ("c", 1, 3)]
    codes = {r["id"]: r["codes"] for r in wordclass.encoded(df, "id", "w").collect()}
    assert codes[1] == [2, 2, 1] + [0] * 37 and len(codes[2]) == 40 and codes[2][-1] == 3 and set(codes) == {1, 2}
    probability = spark.createDataFrame([([0.1, 0.5, 0.4],), ([0.4, 0.35, 0.25],), ([0.9, 0.05, 0.05],), ([0.2, 0.38, 0.42],)], "p array<double>")
    assert [r[0] for r in probability.select(wordclass.decide(F.col("p"))).collect()] == [1, 0, 0, 1]
    log = spark.createDataFrame([(0, 0.5, 0.9), (1, 0.2, 0.95), (2, 0.2, 0.96)], "epoch int, val_loss double, val_accuracy double")
    assert tuple(wordclass.best_epoch(log).first()) == (2, 0.2, 0.95)
    empty = {r["class"]: r for r in wordclass.class_report(df.limit(0).withColumn("g", F.lit(1)), "label", "g").collect()}
    assert empty["accuracy"]["support"] == 0 and empty["0"]["f1"] == 0
    junk = wordclass.random_junk(spark, 200)
    assert junk.count() == 200 and junk.where(~F.regexp_like("ascii", F.lit("^[a-z]{3,20}$"))).count() == 0
    assert wordclass.misspelled(df, "w").count() == 2 and wordclass.swapped(df, "w").count() == 3


def test_noisy_words(spark, data):
    from sutraloom.plans import registry

    rows = registry.QUERIES["noisy_words"](spark, data)
    real = spark.read.parquet(f"{data}/final_language_dataset.parquet").where("label = 1 AND trim(ascii) <> ''").count()
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {2: 100_000, 1: min(10_000, real)}
    same = spark.range(2000).select(F.lit("bcdefg").alias("w"), F.lit("bde").alias("short"), F.lit("chair").alias("read"))
    made = lambda df: {r["ascii"] for r in df.collect()}
    typos, noisy = made(wordclass.misspelled(same, "w")), made(wordclass.noisy(same, "w"))
    assert {len(w) for w in typos} == {4, 5, 6, 7, 8} and {len(w) for w in noisy} == {4, 5, 6}
    assert {"cbdefg", "bcdfg"} <= typos & noisy and all(len(set(w) & set("bcdefg")) >= 3 for w in typos | noisy)
    assert {len(w) for w in made(wordclass.misspelled(same, "short"))} == {3, 4, 5} and {len(w) for w in made(wordclass.noisy(same, "short"))} == {3}
    read = made(wordclass.swapped(same, "read"))
    assert {"ehair", "cbair", "choir", "chalr", "chain", "eboir"} - read == {"eboir"} and all(sum(a != b for a, b in zip(w, "chair")) <= 2 for w in read)
    assert {r["label"] for r in wordclass.noisy(same, "w").select("label").distinct().collect()} == {1}


def test_classifier_tells_classes_apart(spark):
    r = random.Random(1)
    rows = [("un" + r.choice(["light", "break", "stand", "help"]) + r.choice(["ed", "ing", "ful", "ness"]), 0) for _ in range(150)]
    rows += [("".join(r.choice("kgtdpb") + r.choice(["aa", "ii", "uu"]) for _ in range(4)), 1) for _ in range(150)]
    rows += [("".join(r.choice("xzqw0123456789") for _ in range(8)), 2) for _ in range(150)]
    df = wordclass.split_by_hash(spark.createDataFrame(rows, "ascii string, label int").withColumn("id", F.monotonically_increasing_id()), "id", "ascii")
    model = wordclass.fit_classifier(df.where("part = 'train'"), "ascii", "label")
    test = wordclass.predict(model, df.where("part <> 'train'"), "ascii")
    assert test.where("label = predicted").count() >= 0.9 * test.count()


def test_attach_by_broadcast_and_by_salts(spark):
    from sutraloom.runtime import attach

    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)] + [(900, None)], "id int, k string").withColumn("_salt", F.lit("clash"))
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "key string, v int")
    for limit in (10, 0):
        got = {r["id"]: r["v"] for r in attach(df, "k", side, "key", "id", limit=limit, salts=4).collect()}
        assert len(got) == 91 and got[1] == 1 and got[3] == 2 and got[6] is None and got[900] is None


def test_small_vocabulary_operators(spark, tmp_path):
    words = spark.createDataFrame([(" Agni ", 1), ("fire", 0), (None, 1), ("x", None)], "w string, label int")
    assert {r[0] for r in vocabulary.known_words(words, "w", "label").collect()} == {" agni "}
    assert {tuple(r) for r in wordclass.labelled_rows(words, "w", "label").collect()} == {("Agni", 1), ("fire", 0)}
    assert [r[0] for r in words.select(wordclass.class_name(F.col("label"))).collect()] == ["Sanskrit", "English", "Sanskrit", None]
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "word string, freq int")
    assert {tuple(r) for r in vocabulary.add_words(one, one.limit(1)).collect()} == {("a", 2), ("b", 2)}
    texts = spark.createDataFrame([(1, "Agni, agni (fire)"), (2, None), (3, "")], "id int, t string")
    known = spark.createDataFrame([("agni",)], "word string")
    assert {r["id"]: r["n_known"] for r in vocabulary.preserved_terms(texts, "id", "t", known).collect()} == {1: 2, 2: 0, 3: 0}
    assert sorted(r[0] for r in wordclass.shuffled(texts, "id").select("id").collect()) == [1, 2, 3]


def test_answers(spark):
    from sutraloom.operators import answers

    rows = [("does ginger help with cough", ["Rest is good. Ginger root is given against cough in the morning.", None]), ("x", []), (None, ["Short."])]
    df = spark.createDataFrame(rows, "q string, p array<string>").withColumn("a", answers.extract(F.col("q"), F.col("p"), 1))
    got = answers.judged(df, "q", "a", "p").collect()
    assert got[0]["a"] == "Ginger root is given against cough in the morning." and got[0]["groundedness"] == 1.0 and got[0]["relevance"] > 0.3
    assert got[1]["a"] == answers.NOTHING == got[2]["a"]
    told = df.select(answers.instruction(F.lit("diet"), {"diet": "Eat."}, "Talk."), answers.instruction(F.lit("zzz"), {"diet": "Eat."}, "Talk.")).first()
    assert tuple(told) == ("Eat.", "Talk.")
    asked = df.withColumn("prompt", answers.prompt(F.col("q"), F.lit("ctx"), F.lit(""), F.lit("sys")))
    assert asked.first()["prompt"] == "sys\n\nCONTEXT:\nctx\n\nQUESTION: does ginger help with cough"
    made = answers.generate(asked, "prompt", "out", lambda texts: ["long enough " * 5 if "ginger" in t else "no" for t in texts]).collect()
    assert made[0]["out"].startswith("long") and made[1]["out"] == answers.NOTHING
    assert [r[0] for r in spark.createDataFrame([(0.8,), (0.5,), (0.1,)], "c double").select(answers.badge(F.col("c"))).collect()] == ["high", "medium", "low"]


def test_spelling_inside_the_page_cleaner(spark):
    """Exact and like spellings against a plain walk over the words; a like name counts where the raw page has it."""
    lex = spark.createDataFrame([(1, "shirodhara", ["sirodhara"]), (2, "Triphala", []), (3, "Ashwagandha", ["withania"])], "ord int, canonical string, variants array<string>")
    names = {"shirodhara": "shirodhara", "triphala": "Triphala", "ashwagandha": "Ashwagandha"}
    variants = {"sirodhara": "shirodhara", "withania": "Ashwagandha"}

    def spelled(word, raw):
        bare = "".join(c for c in word if c.isascii() and c.isalpha())
        if not bare:
            return word
        if bare in variants or bare.lower() in names:
            return variants.get(bare) or names[bare.lower()]
        best = max(names.values(), key=lambda n: pages.indel_similarity(bare, n))
        return best if pages.indel_similarity(bare, best) >= 90 and best.lower() in raw.lower() else word

    r = random.Random(4)
    words = ["sirodhara,", "TRIPHALA", "Triphalaa", "Ashwagandhaa.", "withania", "shirodharx", "the", "12", "leaf", "Withania"]
    rows = [(i, "s" if i % 2 else None, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(120)] + [(900, "s", None), (901, "s", "")]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    got = {x["id"]: x["text"] for x in pages.clean_pages(df, "id", "source", "text", [], 0.9, lex).collect()}
    assert got[900] is None and got[901] == ""
    for i, _, text in rows[:120]:
        # sentences end at a point and begin with a capital; a doubled word stays once
        kept = []
        for part in text.replace(". ", ".\0").split("\0"):
            bag: list[str] = []
            for w in (spelled(w, text) for w in part.split()):
                if not bag or bag[-1].lower() != w.lower():
                    bag.append(w)
            made = " ".join(bag)
            kept.append(made[:1].upper() + made[1:] if len(made) > 1 else made)
        assert got[i] == "\n\n".join(" ".join(kept[k : k + 3]) for k in range(0, len(kept), 3)), (text, got[i])


def test_integrated_clean_with_repeated_lines(spark):
    df = spark.createDataFrame([("Old Head\nthe agni line\nBody of the page",), ("short",), (None,)], "t string")
    lines = F.array(F.lit("old head"), F.lit("the agni line"))
    assert [r[0] for r in df.select(pages.integrated_clean(F.col("t"), lines)).collect()] == ["Body of the page", "", None]
    assert [r[0] for r in df.select(pages.integrated_clean(F.col("t"), lines, ["agni"])).collect()] == ["Old Head the agni line Body of the page", "", None]
    assert [r[0] for r in df.select(pages.skip_reason(F.col("t"))).collect()] == [None, "too_short", "too_short"]


def test_relevant_history_in_blocks(spark, monkeypatch):
    """A long session in small blocks gives what one window gives."""
    r = random.Random(9)
    words = "cold dry oil milk root leaf".split()
    rows = [("long", i * r.choice((1, 1, 2)) + 2 * i, r.choice(("user", "assistant")), " ".join(r.choice(words) for _ in range(4))) for i in range(400)]
    rows = list({(s, q): (s, q, role, c) for s, q, role, c in rows}.values()) + [("one", 1, "user", "cold"), (None, 3, "user", None)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, role string, content string")
    whole = sorted(map(tuple, dialogue.relevant_history(df).collect()), key=str)
    monkeypatch.setattr(dialogue, "BLOCK", 25)
    assert sorted(map(tuple, dialogue.relevant_history(df).collect()), key=str) == whole and len(whole) > 150
    at = {(x["session_id"], x["seq"]): x["at"] for x in dialogue.numbered(df, "at").collect()}
    ordered = sorted(q for s, q, _, _ in rows if s == "long")
    assert all(at["long", q] == i for i, q in enumerate(ordered)) and len(at) == len(rows)


def test_session_memory_over_batches_in_any_order(spark, tmp_path):
    """Three files, a batch each, with late, repeated and evicted messages."""
    r = random.Random(2)
    every = [("s", i, "user", f"note {i}" + (" about sleep" if i == 7 else " about fever" if i == 30 else ""), i) for i in range(1, 61)] + [("t", 5, "assistant", None, 1)]
    order = every[:]
    r.shuffle(order)
    parts = [order[:20], order[20:40] + order[:10], order[40:] + [(s, q, role, "late copy", 10_000) for s, q, role, _, _ in order[:30]]]
    schema = "session_id string, seq bigint, role string, content string, a int"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("arrived_at", F.timestamp_seconds("a")).drop("a").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = f"{tmp_path}/in"
    stream = spark.readStream.schema(spark.read.parquet(f"{files}/0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(files)
    updates = sessions.run_once(sessions.remember(stream, 12), f"{tmp_path}/run")
    batches = updates.agg(F.max("batch")).first()[0]
    last = {x["session_id"]: x for x in updates.orderBy("batch").collect()}
    assert batches == 2 and last["s"]["seen"] == 60 and last["t"]["seen"] == 1 and last["t"]["remembered"] == ["ASSISTANT: "]
    assert last["s"]["remembered"] == [f"USER: {c}" for _, q, _, c, _ in every if 48 < q <= 60] and last["s"]["conditions"] == ["sleep", "fever"]


def test_answers_and_confidence(spark):
    df = spark.createDataFrame([(["Agni is fire.", None], ["agni", "ojas"]), ([], [])], "p array<string>, e array<string>")
    from sutraloom.operators import answers

    made = df.withColumn("a", answers.quoted(F.col("p"))).select("a", answers.citations(F.col("a")).alias("c"), answers.coverage(F.col("a"), F.col("e")).alias("v"), retrieval.answer_confidence(F.lit(0.5), F.size("p"), F.col("a"), answers.citations(F.col("a")), answers.coverage(F.col("a"), F.col("e"))).alias("s"))
    a, b = made.collect()
    assert a["a"] == "[Source 1] Agni is fire. [Source 2] " and a["c"] == 2 and a["v"] == 0.5 and b["v"] == 0.5 and b["s"] == 0
    assert a["s"] == round(0.5 * 0.4 + 2 / 5 * 0.2 + len(a["a"]) / 400 * 0.15 + 2 / 3 * 0.15 + 0.05, 6)


def test_checkpoint_folder_needs_a_name_on_a_cluster():
    import pytest

    from sutraloom import runtime

    class Context:
        master = "local-cluster[2,1,1024]"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        return type("None_", (), {"isDefined": staticmethod(lambda: False)})

                return S

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Session)


def test_splits_indices_and_table_pages(spark, tmp_path):
    from sutraloom.sources import writers

    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("label"))
    made = wordclass.stratified_split(df, "label", "id")
    assert made.columns == ["id", "label", "part"] and made.count() == 4000
    for r in made.groupBy("label").agg(F.count("*").alias("n"), *[F.count_if(F.col("part") == p).alias(p) for p in ("train", "valid", "test")]).collect():
        assert abs(r["train"] - 0.7 * r["n"]) <= 1.5 and abs(r["valid"] - 0.15 * r["n"]) <= 2
    assert wordclass.stratified_split(df.limit(0), "label", "id").count() == 0
    assert [tuple(r) for r in wordclass.label_index(df.select((F.col("label") * 5).alias("l")), "l").orderBy("index").collect()] == [(0, 0), (5, 1), (10, 2)]
    cells = spark.createDataFrame([("agni", 498), ("vāta", 499), ("Sanskrit", 500), ("", 501), (None, 502), ("ojas", 606), ("ama", 607)], "c string, p int")
    assert {r["ascii"] for r in vocabulary.table_terms(cells, "c", "p").collect()} == {"vaata", "ojas"} and vocabulary.table_terms(cells, "c").count() == 4
    vectors = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, seq int, v string")
    writers.vectors(vectors, f"{tmp_path}/one")
    writers.upserted_vectors(spark.createDataFrame([("b", 3, "z"), ("c", 4, "w"), ("a", 0, "old")], vectors.schema), spark.read.parquet(f"{tmp_path}/one"), f"{tmp_path}/two")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/two").collect()) == [("a", "x"), ("b", "z"), ("c", "w")]


def test_sorted_words(spark):
    df = spark.createDataFrame([(w,) for w in ("b", "a", "ā", "B", "b", None, "", "a b")], "w string").repartition(5)
    assert [tuple(r) for r in vocabulary.sorted_words(df, "w").orderBy("position").collect()] == list(enumerate(sorted({"b", "a", "ā", "B", "", "a b"})))
    assert vocabulary.sorted_words(df.limit(0), "w").count() == 0


def test_many_terms_like_few(spark, monkeypatch):
    """Terms in the plan and terms in an automaton find the same."""
    r = random.Random(3)
    terms = ["Agni", "ni v", "vata", "VATA", "ā", "ash"]
    rows = [(i, "s", "\n".join("".join(r.choice("aginv tāsh") for _ in range(r.randint(0, 9))) for _ in range(6)) + "\nthe agni head\nhead") for i in range(60)] + [(90, "s", None), (91, None, "")]
    df = spark.createDataFrame(rows, "id int, source string, text string")

    def found():
        a = df.select("id", pages.mentions(F.col("text"), terms).alias("m"))
        b = pages.drop_repeated(df, "id", "source", "text", terms, 0.5).select("id", "lines")
        return sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))

    few = found()
    monkeypatch.setattr(pages, "LITERALS", 0)
    assert found() == few and dict(few[1])[0][-1] == "the agni head"


def test_trigram_candidates_by_rare_trigrams_like_all(spark, monkeypatch):
    r = random.Random(6)
    words = lambda n: [("".join(r.choice("abcde") for _ in range(r.randint(1, 7))),) for _ in range(n)] + [(None,), ("",)]
    asked, known = spark.createDataFrame(words(60), "w string"), spark.createDataFrame(words(400), "v string")
    ways = []
    for most in (vocabulary.PAIRS, -1):
        monkeypatch.setattr(vocabulary, "PAIRS", most)
        ways.append(sorted(map(tuple, vocabulary.trigram_candidates(asked, "w", known, "v", 5).collect())))
    assert ways[0] == ways[1] and len(ways[0]) > 200


def test_trigram_candidates_make_no_rows_of_pairs(spark, monkeypatch):
    """300 words that share more trigrams with each of 3,000 than a search by the rarer ones leaves out: 900,000 pairs."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def moved():
        sc.listenerBus().waitUntilEmpty(30_000)
        lists = [gateway.jvm.java.util.ArrayList() for _ in range(2)]
        return sum(s.shuffleWriteRecords() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(lists[0], False, False, gateway.new_array(gateway.jvm.double, 0), lists[1])))

    monkeypatch.setattr(vocabulary, "PAIRS", -1)
    known = [f"{i:04}_ashvagandhaa" for i in range(3000)]
    asked = [f"{7 * i:04}x_ashvagandhaa" for i in range(300)]
    before, key = moved(), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with tables that are too large for it
    try:
        rows = vocabulary.trigram_candidates(spark.createDataFrame([(w,) for w in asked], "w string"), "w", spark.createDataFrame([(w,) for w in known], "v string"), "v", 3).collect()
    finally:
        spark.conf.set(key, usual)
    assert len(rows) == 900 and {r["word"] for r in rows if r["candidate"] == r["word"][:4] + r["word"][5:]} == set(asked)
    assert 0 < moved() - before < 200_000


def test_trigram_index_against_brute_force(spark, monkeypatch):
    """Over several blocks and shards: ties, many equal counts, other alphabets, words of hundreds of trigrams, words
    without any."""
    from sutraloom.operators import trigrams

    r = random.Random(8)
    words = lambda n, most: {"".join(r.choice("abcā\U00010348क्") for _ in range(r.randint(1, most))) for _ in range(n)} | {"", "a", "#", "aa" * 40}
    long = ["".join(chr(97 + i % 26) + chr(0x4E00 + i) for i in range(400 - 30 * k)) for k in range(4)]
    asked, known = sorted(words(50, 9) | {long[1], "nothing", long[3] + "z"}), sorted(words(500, 7) | {*long})
    cut = lambda w: {f"#{w}#"[i : i + 3] for i in range(len(w))}
    wanted = []
    for w in asked:
        shared = [(-len(cut(w) & cut(v)), v) for v in known]
        wanted += [(w, v, -c) for c, v in sorted(x for x in shared if x[0])[:6]]
    monkeypatch.setattr(vocabulary, "PAIRS", -1)
    for letters, worth in ((4_000_000, 50_000), (700, 100), (4_000_000, 60)):
        monkeypatch.setattr(trigrams, "LETTERS", letters)
        monkeypatch.setattr(trigrams, "WORTH", worth)
        frames = [spark.createDataFrame([(w,) for w in (*ws, ws[3], None)], "w string") for ws in (asked, known)]
        assert sorted(map(tuple, vocabulary.trigram_candidates(frames[0], "w", frames[1], "w", 6).collect())) == sorted(wanted)
    assert vocabulary.trigram_candidates(frames[0].limit(0), "w", frames[1], "w").count() == vocabulary.trigram_candidates(frames[0], "w", frames[1].limit(0), "w").count() == 0
    every = trigrams.Index(known).best(asked, 6)
    monkeypatch.setattr(trigrams, "FLAGGED", 0)
    assert all((a == b).all() for a, b in zip(every, trigrams.Index(known).best(asked, 6)))
