import json

import pytest

from sutraloom.sources import embedders, readers, writers


def test_json_lines_keep_positions(spark, tmp_path):
    lines = ['{"content": "a", "metadata": {"source": "s", "page": 3}}', "[1]", '{"text": "b"}', "", '{"content": "", "text": "c"}', "{}"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = {r["doc_id"]: tuple(r)[1:] for r in readers.json_lines(spark, str(tmp_path / "x.jsonl")).collect()}
    assert got == {0: ("a", "s", 3), 2: ("b", "unknown", -1), 4: ("c", "unknown", -1), 5: ("", "unknown", -1)}


def test_tables_and_lexicons(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,\n", encoding="utf-8")
    assert readers.csv_strings(spark, str(tmp_path / "t.csv"), "a").first().asDict() == {"a": "1", "b": ""}
    with pytest.raises(ValueError):
        readers.csv_strings(spark, str(tmp_path / "t.csv"), "c")
    (tmp_path / "l.json").write_text(json.dumps({"vata": ["vaata"], "--- x ---": []}), encoding="utf-8")
    assert [tuple(r) for r in readers.lexicon_json(spark, str(tmp_path / "l.json")).orderBy("ord").collect()] == [(0, "vata", ["vaata"]), (1, "--- x ---", [])]
    (tmp_path / "v.txt").write_text("agni\t4\nkapha\n\n", encoding="utf-8")
    assert {tuple(r) for r in readers.vocabulary_file(spark, str(tmp_path / "v.txt")).collect()} == {("agni", 4), ("kapha", 1)}
    (tmp_path / "v.json").write_text(json.dumps({"vocab": ["a", "b"], "frequencies": {"a": 2}}), encoding="utf-8")
    assert {tuple(r) for r in readers.vocabulary_object(spark, str(tmp_path / "v.json")).collect()} == {("a", 2), ("b", 1)}


def test_files_and_decoding(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "d" / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "d" / "c.txt").write_bytes(b"no")
    files = readers.pdf_files(spark, str(tmp_path))
    assert files.count() == 2
    pages = readers.decoded_pages(files, lambda b: b.decode("utf-8").split("\f"))
    got = {(r["page"], r["content"], (r["error"] or "")[:18]) for r in pages.collect()}
    assert got == {(1, "one", ""), (2, "two", ""), (None, None, "UnicodeDecodeError")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "ā", "s", 2), (1, 2, "b", "s", 2)], "id int, seq int, content string, source string, page int")
    writers.json_lines(df, str(tmp_path / "j"))
    rows = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert {r["content"] for r in rows} == {"ā", "b"} and rows[0]["metadata"] == {"source": "s", "page": 2}
    writers.vectors(df, str(tmp_path / "v"))
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "v")).collect()] == ["b"]
    writers.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 2
    words = [("a", 1), ("āgni", 7), ("b c", 2)]
    writers.vocabulary_json(spark.createDataFrame(words, "word string, freq int").repartition(2), str(tmp_path / "w.json"))
    assert sorted(tuple(r) for r in readers.vocabulary_file(spark, str(tmp_path / "w.json")).collect()) == sorted(words)


def test_embedder(spark):
    made = embedders.embed(spark.createDataFrame([("a b",), (None,), ("a b",)], "t string"), "t").collect()
    assert len(made[0]["embedding"]) == 384 and made[0]["embedding"] == made[2]["embedding"] and sum(made[1]["embedding"]) == 0


def test_ingest(spark, tmp_path):
    from sutraloom.plans.ingest import ingest

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"HEAD\nThe agnii and agni burn. More of it.\fHEAD\nSecond page is here.\fHEAD\nThird page is here.\fHEAD\nLast.")
    (tmp_path / "in" / "deep" / "scan.pdf").write_bytes(b"  \f ")
    (tmp_path / "in" / "broken.pdf").write_bytes(b"\xff")

    def scanned(content):
        if content == b"\xff":
            raise OSError("no image")
        return ["Read by eye and it is long enough."]

    lexicon = spark.createDataFrame([(1, "agni", ["agnii"])], "ord int, canonical string, variants array<string>")
    failed = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), lexicon, lambda b: b.decode("utf-8").split("\f"), scanned)
    assert [(r["source"].rsplit("/", 1)[1], r["error"]) for r in failed.collect()] == [("broken.pdf", "OSError: no image")]
    rows = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    got = {(r["metadata"]["doc_name"], r["metadata"]["page"]): (r["content"], r["metadata"]["entities"]) for r in rows}
    assert got == {
        ("a.pdf", 1): ("The agni and agni burn. More of it.", ["agni"]), ("a.pdf", 2): ("Second page is here.", []), ("a.pdf", 3): ("Third page is here.", []),
        ("a.pdf", 4): ("Last.", []), ("scan.pdf", 1): ("Read by eye and it is long enough.", []),
    }
