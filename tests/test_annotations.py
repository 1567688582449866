"""Inline tags, token texts, BIO runs and the files around them."""

import json

import pytest
from pyspark.sql import functions as F

from velum.operators import annotations as A
from velum.plans.gold import gold_corpus, gold_from_corpora, gold_rows
from velum.sources import files


def texts(spark, *values):
    return spark.createDataFrame(
        [(f"d{i}", v) for i, v in enumerate(values)], "doc_id string, text string"
    )


def test_inline_tags(spark):
    df = texts(spark, "nata il <DATE>####, dal <YEAR> a <LOC>###", "niente", "PSA < 4, <NAME># è")
    gold = A.gold_from_inline_tags(df)
    lines = [tuple(r) for r in files.letter_gold_lines(gold).collect()]
    assert lines == [
        ("d0", "8;17;DATE"),
        ("d0", "24;27;YEAR"),
        ("d0", "31;38;LOC"),
        ("d2", "9;15;NAME"),
    ]


BIO = "\n".join(
    ["TEST_NLP test", "", "Visto O", "dal O", "dott. O", "Aldo B-DOCTOR", "Prova I-DOCTOR", "a O",
     "Ipoli B-CITY", "", "TEST_NLP test"]
)


def test_bio_case(spark):
    corpus = gold_corpus(texts(spark, BIO))
    row = corpus.first()
    assert row.text == "Visto dal dott. Aldo Prova a Ipoli"
    assert [(g.entity_type, g.start, g.end) for g in row.gold] == [("NAME", 16, 26), ("LOC", 29, 34)]
    assert row.masked_text == "Visto dal dott. <NAME>**** a <LOC>"


def test_runs(spark):
    tags = ["I-DOCTOR", "B-DOCTOR", "I-DOCTOR", "I-DOCTOR", "B-DOCTOR", "I-HOSPITAL", "I-DOCTOR",
            "B-AGE", "I-AGE", "O", "B-HOSPITAL", "I-HOSPITAL", "O", "I-HOSPITAL"]
    text = "x t\n\n" + "".join(f"w {t}\n" for t in tags) + "\n"
    rows = [(r.start // 2, r.end // 2, r.bio_label) for r in gold_rows(gold_corpus(texts(spark, text))).collect()]
    assert rows == [(1, 3, "B-DOCTOR"), (4, 4, "B-DOCTOR"), (7, 7, "B-AGE"), (10, 11, "B-HOSPITAL")]
    full = (*A.BIO_KEEP, "I-AGE")
    rows = gold_rows(gold_corpus(texts(spark, text), keep=full)).filter("bio_label = 'B-AGE'").collect()
    assert [(r.start // 2, r.end // 2) for r in rows] == [(7, 8)]


def test_long_sentence_offsets(spark):
    words = [f"p{i}" for i in range(1000)]
    text = "h t\n\n" + "\n".join(f"{w} B-CITY" for w in words) + "\n\n"
    corpus = gold_corpus(texts(spark, text)).first()
    assert corpus.text == " ".join(words)
    assert [corpus.text[g.start : g.end] for g in corpus.gold] == words


def test_sentences(spark):
    df = texts(spark, "a O\nb X\n\n\nc O\n\nlost O", "", "a\tB-CITY\n\n")
    recs = {
        r.doc_id: [(s.text, [(x.start, x.end, x.tag) for x in s.labels]) for s in r.records]
        for r in A.sentence_records(df).collect()
    }
    assert recs["d0"] == [("a b", [(2, 3, "X")]), ("", []), ("c", [])]
    assert recs["d1"] == []
    tabbed = A.sentence_records(df, "\t").filter("doc_id = 'd2'").first().records
    assert [(s.text, len(s.labels)) for s in tabbed] == [("a", 1)]
    assert A.token_rows(df).filter("doc_id = 'd0'").count() == 3
    with pytest.raises(ValueError):
        A.sentences("text", ",")


def test_split_corpus(spark):
    chunk = "parola O\n" * 6
    raw = f"breve O\n{A.CORPUS_MARKER}{chunk}\n{A.CORPUS_MARKER}{chunk}"
    df = spark.createDataFrame([(1, raw)], "corpus_id int, text string")
    rows = A.split_corpus(df).orderBy("doc_index").collect()
    assert [r.doc_index for r in rows] == [0, 1]
    assert rows[0].text == f"TEST_NLP test\n\n{chunk}\n\nTEST_NLP test"


@pytest.mark.parametrize("fmt", ["json", "jsonl"])
def test_record_files(spark, tmp_path, fmt):
    records = A.sentence_records(texts(spark, 'È O\n"x" B-CITY\n\nb O\n\n'))
    path = str(tmp_path / "r")
    files.write_sentence_records(records, path, fmt)
    raw = next((tmp_path / "r").glob("doc_id=d0/*.txt")).read_text()
    loaded = json.loads(raw) if fmt == "json" else [json.loads(x) for x in raw.splitlines()]
    assert loaded == [{"text": 'È "x"', "labels": [[2, 6, "B-CITY"]]}, {"text": "b", "labels": []}]
    assert ("È" in raw) == (fmt == "json")
    assert files.read_sentence_records(spark, path, fmt).collect() == records.collect()
    with pytest.raises(ValueError):
        files.record_json(F.col("r"), "xml")


def test_corpus_files(spark, tmp_path):
    corpus = gold_corpus(texts(spark, BIO))
    files.write_gold_corpus(corpus, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/masked")).first().text.startswith("Visto")
    files.write_gold_corpus(corpus, str(tmp_path / "f"), per_document=True)
    csv = next((tmp_path / "f/gold/doc_id=d0").glob("*.csv")).read_text()
    assert csv.splitlines() == ["16,27,B-DOCTOR,NAME", "29,35,B-CITY,LOC"]


def test_readers(spark, tmp_path):
    (tmp_path / "7.txt").write_bytes("uno\r\ndue".encode())
    (tmp_path / "10.txt").write_text("tre")
    (tmp_path / "7_anon.txt").write_text("<NAME>#")
    (tmp_path / "7_anon.csv").write_text("0;2;NAME\n4;6;LOC\n")
    path = str(tmp_path)
    read = files.read_documents(spark, path).orderBy(files.document_order()).collect()
    assert [tuple(r) for r in read] == [("7", "uno\ndue"), ("10", "tre")]
    assert [tuple(r) for r in files.read_inline_tagged(spark, path).collect()] == [("7", "<NAME>#")]
    gold = sorted(tuple(r) for r in files.read_letter_gold(spark, path).collect())
    assert gold == [("7", 0, 3, "NAME"), ("7", 4, 7, "LOC")]
    cases = tmp_path / "cases"
    cases.mkdir()
    (cases / "3_anon.csv").write_text("0,4,B-DOCTOR,NAME\n")
    assert [tuple(r) for r in files.read_case_gold(spark, str(cases)).collect()] == [
        ("3", 0, 3, "B-DOCTOR", "NAME")
    ]
    with pytest.raises(ValueError):
        files.read_token_texts(spark, path, ";")


def test_bodies_are_whole(spark):
    body = "Visto O\nAldo B-DOCTOR\n\nProva I-DOCTOR\n\n\na B-CITY\n"
    df = texts(spark, f"h t\n\n{body}\n\nf t", "no body here", "h t\n\n\n\nf t", None)
    rows = {r.doc_id: r for r in gold_corpus(df).collect()}
    assert rows["d0"].text == "Visto Aldo Prova a"
    assert [(g.start, g.end, g.entity_type) for g in rows["d0"].gold] == [(6, 16, "NAME"), (17, 18, "LOC")]
    assert (rows["d1"].text, rows["d1"].gold, rows["d1"].masked_text) == (None, [], None)
    assert rows["d2"].text == "" and rows["d3"].text is None


def test_from_corpora_to_masks(spark):
    one = "".join(f"parola{k} O\n" for k in range(8)) + "Aldo B-DOCTOR\n"
    raw = f"{one}{A.CORPUS_MARKER}corta O\n{A.CORPUS_MARKER}\n{one}\n{one}"
    df = spark.createDataFrame([(7, raw)], "corpus_id int, text string")
    corpus = gold_from_corpora(df)
    rows = sorted((r.corpus_id, r.doc_index, len(r.text.split(" ")), len(r.gold)) for r in corpus.collect())
    assert rows == [(7, 0, 9, 1), (7, 1, 18, 2)]
    assert gold_rows(corpus, ("corpus_id", "doc_index")).count() == 3
    assert gold_from_corpora(df, min_length=5).count() == 3


def test_order_of_long_numbers(spark):
    ids = ["a9", "a10", "x", "b0" + "1" * 25, "b2" + "0" * 24, "a010"]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    got = [r.doc_id for r in df.orderBy(files.document_order(), "doc_id").collect()]
    assert got == ["x", "a9", "a010", "a10", ids[3], ids[4]]


def test_one_document_reads_one_file(spark, tmp_path):
    """Only the file of the document is among those the plan reads."""
    names = ["7", "77", "a*", "a[b]", "a,b", "{c}", "d+e f", "100%"]
    for name in names:
        (tmp_path / f"{name}.txt").write_text(f"text of {name}")
    for name in names:
        read = files.read_documents(spark, str(tmp_path), doc_id=name)
        assert [tuple(r) for r in read.collect()] == [(name, f"text of {name}")]
        assert len(read.inputFiles()) == 1
    assert files.read_documents(spark, str(tmp_path), doc_id="none").count() == 0
