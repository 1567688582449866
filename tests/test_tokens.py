"""Tokens read by the batch, against the expressions that read one text."""

import itertools
import random

from pyspark.sql import functions as F

from velum.labels import BIO_KEEP
from velum.operators import annotations as A
from velum.operators import tokens
from velum.plans.gold import gold_corpus
from velum.sources import files

LINES = ["", "", "a O", "bè B-DOCTOR", "c I-DOCTOR", "d", "e  I-DOCTOR", " B-CITY", "f B-DATE x", "g I -DATE",
         "𝒽 I-HOSPITAL", "i B-HOSPITAL", "j X", "k ", "l -", "m B-AGE", "n O-", "tab\tB-CITY"]


def texts(spark):
    draw = random.Random(5)
    short = ["\n".join(p) for n in range(6) for p in itertools.product(["", "a B-DOCTOR"], repeat=n)]
    drawn = ["\n".join(draw.choices(LINES, k=draw.randint(1, 40))) for _ in range(1500)]
    values = [None, *short, *drawn]
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)


def equal(one, other):
    assert one.columns == other.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_sentences_by_batch(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 100)
    df = texts(spark)
    for sep in A.SEPARATORS:
        sents = df.selectExpr("doc_id", f"{A.sentences('text', sep)} AS sents")
        labels = "transform(filter(s, t -> NOT (t.tag <=> 'O')), t -> named_struct('start', t.start, 'end', t.`end`, 'tag', t.tag))"
        records = sents.selectExpr(
            "doc_id",
            f"transform(sents, s -> named_struct('text', {A.sentence_text('s')}, 'labels', {labels})) AS records",
        )
        equal(A.sentence_records(df, sep), records)
        rows = sents.selectExpr("doc_id", "posexplode(sents) AS (sent_id, t)").selectExpr(
            "doc_id", "sent_id", "inline(t)"
        )
        equal(A.token_rows(df, sep), rows)


def test_bodies_by_batch(spark):
    df = texts(spark)
    for sep, keep in ((" ", BIO_KEEP), (" ", (*BIO_KEEP, "X", "-", "I-AGE", "O")), ("\t", BIO_KEEP)):
        body = df.selectExpr("doc_id", f"{A.body_tokens('text', sep)} AS tokens")
        runs = body.selectExpr(
            "doc_id",
            f"CASE WHEN tokens IS NOT NULL THEN {A.sentence_text('tokens')} END AS text",
            f"{A.bio_runs(A.labelled('coalesce(tokens, array())'), keep)} AS gold",
        )
        equal(gold_corpus(df, sep, keep).drop("masked_text"), runs)


def test_no_fold_over_tokens(spark):
    """Reading tokens is not a fold in which each step copies what was gathered."""
    df = texts(spark)
    for out in (A.sentence_records(df), A.token_rows(df), gold_corpus(df).select("text", "gold")):
        assert "aggregate(" not in out._jdf.queryExecution().executedPlan().toString()
    assert gold_corpus(df).select(F.size("gold")).count() == df.count()


def test_label_json(spark):
    """Plain tags are written as they are, others escaped; missing parts are left out."""
    tags = ["B-CITY", 'q"', "b\\", "n\n", "\n", "", "è", "~ [x]/'", None, "\t"]
    records = [("t", [(i, i + 1, t) for i, t in enumerate(tags)] + [(None, 3, "X"), (3, None, None)])]
    df = spark.createDataFrame([(records,)], f"r {tokens.RECORDS}").selectExpr("r[0] AS r")
    for fmt, e in (("json", "è"), ("jsonl", "\\u00E8")):
        names = ['"B-CITY"', '"q\\""', '"b\\\\"', '"n\\n"', '"\\n"', '""', f'"{e}"', '"~ [x]/\'"', "null", '"\\t"']
        want = [f"[{i}, {i + 2}, {n}]" for i, n in enumerate(names)] + ['[4, "X"]', "[3, null]"]
        got = df.select(files.record_json(F.col("r"), fmt)).first()[0]
        assert got == f'{{"text": "t", "labels": [{", ".join(want)}]}}'
    plan = df.select(files.record_json(F.col("r"), "json"))._jdf.queryExecution().optimizedPlan()
    assert "RLIKE" in plan.toString()
