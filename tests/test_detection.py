"""Patterns searched and masked by the batch against the expressions for one text."""

import datetime as dt
import random

import pyarrow as pa
import pytest

import velum
from velum.functions import finders, mask, patterns, resolve
from velum.functions.dates import parse_date
from velum.operators import detection

REFERENCE = dt.date(2026, 12, 31)
ENTITIES = ["telephone", "zipcode", "email", "fiscal_code", "date", "age"]
WORDS = [
    "+39 ", "(0039)", "349 1234567", "051/9406275", "02.12345678", "0", "3", " 47122 ", "é47122𝄞", "47122",
    "a@b.it", "x.y@posta.c.example.it", "@", "a@b.c.", "QWXZKJ61P07M554T", "anni", "ANNI ", " 66", "٣٤", "𝟗 ",
    "anni　", "12/3/99", "31.02.2020", "29-2-2024", "7 Mag 2020", "GENNAIO/77", "ſet 12", "1.100.5", "99 ",
    "10.0 7", "2020", ".", "/", "-", " ", "\n", "\x1c", "\x01", "￿", "￾", "è", "𝄞", "testo", "<", "\\0",
]


def texts():
    rng = random.Random(5)
    plain = [w for w in WORDS if w.isascii()]
    made = ["".join(rng.choices(rng.choice([WORDS, plain]), k=rng.randint(0, 30))) for _ in range(600)]
    controls = "".join(map(chr, range(1, 32)))
    return [None, "", "senza", *made, f"{controls} il 1/2/2020 {controls} anni 5", "a1" * 9000 + " 5 anni"]


def config(entities=ENTITIES, **values):
    models = {"models": dict.fromkeys(entities, "regex"), "mask": values}
    return velum.DeidConfig.from_dict(models, reference_date=REFERENCE)


@pytest.mark.parametrize(
    "entities, mode, level",
    [(ENTITIES, "anon_l", "year"), (ENTITIES, "tag_l", "month"), (["date", "age"], "tag", "hide"),
     (["email"], "anon", "hide"), ([], "tag", "hide")],
)
def test_as_the_expressions(spark, monkeypatch, entities, mode, level):
    cfg = config(entities, mode=mode, date_level=level)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id int, text string").repartition(2)
    found = finders.pattern_spans("text", entities, REFERENCE)
    want = df.selectExpr("doc_id", "text", f"{found} AS spans").selectExpr(
        "*", f"{resolve.resolve('spans')} AS kept"
    )
    shown = mask.mask("text", "kept", cfg.mode, cfg.special_character, cfg.date_level, REFERENCE)
    want = {r.doc_id: r for r in want.selectExpr("doc_id", "spans", "kept", f"{shown} AS shown").collect()}
    for merge in (False, True):
        got = velum.deidentify(df, cfg, merge=merge).collect()
        assert len(got) == len(want)
        for r in got:
            assert r.masked_text == want[r.doc_id].shown
            assert r.spans == (want[r.doc_id].kept if merge else want[r.doc_id].spans)
        rows = sorted(map(tuple, velum.find_spans(df, cfg, merge).collect()))
        assert rows == sorted((r.doc_id, *s) for r in got for s in r.spans)


def test_reads_dates_as_the_expression(spark):
    rng = random.Random(6)
    parts = ["", "0", "00", "7", "12", "13", "31", "32", "99", "100", "101", "2020", "0099", "9" * 11, "mag", "set", "٣", "x"]
    made = {
        "".join(p + s for p, s in zip(rng.choices(parts, k=3), [*rng.choices("-/. ", k=n - 1), ""]))
        for n in (1, 2, 3)
        for _ in range(1500)
    }
    df = spark.createDataFrame([(t,) for t in sorted(made)], "t string").repartition(4)
    rows = df.selectExpr("t", f"{parse_date('t', REFERENCE)} AS d").collect()
    assert {r.t: r.d and tuple(r.d) for r in rows} == {t: detection.read_date(t, REFERENCE) for t in made}


def test_parts_of_a_batch(monkeypatch):
    """A batch gives the same however it is cut, also where a text is longer than a part."""
    cfg = config(mode="anon_l", date_level="year")
    whole = pa.array(texts(), pa.string())

    def work():
        return detection.masked("text", cfg, False)

    calls = []
    monkeypatch.setattr(detection.F, "arrow_udf", lambda _: lambda f: lambda _: f)
    want = work()(whole)
    monkeypatch.setattr(detection, "PART", 50)
    monkeypatch.setattr(detection, "_found", lambda *a, found=detection._found: calls.append(1) or found(*a))
    assert work()(whole).equals(want)
    assert len(calls) > 100
    assert work()(whole.slice(3, 0)).to_pylist() == []
    assert work()(whole.slice(40, 60)).equals(want.slice(40, 60))


def test_marks_are_in_no_text():
    data = "".join(map(chr, [*range(1, 32), 0xE000, 0xE001])).encode()
    assert detection._mark(detection.np.frombuffer(data, "u1")) == ""


def test_classes_of_both_engines(spark):
    """The classes spelt out are those of the patterns that Spark's functions use."""
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    blank = f"c RLIKE r'[{patterns.BLANK}]'"
    digit = rf"c RLIKE r'{patterns.DIGIT}'"
    rows = {r.c: (r.blank, r.digit) for r in df.selectExpr("c", f"{blank} blank", f"{digit} digit").collect()}
    assert {c for c in chars if rows[c][0]} == {c for c in chars if ord(c) in patterns._BLANKS}
    assert {c for c in chars if rows[c][1]} == {c for c in chars if c.isdecimal()}


def test_masks_without_interpreted_functions(spark):
    """Finders and masks are not higher-order functions, which Spark does not compile."""
    df = spark.createDataFrame([("a", "il 1/2/2020")], "doc_id string, text string")
    cfg = config(mode="anon_l", date_level="year")
    for out in (velum.deidentify(df, cfg, merge=True), velum.find_spans(df, cfg, merge=True)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan
        assert not any(x in plan for x in ("regexp_replace", "aggregate(", "Exchange"))
