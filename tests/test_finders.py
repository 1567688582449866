"""Finders against listed cases and against Python's regular expressions."""

import datetime as dt
import random
import re

import pytest

from velum.functions import finders
from velum.functions import patterns as P


REFERENCE = dt.date(2026, 12, 1)


def python(pattern):
    return pattern.replace(r"\p{Nd}", r"\d").replace(r"\P{Nd}", r"\D")


FINDERS = {
    "telephone": (finders.find_telephone, python(P.telephone(r"\s"))),
    "zipcode": (finders.find_zipcode, python(P.ZIP_CODE)),
    "email": (finders.find_email, P.email(r"\s")),
    "fiscal_code": (finders.find_fiscal_code, python(P.FISCAL_CODE)),
    "age": (finders.find_age, python(P.age(r"\s"))),
    "date": (finders.find_date_candidates, python(P.DATE)),
}


def expected(name, text):
    if name in ("age", "date"):
        text = text.lower()
    inset = 1 if name == "zipcode" else 0
    return [
        (m.start() + inset, m.end() - inset, m.group()[inset : len(m.group()) - inset])
        for m in re.finditer(FINDERS[name][1], text)
    ]


def found(spark, name, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.selectExpr("id", f"{FINDERS[name][0]('text')} AS hits").collect()
    return [[tuple(h) for h in r.hits] for r in sorted(rows)]


CASES = [
    ("telephone", "+(39) 317 2604918", [(0, 17)]),
    ("telephone", "051/9406275", [(0, 11)]),
    ("zipcode", "x 47122 y", [(2, 7)]),
    ("zipcode", "47122", []),
    ("zipcode", "x 47122 47123 y", [(2, 7)]),
    ("email", "a.b@example.it", [(0, 14)]),
    ("email", "(a@b.it)", [(0, 8)]),
    ("email", "a@b.it.", [(0, 6)]),
    ("email", "a@b.c", []),
    ("fiscal_code", "CF QWXZKJ61P07M554T", [(3, 19)]),
    ("age", "di anni 66", [(3, 10)]),
    ("age", "66anni", [(0, 6)]),
    ("date", "Gennaio 2020.", [(0, 12)]),
    ("date", "7 mag 2020", []),
    ("date", "2,20-1,90", [(2, 6)]),
    ("date", "1/2/3/4", [(0, 5)]),
    # Every alternative and separator by hand, whatever the patterns say.
    ("telephone", "317 2604918", [(0, 11)]),
    ("telephone", "317-2604918 317.2604918 317/2604918 317\\2604918", [(0, 11), (12, 23), (24, 35), (36, 47)]),
    ("telephone", "02 12345678", [(0, 11)]),
    ("telephone", "051 12345", [(0, 9)]),
    ("telephone", "051 1234567", [(0, 11)]),
    ("telephone", "0544 12345 0544 123456", [(0, 10), (11, 22)]),
    ("telephone", "0039 317 2604918", [(0, 16)]),
    ("telephone", "(+39)-317 2604918", [(0, 17)]),
    ("telephone", "+391 02 12345678", [(0, 16)]),
    ("telephone", "317  2604918", []),
    ("telephone", "217 2604918", []),
    ("telephone", "317 260491", []),
    ("zipcode", "(40121)", [(1, 6)]),
    ("zipcode", "x 401212 y", []),
    ("zipcode", "x ٤٠١٢١ y", []),
    ("email", "x y@z.co.it, w", [(2, 11)]),
    ("email", "a@b@c.it", [(2, 8)]),
    ("email", "a @b.it", []),
    ("fiscal_code", "qwxzkj61p07m554t", []),
    ("fiscal_code", "XQWXZKJ61P07M554TX", [(1, 17)]),
    ("age", "età: 5 anni", [(5, 11)]),
    ("age", "ANNI 5", [(0, 6)]),
    ("age", "anni cinque", []),
    ("date", "3/4/2020 3-4-2020 3.4.2020 3 4 2020", [(0, 8), (9, 17), (18, 26), (27, 35)]),
    ("date", "2020/4/3", [(0, 8)]),
    ("date", "3 maggio 2020", [(0, 13)]),
    ("date", "maggio/20", [(0, 9)]),
    ("date", "gen 1 feb 2 mar 3 apr 4 giu 6 lug 7 ago 8 set 9", [(6 * k, 6 * k + 5) for k in range(8)]),
    ("date", "ott 10 nov 11 dic 12", [(0, 6), (7, 13), (14, 20)]),
    ("date", "gennaio 1", [(0, 9)]),
    ("date", "febbraio 2 settembre 9", [(0, 10), (11, 22)]),
    ("date", "3_4_2020", []),
]


@pytest.mark.parametrize("name", FINDERS)
def test_listed_cases(spark, name):
    cases = [(t, spans) for n, t, spans in CASES if n == name]
    hits = found(spark, name, [t for t, _ in cases])
    assert [[h[:2] for h in row] for row in hits] == [spans for _, spans in cases]


@pytest.mark.parametrize("name", FINDERS)
def test_random_texts(spark, name):
    rng = random.Random(name)
    pieces = {
        "telephone": ["3", "0", "+39", "0039", "(", ")", " ", " ", "-", "/", "\\", "349", "1234567", "٣", "x"],
        "zipcode": ["4", "47122", " ", "x", "\n", "٣", "123456", "𝄞"],
        "email": ["a", "bc", "@", ".", ",", " ", " ", "\x1c", "it", "\uffff", "𝄞", "@x.it"],
        "fiscal_code": ["XQWXZKJ61P07", "QWXZKJ٣٤P07", "M554T", "M5٣4TX", "QWXZKJ61P07M554T", "a", " "],
        "age": ["anni", "ANNI", "66", "٣", " ", " ", "\x1f", "x", "Anni 5"],
        "date": ["gen", "Gennaio", "mag", "maggio", "12", "3", "2020", "-", "/", ".", " ", "٣", "x", " "],
    }[name]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(3000)]
    hits = found(spark, name, texts)
    assert hits == [expected(name, t) for t in texts]
    assert sum(map(len, hits)) > 200


def test_many_hits_and_long_junk(spark):
    """More hits than one fold holds, hosts with thousands of labels, long runs."""
    many = "x 12/3/2020 è, " * 1000
    host = "u@" + "a." * 3000 + "it"
    run = "z" * 200_000
    digits = "1" * 100_000
    assert found(spark, "date", [many])[0] == expected("date", many)
    assert found(spark, "email", [host, run, run + "@", many + host]) == [
        [(0, len(host), host)],
        [],
        [],
        [(len(many), len(many) + len(host), host)],
    ]
    assert found(spark, "age", [digits + " " * 1000, "anni" * 5000 + " 5"])[1][0][2] == "anni 5"


def test_lengths_kept_beside_letters_that_grow_in_lower_case(spark):
    assert found(spark, "age", ["İİ 66 anni"]) == [[(3, 10, "66 anni")]]


def test_one_pass_ahead_of_all_finders(spark):
    """The characters the pass looks for are in each match, and texts with a match pass."""
    texts = [t for _, t, _ in CASES] + ["no match here", "", None, "@", "٣"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found_dates = finders.find_dates("text", REFERENCE)
    for names in (list(FINDERS), ["email"], ["age", "email"], []):
        got = df.selectExpr("id", f"{finders.pattern_spans('text', names, REFERENCE)} AS spans").collect()
        each = [found_dates if n == "date" else FINDERS[n][0]("text") for n in names]
        want = df.selectExpr("id", *[f"size({e}) AS n{k}" for k, e in enumerate(each)]).collect()
        assert [len(r.spans) for r in sorted(got)] == [sum(r[1:]) for r in sorted(want)]
    for name, (_, pattern) in FINDERS.items():
        needed = re.compile(f"[{python(P.NEEDED[name])}]")
        assert all(needed.search(h[2]) for t in texts if t for h in expected(name, t))
