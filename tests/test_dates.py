"""The date rule against a public lenient date parser, and listed cases."""

import datetime as dt
import random

import pytest
from dateutil import parser
from pyspark.sql import functions as F

from velum.functions.dates import generalise, normalise_months, parse_date
from velum.labels import MONTHS


def lenient(text, reference):
    info = parser.parserinfo(dayfirst=True)
    info._year, info._century = reference.year, reference.year // 100 * 100
    for name, number in MONTHS:
        text = text.replace(name, number)
    try:
        default = dt.datetime(reference.year, reference.month, reference.day)
        d = parser.parser(info).parse(text, default=default)
    except (parser.ParserError, OverflowError):
        return None
    return (d.year, d.month, d.day)


def read(spark, texts, reference):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", F.expr(parse_date("text", reference)).alias("d")).collect()
    return [None if r.d is None else tuple(r.d) for r in sorted(rows, key=lambda r: r.id)]


REFERENCE = dt.date(2026, 12, 1)
CASES = {
    "28/06/2022": (2022, 6, 28),
    "9.04.2020": (2020, 4, 9),
    "12/22": (2026, 12, 22),
    "gennaio 2020": (2020, 1, 1),
    "20.1": (2026, 12, 20),
    "2020-13-01": (2020, 1, 13),
    "3 45": (2045, 3, 1),
    "٢٨/٠٦/٢٠٢٢": (2022, 6, 28),
    **dict.fromkeys(["13/13", "31/02", "120/80", "0.58", "1.2020", "2020-2020"]),
}


def test_listed_cases(spark):
    assert read(spark, list(CASES), REFERENCE) == list(CASES.values())
    assert read(spark, ["31.5"], dt.date(2026, 12, 31)) == [(2026, 12, 31)]
    assert read(spark, ["31.5"], dt.date(2026, 11, 30)) == [None]


@pytest.mark.parametrize("reference", [REFERENCE, dt.date(2024, 2, 29), dt.date(2023, 11, 30)])
def test_against_public_parser(spark, reference):
    rng = random.Random(str(reference))

    def number():
        style = rng.random()
        if style < 0.4:
            return str(rng.randint(0, 35)).zfill(rng.randint(1, 2))
        if style < 0.6:
            return str(rng.randint(1900, 2100))
        return str(rng.randint(0, 9999)).zfill(rng.randint(1, 4))

    def candidate():
        middle = rng.choice(MONTHS)[0] if rng.random() < 0.2 else number()[:2]
        first = number() + rng.choice("-/. ") if rng.random() < 0.6 else ""
        return first + middle + rng.choice("-/. ") + number()

    texts = list({candidate() for _ in range(4000)})
    got = read(spark, texts, reference)
    wrong = [(t, g, w) for t, g in zip(texts, got) if g != (w := lenient(t, reference))]
    assert not wrong
    assert sum(g is not None for g in got) > 500


def test_generalise_and_months(spark):
    df = spark.createDataFrame([("28/06/2022",)], "text string")
    df = df.select(F.expr(parse_date("text", REFERENCE)).alias("d"))
    row = df.selectExpr(f"{generalise('d', 'year')} AS y", f"{generalise('d', 'month')} AS m").first()
    assert (row.y, row.m) == ("2022", "6-2022")
    row = spark.sql(f"SELECT {normalise_months(chr(39) + 'marzo mar lugen' + chr(39))} AS t").first()
    assert row.t == "03 03 lu01"
