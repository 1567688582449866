"""Folds over arrays."""

from itertools import accumulate

import pytest

from velum.functions.arrays import let, running
from velum.operators import annotations


def test_folds_hold_states_only():
    sql = running("xs", "0", lambda s, x: f"{s} + {x}", lambda s, x, i: "made(here)", "int")
    assert sql.count("transform(items, (item, i) -> made(here))") == sql.count("made(here)") == 1


def test_let_copies_nothing():
    assert "transform" not in let("x", "value", "x")


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 65, 1000])
def test_running(spark, n):
    items = [i * 7 % 11 for i in range(n)]
    df = spark.createDataFrame([(items,)], "xs array<int>")
    add = lambda s, x: f"{s} + {x}"
    before = list(accumulate(items, initial=0))[:-1]
    row = df.selectExpr(
        running("xs", "0", add, lambda s, x, i: f"{s} * 1000 + {i}", "int") + " AS made",
        running("xs", "0", add, None, "int", lambda s, x: f"{s} % 2 = 0") + " AS kept",
        running("xs", "0", add, lambda s, x, i: s, "int", lambda s, x: f"{x} > 5") + " AS some",
    ).first()
    assert row.made == [s * 1000 + i for i, s in enumerate(before)]
    assert row.kept == [x for s, x in zip(before, items) if s % 2 == 0]
    assert row.some == [s for s, x in zip(before, items) if x > 5]


def test_runs_of_tags(spark):
    tags = "I-DOCTOR B-DOCTOR I-DOCTOR I-DATE B-DATE B-CITY O I-DOCTOR B-DOCTOR".split()
    text = "x y\n\n" + "\n".join(f"w{i} {t}" for i, t in enumerate(tags)) + "\n\nx y"
    df = spark.createDataFrame([(text,)], "text string")
    runs = annotations.bio_runs(annotations.labelled(annotations.body_tokens("text")))
    got = [(g.start, g.end, g.bio_label) for g in df.selectExpr(f"{runs} AS gold").first().gold]
    assert got == [(3, 8, "B-DOCTOR"), (12, 14, "B-DATE"), (15, 17, "B-CITY"), (24, 26, "B-DOCTOR")]
